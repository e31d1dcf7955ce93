"""Where the names of a program's roles stand, what a function is made of, and what a literal can be followed to."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiprobe.functions import roles as R
from lexiprobe.functions import trees
from lexiprobe.functions.flags import Lines, _struct, parsed, target_names, top_functions
from lexiprobe.functions.text import code_mask

_IDENTIFIER = re.compile(r"[A-Za-z_]\w*")

# --- scopes and roles -----------------------------------------------------------------------------


class Scopes:
    """The functions of a program by their spans, which nest; the module is number -1."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        self.spans = sorted(spans, key=lambda x: (x[0], -x[1]))

    def numbers(self, places: list[int]) -> list[int]:
        """The innermost function around each of the ascending places."""
        out, open_, nxt = [], [], 0
        for at in places:
            while nxt < len(self.spans) and self.spans[nxt][0] <= at:
                open_.append(nxt)
                nxt += 1
            while open_ and self.spans[open_[-1]][1] <= at:
                open_.pop()
            out.append(open_[-1] if open_ else -1)
        return out


def _python_facts(tree: ast.Module, at: Lines) -> Iterator[tuple[int, str, str, bool]]:
    """(place, what a name is used as, name, only for the module) of the uses that make roles.

    ``fed`` asks for a loop around: one of the same function, or for the module any.
    """
    todo: list[tuple[ast.AST, bool, bool]] = [(tree, False, False)]
    while todo:
        node, own_loop, any_loop = todo.pop()
        loop = isinstance(node, (ast.For, ast.While))
        own_loop, any_loop = (own_loop or loop) and not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)), any_loop or loop
        todo += [(c, own_loop, any_loop) for c in ast.iter_child_nodes(node)]
        found: list[tuple[str, str]] = []
        match node:
            case ast.Subscript(slice=ast.Name(id=name)):
                found.append(("index_key", name))
            case ast.ClassDef(name=name):
                found.append(("class_struct", name))
            case ast.Assign(targets=targets, value=ast.Constant(value=bool())):
                found += [("boolean", t.id) for t in targets if isinstance(t, ast.Name)]
            case ast.AnnAssign(target=ast.Name(id=name), value=ast.Constant(value=bool())):
                found.append(("boolean", name))
            case ast.For(target=target):
                found += [("iterator", n.id) for n in ast.walk(target) if isinstance(n, ast.Name)]
            case ast.AugAssign(target=ast.Name(id=name)) | ast.Expr(value=ast.Call(func=ast.Attribute(value=ast.Name(id=name), attr="append" | "extend" | "add" | "update"))):
                if any_loop:
                    found.append(("fed", name))
        for fact, name in found:
            yield at.offset(node.lineno, node.col_offset), fact, name, fact == "fed" and not own_loop


def _pattern_facts(code: str, language: str) -> Iterator[tuple[int, str, str, bool]]:
    if language == "PHP":
        code = re.sub(r"\$(?=\s*[a-zA-Z_])", " ", code)  # places stay
    for role, patterns in R.patterns_of(language).items():
        for pattern in patterns:
            for m in re.finditer(pattern, code):
                for g in range(1, (m.re.groups or 0) + 1):
                    if m[g] and m[g] not in R.KEYWORDS[language]:
                        yield m.start(g), role, m[g], False


def _declared(root: trees.Node) -> Iterator[tuple[int, str]]:
    """(place, name) of every declaration: variables of blocks and loop headers, and parameters."""
    for node in root.walk():
        if node.kind in ("declare", "param") and node.text:
            yield node.s, node.text


def scope_rows(code: str | None, language: str) -> list[dict]:
    """What role sites are made of, for one program parsed once.

    A row with ``fact`` says what a name is used as in a scope (``declared``: a block, a loop header or a
    parameter binds it there); what functions do counts for the module (-1) too. A row with ``s`` is a
    place of such a name in code.
    """
    if not code:
        return []
    lines, declared = Lines(code), []
    if language == "Python":
        tree, _ = parsed(code)
        if tree is None:
            return []
        functions = [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
        scopes = Scopes([(lines.offset(n.lineno, n.col_offset), lines.offset(n.end_lineno, n.end_col_offset), n.name) for n in functions])
        facts = list(_python_facts(tree, lines))
    elif language in R.PATTERN_LANGUAGES:
        root = trees.parse(code, language) if language in trees.LANGUAGES else None
        scopes = Scopes([(n.s, n.e, n.text) for n in trees.outer_functions(root, language)] if root else [])
        facts = list(_pattern_facts(code, language))
        # PHP's functions are scopes of their own: a name given a value twice is one variable
        declared = [(s, "declared", n, False) for s, n in _declared(root)] if root and language != "PHP" else []
    else:
        return []
    if not facts:
        return []
    facts = sorted(facts + declared)
    used = {n for _, f, n, _ in facts if f != "declared"}
    common = dict.fromkeys(("s", "e", "line", "col_offset", "end_col_offset", "function", "span", "scope_known"))
    out = []
    for (_, fact, name, module), scope in zip(facts, scopes.numbers([f[0] for f in facts]), strict=True):
        if name in used and not (fact == "declared" and scope < 0):
            own = [] if module or scope < 0 else [scope]
            out += [common | {"scope": x, "variable": name, "fact": fact} for x in (own if fact == "declared" else [*own, -1])]
    mask = code_mask(code)
    places = [m for m in _IDENTIFIER.finditer(code) if m[0] in used and mask[m.start()][0]]
    for m, scope in zip(places, scopes.numbers([m.start() for m in places]), strict=True):
        line = lines.line_of(m.start())
        begin = lines.starts[line - 1]
        s, e, name = scopes.spans[scope] if scope >= 0 else (None, None, None)
        out.append({
            "scope": scope, "variable": m[0], "fact": None, "s": m.start(), "e": m.end(), "line": line, "col_offset": m.start() - begin, "end_col_offset": m.end() - begin,
            "function": name, "span": None if name is None else f"{name}@{s}-{e}", "scope_known": bool(scopes.spans),
        })
    return out


_SCOPE_ROW = _struct((
    ("scope", "integer"), ("variable", "string"), ("fact", "string"), ("s", "integer"), ("e", "integer"), ("line", "integer"), ("col_offset", "integer"), ("end_col_offset", "integer"),
    ("function", "string"), ("span", "string"), ("scope_known", "boolean"),
))


@F.pandas_udf(T.ArrayType(_SCOPE_ROW))
def scope_facts(code: pd.Series, language: pd.Series) -> pd.Series:
    """Column form of :func:`scope_rows`."""
    return pd.Series([scope_rows(c, lang) for c, lang in zip(code, language, strict=True)], dtype=object)


# --- functions ------------------------------------------------------------------------------------

#: Kinds of nodes that a function's record lists.
KINDS = {
    ast.FunctionDef: "function_def", ast.AsyncFunctionDef: "function_def", ast.For: "for_loop", ast.AsyncFor: "async_for_loop", ast.While: "while_loop", ast.Assign: "assign", ast.AnnAssign: "ann_assign",
    ast.AugAssign: "aug_assign", ast.Return: "return", ast.Subscript: "subscript", ast.If: "if_stmt", ast.IfExp: "if_exp",
}
_ASSIGNS = {"assign": "assign", "ann_assign": "ann_assign", "aug_assign": "aug_assign"}
_LOOPS = {"for_loop": "for", "async_for_loop": "async_for", "while_loop": "while"}


def _binds(node: ast.AST) -> list[str]:
    match node:
        case ast.Assign(targets=targets):
            return [n for t in targets for n in target_names(t)]
        case ast.AnnAssign(target=t) | ast.AugAssign(target=t) | ast.For(target=t) | ast.AsyncFor(target=t):
            return target_names(t)
    return []


def function_records(code: str | None) -> tuple[list[dict], str | None]:
    """A record of each top-level function: its variables' places, its nodes of KINDS, assignments and loops; or the error."""
    tree, error = parsed(code or "")
    if tree is None or not top_functions(tree):
        return [], error or "no top-level function definition in module"
    out = []
    for f in top_functions(tree):
        names: dict[str, list[dict]] = {}
        nodes, assigns, loops = [], [], []
        for n in ast.walk(f):
            if isinstance(n, ast.Name):
                names.setdefault(n.id, []).append({"line": n.lineno, "col": n.col_offset, "ctx": type(n.ctx).__name__})
            if kind := KINDS.get(type(n)):
                entry = {
                    "kind": kind, "ast_type": type(n).__name__, "line": n.lineno, "col": n.col_offset, "end_line": n.end_lineno, "end_col": n.end_col_offset,
                    "targets": _binds(n), "op": type(n.op).__name__ if isinstance(n, ast.AugAssign) else None, "name": getattr(n, "name", None),
                }
                nodes.append(entry)
                if kind in _ASSIGNS:
                    assigns.append(entry | {"kind": _ASSIGNS[kind]})
                if kind in _LOOPS:
                    loops.append(entry | {"kind": _LOOPS[kind]})
        nodes.sort(key=lambda x: (x["line"], x["col"], x["kind"]))
        out.append({"function": f.name, "variables": [{"name": n, "occurrences": o} for n, o in sorted(names.items())], "nodes": nodes, "assignments": assigns, "loops": loops})
    return out, None


_PLACE = _struct((("line", "integer"), ("col", "integer"), ("ctx", "string")))
_NODE = T.ArrayType(_struct((("kind", "string"), ("ast_type", "string"), ("line", "integer"), ("col", "integer"), ("end_line", "integer"), ("end_col", "integer"), ("targets", T.ArrayType(T.StringType())), ("op", "string"), ("name", "string"))))
_RECORD = _struct((("function", "string"), ("variables", T.ArrayType(_struct((("name", "string"), ("occurrences", T.ArrayType(_PLACE)))))), ("nodes", _NODE), ("assignments", _NODE), ("loops", _NODE)))


@F.pandas_udf(_struct((("error", "string"), ("functions", T.ArrayType(_RECORD)))))
def records(code: pd.Series) -> pd.DataFrame:
    both = [function_records(c) for c in code]
    return pd.DataFrame({"error": [e for _, e in both], "functions": [r for r, _ in both]})


def places_in_function(code: str | None, function: str | None, variable: str | None) -> list[dict] | None:
    """The variable's places, as a name or an argument, in the first top-level function of that name; null if the code does not parse or has none."""
    tree, _ = parsed(code or "")
    f = next((f for f in top_functions(tree) if f.name == function), None) if tree else None
    if f is None:
        return None
    found = [(n.lineno, n.col_offset, type(n.ctx).__name__) for n in ast.walk(f) if isinstance(n, ast.Name) and n.id == variable]
    found += [(n.lineno, n.col_offset, "arg") for n in ast.walk(f) if isinstance(n, ast.arg) and n.arg == variable]
    return [{"line": line, "col": col, "ctx": ctx} for line, col, ctx in sorted(found)]


@F.pandas_udf(T.ArrayType(_PLACE))
def variable_places(code: pd.Series, function: pd.Series, variable: pd.Series) -> pd.Series:
    return pd.Series([places_in_function(*x) for x in zip(code, function, variable, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def top_level_names(code: pd.Series) -> pd.Series:
    """Names of a Python program's top-level functions; null if it does not parse."""
    return pd.Series([[f.name for f in top_functions(t)] if (t := parsed(c or "")[0]) else None for c in code], dtype=object)


# --- constants --------------------------------------------------------------------------------------

#: What a statement reads, and the blocks that it opens; statements of other kinds are not followed.
_READS = {ast.Assign: "value", ast.AnnAssign: "value", ast.AugAssign: "value", ast.Expr: "value", ast.If: "test", ast.While: "test", ast.For: "iter", ast.With: "items"}
_OPENS = {ast.If: ("body", "orelse"), ast.While: ("body", "orelse"), ast.For: ("body", "orelse"), ast.With: ("body",), ast.FunctionDef: ("body",), ast.AsyncFunctionDef: ("body",), ast.ClassDef: ("body",)}


def _learned(node: ast.stmt) -> dict[str, bool]:
    """Names that a statement makes True or False."""
    targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
    value = getattr(node, "value", None)
    known = isinstance(value, ast.Constant) and isinstance(value.value, bool)
    return {t.id: value.value for t in targets if known and isinstance(t, ast.Name)}


def constant_uses(code: str | None) -> list[tuple[int, int, int]]:
    """(start, end, value) of each use of a name that is known to be True (1) or False (0) there, by place.

    What is known flows down a block and into the blocks that its statements open, but not back out of them;
    functions start with nothing known.
    """
    tree, _ = parsed(code or "")
    at, out = Lines(code or ""), []
    waiting = [(tree.body, {})] if tree else []
    while waiting:
        block, known = waiting.pop()
        for node in block:
            read = getattr(node, _READS.get(type(node), ""), None) if known else None
            heads = [i.context_expr for i in read] if isinstance(read, list) else [read] if read is not None else []
            for name in (n for h in heads for n in ast.walk(h) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load) and n.id in known):
                s = at.offset(name.lineno, name.col_offset)
                out.append((s, s + len(name.id), int(known[name.id])))
            known.update(_learned(node))
            fresh = isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef))
            waiting += [(getattr(node, f), {} if fresh else dict(known)) for f in _OPENS.get(type(node), ())]
    return sorted(out)


@F.pandas_udf(T.ArrayType(_struct((("s", "integer"), ("e", "integer"), ("label", "integer")))))
def constant_labels(code: pd.Series) -> pd.Series:
    return pd.Series([[{"s": s, "e": e, "label": v} for s, e, v in constant_uses(c)] for c in code], dtype=object)
