"""Boolean flags of functions, the rows that label them and the places where they occur.

All languages are read from syntax trees, Python's own or those of :mod:`lexiprobe.functions.trees`: tests, literal
assignments, logical operands, comparisons with literals and returns.

A hit is a place where a name is used as a flag; a flag's occurrences are the sites of its hits, not
every place of the name. One name may make several hits on one site.
"""

from __future__ import annotations

import ast
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiprobe.functions.trees import Node, outer_functions, own_nodes, parse

# What a hit's pattern makes its sites; other patterns assign.
MEANS = {
    "while_test": "loop_use", "return_bool": "return_use", "if_test": "conditional_use", "if_exp_test": "conditional_use", "assign_boolop_rhs": "conditional_use",
    "assign_not_name_inner": "conditional_use", "annassign_bool_literal": "definition",
}
NO_FUNCTION = "no top-level function definition in module"

_COLUMNS = (
    ("function", "string"), ("function_line", "integer"), ("variable", "string"), ("occurrence_type", "string"), ("detection_pattern", "string"), ("line", "integer"), ("col_offset", "integer"), ("s", "integer"), ("e", "integer"),
    ("parent_type", "string"), ("statement_type", "string"),
)
_FIELDS = tuple(n for n, _ in _COLUMNS)


def _struct(columns) -> T.StructType:
    out = T.StructType()
    for name, kind in columns:
        out = out.add(name, kind)
    return out


# --- Python -------------------------------------------------------------------------------------------


@dataclass
class Hit:
    """A name used as a flag by ``pattern``; ``node`` is the expression or statement that shows it, ``sites`` are the name's places in it."""

    variable: str
    line: int
    pattern: str
    node: ast.AST
    sites: list[ast.Name] = field(default_factory=list)


def top_functions(tree: ast.Module) -> list[ast.FunctionDef | ast.AsyncFunctionDef]:
    return [s for s in tree.body if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef))]


def _own(function: ast.AST) -> Iterator[ast.AST]:
    """Nodes of a function in breadth-first order, without what is inside of functions within."""
    queue = deque(ast.iter_child_nodes(function))
    while queue:
        node = queue.popleft()
        yield node
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            queue.extend(ast.iter_child_nodes(node))


def _literal(node) -> bool:
    return isinstance(node, ast.Constant) and isinstance(node.value, bool)  # 0 and 1 are no booleans


def tested_names(expr: ast.expr | None, ternary: bool = True) -> set[str]:
    """Names that an expression reads as truth values: through not, and, or, comparisons with True or False, and a ternary's test."""
    match expr:
        case ast.Name(id=name, ctx=ast.Load()):
            return {name}
        case ast.UnaryOp(op=ast.Not(), operand=inner):
            return tested_names(inner, ternary)
        case ast.BoolOp(values=values):
            return set().union(*(tested_names(v, ternary) for v in values))
        case ast.IfExp(test=test) if ternary:
            return tested_names(test)
        case ast.Compare(left=left, ops=ops, comparators=rest):
            sides = zip([left, *rest[:-1]], ops, rest, strict=True)
            return {a.id for x, op, y in sides if isinstance(op, (ast.Eq, ast.NotEq, ast.Is, ast.IsNot)) for a, b in ((x, y), (y, x)) if isinstance(a, ast.Name) and isinstance(a.ctx, ast.Load) and _literal(b)}
    return set()


def target_names(node: ast.expr) -> list[str]:
    """Names that an assignment's target binds, through tuples, lists and stars."""
    match node:
        case ast.Name(id=name):
            return [name]
        case ast.Starred(value=inner):
            return target_names(inner)
        case ast.Tuple(elts=parts) | ast.List(elts=parts):
            return [n for p in parts for n in target_names(p)]
    return []


def _places(root: ast.AST, name: str, loads: bool) -> list[ast.Name]:
    return [n for n in ast.walk(root) if isinstance(n, ast.Name) and n.id == name and (not loads or isinstance(n.ctx, ast.Load))]


def python_hits(function: ast.AST) -> list[Hit]:
    """All hits of a function but those of returns, in breadth-first order."""
    hits: list[Hit] = []

    def tested(pattern: str, test: ast.expr) -> None:
        hits.extend(Hit(n, test.lineno, pattern, test, _places(test, n, True)) for n in sorted(tested_names(test)))

    def bound(pattern: str, node: ast.AST, targets: list[ast.expr]) -> None:
        for t in targets:
            for n in target_names(t):
                hits.append(Hit(n, node.lineno, pattern, node, [p for x in targets for p in _places(x, n, False)]))

    for node in _own(function):
        match node:
            case ast.If():
                link = node
                while link is not None:  # each elif counts again with every if before it
                    tested("if_test", link.test)
                    link = link.orelse[0] if len(link.orelse) == 1 and isinstance(link.orelse[0], ast.If) else None
            case ast.While(test=test):
                tested("while_test", test)
            case ast.IfExp(test=test):
                tested("if_exp_test", test)
            case ast.AnnAssign(target=target, value=value) if value is not None and _literal(value):
                bound("annassign_bool_literal", node, [target])
            case ast.Assign(targets=targets, value=value) if _literal(value):
                bound("assign_bool_literal", node, targets)
            case ast.Assign(targets=targets, value=ast.BoolOp() as value):
                bound("assign_boolop_lhs", node, targets)
                # the sites of operands are looked for in the whole statement
                hits.extend(Hit(n, node.lineno, "assign_boolop_rhs", node, _places(node, n, True)) for n in sorted(tested_names(value, ternary=False)))
            case ast.Assign(targets=targets, value=ast.UnaryOp(op=ast.Not(), operand=ast.Name(id=inner))):
                bound("assign_not_name", node, targets)
                hits.append(Hit(inner, node.lineno, "assign_not_name_inner", node, _places(node, inner, True)))
    return hits


def python_returns(function: ast.AST) -> list[Hit]:
    """A hit for every place of a name that a returned expression reads as a truth value."""
    out = []
    for node in _own(function):
        if isinstance(node, ast.Return) and node.value is not None:
            for name in ast.walk(node.value):
                if isinstance(name, ast.Name) and isinstance(name.ctx, ast.Load) and name.id in tested_names(node.value):
                    out.append(Hit(name.id, name.lineno, "return_bool", name, [name]))
    return out


def parsed(code: str) -> tuple[ast.Module | None, str | None]:
    """The syntax tree, or what is wrong."""
    try:
        return ast.parse(code), None
    except SyntaxError as e:
        return None, f"{e.msg} (line {e.lineno})"
    except (ValueError, RecursionError, MemoryError) as e:
        return None, str(e) or type(e).__name__


def python_labels(code: str) -> tuple[list[dict], str | None]:
    """A row for each flag of each top-level function, by its first hit (line, then pattern); or the error."""
    tree, error = parsed(code)
    if tree is None or not top_functions(tree):
        return [], error or NO_FUNCTION
    rows = []
    for f in top_functions(tree):
        first: dict[str, Hit] = {}
        for h in sorted(python_hits(f), key=lambda h: (h.line, h.pattern)):
            first.setdefault(h.variable, h)
        for name, h in sorted(first.items()):
            said = (ast.get_source_segment(code, h.node) or "").strip().splitlines()
            rows.append({"function": f.name, "variable": name, "line": h.line, "code": said[0] if said else ""})
    return rows, None


class Lines:
    """Character offsets of a text's lines; columns of syntax trees are bytes."""

    def __init__(self, code: str):
        self.lines = code.split("\n")
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line) + 1)

    def line_of(self, offset: int) -> int:
        """The line, from 1, that holds an offset."""
        return bisect_right(self.starts, offset, 0, len(self.lines))

    def offset(self, line: int, column: int) -> int:
        text = self.lines[line - 1] if line <= len(self.lines) else ""
        return self.starts[line - 1] + (column if text.isascii() else len(text.encode("utf-8", "surrogatepass")[:column].decode("utf-8", "ignore")))


def python_occurrences(code: str) -> list[tuple]:
    """Rows of the sites of all hits of the top-level functions, by line, column and name; spans in characters."""
    tree, _ = parsed(code)
    rows, at = [], Lines(code)
    for f in top_functions(tree) if tree else []:
        parents = {c: p for p in ast.walk(f) for c in ast.iter_child_nodes(p)}
        for h in [*python_hits(f), *python_returns(f)]:
            for site in h.sites:
                up = parents.get(site)
                kind = "indexing_use" if isinstance(up, ast.Subscript) else MEANS.get(h.pattern, "assignment")
                statement = up
                while statement is not None and (not isinstance(statement, ast.stmt) or isinstance(statement, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))):
                    statement = parents.get(statement)
                s = at.offset(site.lineno, site.col_offset)
                rows.append((f.name, f.lineno, h.variable, kind, h.pattern, site.lineno, s - at.starts[site.lineno - 1], s, s + len(site.id), type(up).__name__, type(statement).__name__ if statement else None))
    return sorted(rows, key=lambda r: (r[5], r[6], r[2]))


# --- other languages -------------------------------------------------------------------------------

#: Languages in which a ternary's condition is a test; in which a for loop's condition is one, as that of a while loop.
TERNARY_TESTS, FOR_TESTS = ("Java", "C++", "C"), ("Javascript", "Go")
#: Languages whose assigned values are looked at through brackets; in which x op= y counts as an assignment of y.
OPEN_VALUES, COMPOUND = ("Javascript", "PHP"), ("Java", "Go")
#: Kinds of nodes whose names stand for the thing that is indexed, its index, or the owner of a member.
INDEXING = {"Ruby": ("call", "index")}
_STATEMENTS = ("if", "while", "for", "foreach", "return", "declaration", "assign", "do", "switch", "case", "try", "jump", "until", "unless", "if_modifier", "unless_modifier")


def _bare(node: Node | None) -> Node | None:
    """Without brackets around."""
    while node is not None and node.kind == "paren" and len(node.kids) == 1:
        node = node.kids[0]
    return node


def truth_names(node: Node | None, language: str, ternary: bool = True) -> set[str]:
    """Names that an expression reads as truth values: through brackets, !, && and ||, comparisons with true or false, and a ternary's test."""
    node = _bare(node)
    if node is None:
        return set()
    if node.kind == "name":
        return {node.text}
    if node.kind == "not":
        return truth_names(node.value, language, ternary)
    if node.kind == "logic":
        return set().union(*(truth_names(k, language, ternary) for k in node.kids))
    if node.kind == "compare":
        sides = [_bare(k) if language == "Javascript" else k for k in node.kids]
        return {a.text for a in sides if a.kind == "name" and any(b.kind == "boolean" for b in sides)}
    return truth_names(node.test, language) if node.kind == "ternary" and ternary and language in TERNARY_TESTS else set()


def _tests(node: Node, language: str) -> Iterator[tuple[str, Node]]:
    """(pattern, expression) of what a statement tests."""
    pattern = {"if": "if_test", "while": "while_test"}.get(node.kind)
    if node.kind == "for" and language in FOR_TESTS:
        pattern = "while_test"
    if node.kind == "ternary" and language in TERNARY_TESTS:
        pattern = "if_exp_test"
    if pattern and node.test is not None:
        yield pattern, node.test


def _bound(node: Node, parent: Node, language: str) -> list[str] | None:
    """Names that a declaration or an assignment gives a value to; None for what is neither. Fields of classes are not looked at."""
    if node.kind == "declare" and parent.kind == "declaration":
        return [node.text] if node.text else []
    if node.kind != "assign" or node.text == "range" or (node.text not in ("=", ":=") and language not in COMPOUND):
        return None
    return [k.text for k in node.kids if k is not node.value and k.kind == "name"]


def tree_hits(function: Node, language: str) -> Iterator[tuple[str, str, Node]]:
    """(pattern, name, node): each place of the name in the node is a site."""
    for node, parent in own_nodes(function, language):
        for pattern, test in _tests(node, language):
            for name in sorted(truth_names(test, language)):
                yield pattern, name, test
        if node.kind == "return" and node.value is not None:
            allowed = truth_names(node.value, language) if language != "Ruby" or node.value.kind == "name" else set()
            for place in node.value.walk():
                if place.kind == "name" and place.text in allowed:
                    yield "return_bool", place.text, place
        targets = _bound(node, parent, language)
        if targets is None or node.value is None:
            continue
        value = _bare(node.value) if language in OPEN_VALUES else node.value
        if value.kind == "boolean":
            yield from (("assign_bool_literal", t, node) for t in targets)
        elif value.kind == "logic":
            yield from (("assign_boolop_lhs", t, node) for t in targets)
            yield from (("assign_boolop_rhs", n, value) for n in sorted(truth_names(value, language, ternary=False)))
        elif value.kind == "not":
            inner = _bare(value.value) if language == "Javascript" else value.value
            if inner is not None and inner.kind == "name":
                yield from (("assign_not_name", t, node) for t in targets)
                yield "assign_not_name_inner", inner.text, value


def tree_occurrences(code: str, language: str) -> list[tuple]:
    """Rows as of :func:`python_occurrences` from a tree of :mod:`trees`, with its kinds of nodes; PHP's spans hold the sigil."""
    rows, lines = [], Lines(code)
    indexing = INDEXING.get(language, ("index", "member"))
    for function in outer_functions(parse(code, language), language):
        parents = {id(k): n for n in function.walk() for k in n.kids}
        first = lines.line_of(function.s)
        for pattern, name, node in tree_hits(function, language):
            for site in node.walk():
                if site.kind != "name" or site.text != name:
                    continue
                up = parents[id(site)]
                statement = up
                while statement.kind not in _STATEMENTS and statement is not function:
                    statement = parents[id(statement)]
                kind = "indexing_use" if up.kind in indexing else MEANS.get(pattern, "assignment")
                line = lines.line_of(site.s)
                rows.append((function.text, first, name, kind, pattern, line, site.s - lines.starts[line - 1], site.s, site.e, up.kind, statement.kind if statement is not function else None))
    return sorted(rows, key=lambda r: (r[5], r[6], r[2]))


def occurrence_rows(code: str | None, language: str) -> list[dict]:
    if not code:
        return []
    return [dict(zip(_FIELDS, r, strict=True)) for r in (python_occurrences(code) if language == "Python" else tree_occurrences(code, language))]


@F.pandas_udf(T.ArrayType(_struct(_COLUMNS)))
def occurrences(code: pd.Series, language: pd.Series) -> pd.Series:
    """Occurrences of a program in its language; a language that is not supported raises."""
    return pd.Series([occurrence_rows(c, lang) for c, lang in zip(code, language, strict=True)], dtype=object)


@F.pandas_udf(_struct((("error", "string"), ("rows", T.ArrayType(_struct((("function", "string"), ("variable", "string"), ("line", "integer"), ("code", "string"))))))))
def labels(code: pd.Series) -> pd.DataFrame:
    """The flags of a Python program's top-level functions, or its error."""
    both = [python_labels(c or "") for c in code]
    return pd.DataFrame({"error": [e for _, e in both], "rows": [r for r, _ in both]})
