"""Renaming identifiers of Python programs, and carrying occurrences through the edits."""

from __future__ import annotations

import ast
import builtins
import hashlib
import keyword
import re
import symtable
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiprobe.functions.flags import Lines
from lexiprobe.functions.roles import ROLES, python_roles

STRATEGIES = ("baseline", "random_nouns", "single_chars", "all_same", "numeric_vars", *(f"misleading_{r}" for r in ROLES))
NOUNS = "anchor basket candle dragon engine feather garden hammer island jacket kettle lantern mirror needle orchard pencil quarry ribbon saddle temple urchin violin walnut yarrow zephyr".split()
#: Names that look like a role, and names that look like anything but.
LOOKS = {
    "index_key": "idx pos slot offset key_no".split(), "accumulator": "total acc running tally sum_so_far".split(), "iterator": "item elem each_one entry cur".split(),
    "boolean": "is_ok has_any found_it done_flag enabled".split(), "class_struct": "Widget Record Holder Shape Parcel".split(),
}
COUNTER = {r: "cloud river stone maple ember".split() for r in ROLES}


class UnsupportedLanguage(ValueError):
    """Whole-word renaming would corrupt programs of this language."""


def names_of(code: str) -> set[str]:
    """All identifiers: names, definitions, arguments, attributes, keywords, imports."""
    out: set[str] = set()
    for node in ast.walk(ast.parse(code)):
        match node:
            case ast.Name(id=n) | ast.FunctionDef(name=n) | ast.AsyncFunctionDef(name=n) | ast.ClassDef(name=n) | ast.arg(arg=n) | ast.Attribute(attr=n):
                out.add(n)
            case ast.keyword(arg=str(n)):
                out.add(n)
            case ast.alias(name=n, asname=a):
                out |= {*n.split("."), *([a] if a else [])}
    return out


def renameable(code: str) -> list[str]:
    try:
        names = {n.id for n in ast.walk(ast.parse(code)) if isinstance(n, ast.Name)} | {a.arg for a in ast.walk(ast.parse(code)) if isinstance(a, ast.arg)}
        names |= {n.name for n in ast.walk(ast.parse(code)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))}
    except (SyntaxError, ValueError):
        return []
    return sorted(names - set(keyword.kwlist) - set(dir(builtins)) - {"self", "cls"})


def apply_map(code: str, names: dict[str, str]) -> str:
    """Whole words, longest first, one after the other: a later rename may hit an earlier one's result."""
    for old in sorted(names, key=lambda n: (-len(n), n)):
        code = re.sub(rf"\b{re.escape(old)}\b", names[old], code)
    return code


def _hashed(seed, pool: list[str], n: int) -> list[str]:
    """``n`` names: the pool, repeated as needed, each repetition in an order given by hashes."""
    out: list[str] = []
    for turn in range(-(-n // max(1, len(pool)))):
        out += sorted(pool, key=lambda w: hashlib.sha256(f"{seed}:{turn}:{w}".encode()).hexdigest())
    return out[:n]


def rename(code: str, strategy: str, seed: int = 0, language: str = "Python") -> str:
    """One strategy of STRATEGIES; other languages than Python only pass through 'baseline'."""
    if strategy == "baseline":
        return code
    if language != "Python":
        raise UnsupportedLanguage(f"renaming is not supported for {language}")
    names = renameable(code)
    if strategy == "all_same":
        return apply_map(code, dict.fromkeys(names, "x"))
    if strategy == "random_nouns":
        return apply_map(code, dict(zip(names, _hashed(seed, NOUNS, len(names)), strict=True)))
    if strategy == "numeric_vars":
        return apply_map(code, dict(zip(names, _hashed(seed, [f"v{i}" for i in range(1, len(names) + 1)], len(names)), strict=True)))
    if strategy == "single_chars":
        letters = [chr(97 + i % 26) + ("" if i < 26 else str(i // 26 - 1)) for i in range(len(names))]
        return apply_map(code, dict(zip(names, _hashed(seed, letters, len(names)), strict=True)))
    role = strategy.removeprefix("misleading_")
    if role not in ROLES:
        raise ValueError(f"no strategy {strategy}")
    own = set(python_roles(code)[role])
    inside, outside = [n for n in names if n in own], [n for n in names if n not in own]
    return apply_map(code, {**dict(zip(inside, _hashed(seed, COUNTER[role], len(inside)), strict=True)), **dict(zip(outside, _hashed(seed + 1, LOOKS[role], len(outside)), strict=True))})


#: Conditions of scope-correct renaming: all locals numbered, lettered, targets alike, all locals nouns, targets as index names.
CONDITIONS = ("numbered", "letters", "same", "nouns", "index_names")
INDEX_NAMES = LOOKS["index_key"]
_SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.ClassDef, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
#: Calls by which a function reads its variables' names at run time.
_READS_NAMES = frozenset(("locals", "vars", "eval", "exec", "dir"))


def _plain_binders(function: ast.AST) -> bool:
    """Whether every name that the function binds is a name or an argument of its tree, not a string of another node."""
    return not any(isinstance(n, (ast.ExceptHandler, ast.MatchAs, ast.MatchStar)) and n.name or isinstance(n, ast.MatchMapping) and n.rest for n in ast.walk(function))


def _body_places(function: ast.FunctionDef | ast.AsyncFunctionDef) -> Iterator[tuple[ast.AST, str]]:
    """The names and arguments that belong to the function's own scope, in the order of the text: defaults, decorators and annotations of arguments do not."""
    args = function.args
    for a in sorted([*args.posonlyargs, *args.args, *filter(None, (args.vararg, args.kwarg)), *args.kwonlyargs], key=lambda a: (a.lineno, a.col_offset)):
        yield a, a.arg
    inside = (n for s in function.body for n in ast.walk(s) if isinstance(n, ast.Name))
    yield from ((n, n.id) for n in sorted(inside, key=lambda n: (n.lineno, n.col_offset)))


def flat_functions(tree: ast.Module, table: symtable.SymbolTable) -> tuple[list[tuple[ast.AST, list[str]]], dict[str, int]]:
    """(top-level functions with the local names that can be renamed, in order of appearance; why others were left, counted).

    Left are functions with scopes within (nested_scope), that assign globals (global_nonlocal), that bind
    names by except, match or the like (unsupported_binder), of which some call names a local as a keyword or
    passes keywords at large (kwarg_coupling), and that read names at run time (reads_names). Imported names and
    names of functions and classes within are no locals to rename.
    """
    calls = [n for n in ast.walk(tree) if isinstance(n, ast.Call)]
    keywords = {k.arg for c in calls for k in c.keywords}
    at_large = {c.func.id for c in calls if isinstance(c.func, ast.Name) and any(k.arg is None for k in c.keywords)}
    tables = {(t.get_name(), t.get_lineno()): t for t in table.get_children() if t.get_type() == "function"}
    out, left = [], dict.fromkeys(("nested_scope", "global_nonlocal", "unsupported_binder", "kwarg_coupling", "reads_names"), 0)
    for f in tree.body:
        if not isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        line = min([f.lineno, *(d.lineno for d in f.decorator_list)])
        own = tables.get((f.name, f.lineno)) or tables.get((f.name, line))
        symbols = own.get_symbols() if own else []
        local = {s.get_name() for s in symbols if s.is_local() and not s.is_imported() and not s.is_namespace()}
        why = next((reason for reason, holds in (
            ("nested_scope", own is None or any(isinstance(n, _SCOPES) for n in ast.walk(f) if n is not f)),
            ("global_nonlocal", any(isinstance(n, (ast.Global, ast.Nonlocal)) for n in ast.walk(f))),
            ("unsupported_binder", not _plain_binders(f)),
            ("kwarg_coupling", local & keywords or f.name in at_large),
            ("reads_names", any(isinstance(n, ast.Name) and n.id in _READS_NAMES for n in ast.walk(f))),
        ) if holds), None)
        if why:
            left[why] += 1
        else:
            out.append((f, [n for n in dict.fromkeys(name for _, name in _body_places(f)) if n in local and n not in ("self", "cls")]))
    return out, left


def _fresh(names: list[str], condition: str, taken: set[str], seed: str) -> dict[str, str]:
    """New names, none of them ``taken``, which grows; where a pool ends its names are numbered from 2."""
    pool = {"nouns": NOUNS, "index_names": INDEX_NAMES, "same": ["x"]}.get(condition)
    out: dict[str, str] = {}
    for n, old in enumerate(names):
        if condition == "same" and out:
            out[old] = next(iter(out.values()))
            continue
        base = [f"v{n + 1}"] if condition == "numbered" else [chr(97 + (n + i) % 26) for i in range(26)] if condition == "letters" else _hashed(f"{seed}:{n}", pool, len(pool))
        turns = (f"{b}{k}" if k > 1 else b for k in range(1, 2 + len(taken)) for b in base)
        out[old] = next(c for c in turns if c not in taken)
        taken.add(out[old])
    return out


def scope_edits(code: str, condition: str, targets: dict[str, set[str]] | None = None, seed: str = "") -> tuple[str | None, list[tuple[int, int, str]], str | None, dict[str, int]]:
    """(new code, edits (s, e, name), why dropped, functions left by reason): the local names of flat top-level functions renamed.

    ``same`` and ``index_names`` rename the ``targets`` (names by function) alone. A program is dropped if it does
    not parse (parse), has two functions of one name (duplicate_functions), none that can be renamed
    (no_renameable_function), nothing to rename (no_edits), a name not where the tree says (span_mismatch), or a
    result that does not compile (reparse_failed). But for ``same``, which makes several names one, the result runs as the program does.
    """
    if condition not in CONDITIONS:
        raise ValueError(f"no condition {condition}")
    try:
        tree, table = ast.parse(code), symtable.symtable(code, "<program>", "exec")
    except (SyntaxError, ValueError, RecursionError):
        return None, [], "parse", {}
    named = [n.name for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    if len(named) != len(set(named)):
        return None, [], "duplicate_functions", {}
    functions, left = flat_functions(tree, table)
    if not functions:
        return None, [], "no_renameable_function", left
    at, taken, edits = Lines(code), names_of(code) | set(keyword.kwlist) | set(dir(builtins)), []
    for f, local in functions:
        wanted = (targets or {}).get(f.name, set()) if condition in ("same", "index_names") else set(local)
        new = _fresh([n for n in local if n in wanted], condition, taken, f"{seed}:{condition}:{f.name}")
        for node, old in _body_places(f):
            if old in new and new[old] != old:
                s = at.offset(node.lineno, node.col_offset)
                if code[s : s + len(old)] != old:
                    return None, [], "span_mismatch", left
                edits.append((s, s + len(old), new[old]))
    if not edits:
        return None, [], "no_edits", left
    edits.sort()
    pieces, done = [], 0
    for s, e, name in edits:
        pieces += [code[done:s], name]
        done = e
    out = "".join([*pieces, code[done:]])
    try:
        compile(out, "<renamed>", "exec", dont_inherit=True)
    except (SyntaxError, ValueError):
        return None, edits, "reparse_failed", left
    return out, edits, None, left


@F.pandas_udf(T.StringType())
def renamed(code: pd.Series, strategy: pd.Series, seed: pd.Series, language: pd.Series) -> pd.Series:
    """Column form of :func:`rename`; null code stays null."""
    return pd.Series([None if c is None else rename(c, s, int(n or 0), lang) for c, s, n, lang in zip(code, strategy, seed, language, strict=True)])


_EDITS = T.ArrayType(T.StructType().add("s", "integer").add("e", "integer").add("repl", "string"))


@F.pandas_udf(T.StructType().add("new_code", "string").add("edits", _EDITS).add("dropped", "string").add("functions_left", T.MapType(T.StringType(), T.IntegerType())))
def scope_renamed(code: pd.Series, condition: pd.Series, targets: pd.Series, seed: pd.Series) -> pd.DataFrame:
    """Column form of :func:`scope_edits`; ``targets`` is an array of struct (function, variable). Null code counts as empty."""
    out = []
    for c, how, rows, n in zip(code, condition, targets, seed, strict=True):
        wanted: dict[str, set[str]] = {}
        for r in rows if rows is not None else ():
            wanted.setdefault(r["function"], set()).add(r["variable"])
        out.append(scope_edits(c or "", how, wanted, str(n)))
    return pd.DataFrame({"new_code": [o[0] for o in out], "edits": [[{"s": s, "e": e, "repl": r} for s, e, r in o[1]] for o in out], "dropped": [o[2] for o in out], "functions_left": [o[3] for o in out]})
