"""Which roles the names of a program play: from the syntax tree for Python, by patterns for brace languages."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The roles and languages of the data.
ROLES = ("index_key", "accumulator", "iterator", "boolean", "class_struct")
PATTERN_LANGUAGES = ("Java", "C++", "C", "C#", "Javascript", "PHP")

# Words that are never names, by language.
_C_WORDS = "int long char short float double unsigned void size_t bool true false null NULL return if else for while break continue sizeof static const"
KEYWORDS = {
    "C": _C_WORDS.split(),
    "C++": _C_WORDS.split(),
    "Java": f"{_C_WORDS} byte boolean String Integer Long Object new public private final class".split(),
    "C#": f"{_C_WORDS} byte string object var new public private using class".split(),
    "Javascript": "undefined null true false NaN Infinity length prototype constructor var let const function new return if else for while of in typeof".split(),
    "PHP": "true false null function return if else for foreach while as echo array new".split(),
}

# Patterns whose groups are names.
_NAME = r"([a-zA-Z_]\w*)"
SUBSCRIPT = rf"\[\s*{_NAME}\s*\]"
ACCUMULATE = (rf"\b{_NAME}\s*(?:\+=|-=|\*=|/=|\|=|&=|\^=)", rf"\b{_NAME}\s*(?:\+\+|--)", rf"\b{_NAME}\.(?:add|push|append|extend|offer)\s*\(")
BOOLEAN = rf"\b{_NAME}\s*=\s*(?:true|false)\b"
CLASS = rf"\b(?:class|struct)\s+{_NAME}"
FOR_INIT = rf"for\s*\(\s*(?:[a-zA-Z_][\w<>\[\],\s]*\s+)?{_NAME}\s*="
FOR_EACH = rf"for(?:each)?\s*\(\s*[\w<>\[\],\s]+?\s{_NAME}\s*(?::|\bin\b)"
JS_FOR = rf"for\s*\(\s*(?:var|let|const)\s+{_NAME}\s*(?:=|\bof\b|\bin\b)"
PHP_EACH = r"foreach\s*\([^)]*?\bas\b\s*(?:&?\s*(\w+)\s*=>\s*)?&?\s*(\w+)"


def pattern_roles(code: Column, language: str) -> Column:
    """Map of role to sorted names, in Catalyst alone."""
    if language not in KEYWORDS:
        raise ValueError(f"no patterns for {language}")
    if language == "PHP":
        code = F.regexp_replace(code, r"\$\s*([a-zA-Z_]\w*)", "$1")
    none = F.array(*(F.lit(w) for w in KEYWORDS[language]))

    def names(*patterns: tuple[str, int] | str) -> Column:
        found = [F.regexp_extract_all(code, F.lit(p if isinstance(p, str) else p[0]), F.lit(1 if isinstance(p, str) else p[1])) for p in patterns]
        return F.array_sort(F.array_except(F.filter(F.array_distinct(F.flatten(F.array(*found))), lambda x: x != ""), none))

    loops = {"PHP": (FOR_INIT, (PHP_EACH, 1), (PHP_EACH, 2)), "Javascript": (JS_FOR, FOR_INIT)}.get(language, (FOR_INIT, FOR_EACH))
    found = {"index_key": names(SUBSCRIPT), "accumulator": names(*ACCUMULATE), "iterator": names(*loops), "boolean": names(BOOLEAN), "class_struct": names(CLASS)}
    return F.create_map(*(x for role in ROLES for x in (F.lit(role), found[role])))


def patterns_of(language: str) -> dict[str, tuple[str, ...]]:
    """The patterns of each role; every group is a name."""
    loops = {"PHP": (FOR_INIT, PHP_EACH), "Javascript": (JS_FOR, FOR_INIT)}.get(language, (FOR_INIT, FOR_EACH))
    return {"index_key": (SUBSCRIPT,), "accumulator": ACCUMULATE, "iterator": loops, "boolean": (BOOLEAN,), "class_struct": (CLASS,)}


def python_roles(code: str | None) -> dict[str, list[str]]:
    """Roles of a Python program; one that does not parse has none.

    A subscript counts where it is a name and nothing more. Accumulators are augmented, or fed by a statement that
    calls a collecting method, inside a for or while loop, and are neither loop variables nor subscripts.
    """
    try:
        nodes = list(ast.walk(ast.parse(code or "")))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return {r: [] for r in ROLES}
    found: dict[str, set[str]] = {r: set() for r in ROLES}
    fed: set[str] = set()
    for node in nodes:
        match node:
            case ast.Subscript(slice=ast.Name(id=name)):
                found["index_key"].add(name)
            case ast.ClassDef(name=name):
                found["class_struct"].add(name)
            case ast.Assign(targets=targets, value=ast.Constant(value=bool())):
                found["boolean"] |= {t.id for t in targets if isinstance(t, ast.Name)}
            case ast.AnnAssign(target=ast.Name(id=name), value=ast.Constant(value=bool())):
                found["boolean"].add(name)
            case ast.For(target=target):
                found["iterator"] |= {n.id for n in ast.walk(target) if isinstance(n, ast.Name)}
        if isinstance(node, (ast.For, ast.While)):
            for inner in ast.walk(node):
                match inner:
                    case ast.AugAssign(target=ast.Name(id=name)) | ast.Expr(value=ast.Call(func=ast.Attribute(value=ast.Name(id=name), attr="append" | "extend" | "add" | "update"))):
                        fed.add(name)
    found["accumulator"] = fed - found["iterator"] - found["index_key"] - {"_"}
    found["iterator"] -= {"_"}
    return {r: sorted(v) for r, v in found.items()}


@F.pandas_udf(T.MapType(T.StringType(), T.ArrayType(T.StringType())))
def python_roles_column(code: pd.Series) -> pd.Series:
    return code.map(python_roles)


def roles_of(code: Column, language: Column) -> Column:
    """By the row's language; a language that is not known gives null."""
    out = F.when(language == "Python", python_roles_column(F.when(language == "Python", code)))
    for name in PATTERN_LANGUAGES:
        out = out.when(language == name, pattern_roles(code, name))
    return out
