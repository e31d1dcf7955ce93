"""The engine's functions in SQL: scalar functions under their names, and table functions over program tables.

``register(spark)`` makes them known to a session. Table functions take the program as arguments of a
lateral join, or a whole table: ``SELECT * FROM program_names(TABLE(programs) PARTITION BY problem_id)``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiprobe.functions import flags, rename, sites, trees
from lexiprobe.functions import text as X


def supported(language: str | None) -> bool:
    return language == "Python" or language in trees.LANGUAGES


class FlagOccurrences:
    """flag_occurrences(code, language): the places of a program's boolean flags; none for languages without a grammar."""

    def eval(self, code: str, language: str) -> Iterator[tuple]:
        if supported(language):
            yield from (tuple(r.values()) for r in flags.occurrence_rows(code, language))


class TreeNodes:
    """tree_nodes(code, language): id, parent, kind, text, s and e of the nodes of a program's tree."""

    def eval(self, code: str, language: str) -> Iterator[tuple]:
        if language in trees.LANGUAGES:
            yield from (tuple(r.values()) for r in trees.node_rows(code, language))


class Identifiers:
    """identifiers(code): name, s and e of everything that looks like a name, in order."""

    def eval(self, code: str) -> Iterator[tuple]:
        for m in sites._IDENTIFIER.finditer(code or ""):
            yield m[0], m.start(), m.end()


class ProgramNames:
    """program_names(TABLE(t) PARTITION BY problem_id): how many of a problem's programs have each identifier, over all its rows."""

    def __init__(self):
        self.programs, self.names, self.problem = 0, {}, None

    def eval(self, row: Row) -> None:
        self.problem, self.programs = str(row["problem_id"]), self.programs + 1
        for name in {m[0] for m in sites._IDENTIFIER.finditer(row["code"] or "")}:
            self.names[name] = self.names.get(name, 0) + 1

    def terminate(self) -> Iterator[tuple]:
        for name, n in sorted(self.names.items()):
            yield self.problem, name, n, self.programs


_IDENTIFIER = T.StructType().add("name", "string").add("s", "integer").add("e", "integer")
_NAMES = T.StructType().add("problem_id", "string").add("name", "string").add("programs", "integer").add("of", "integer")
#: name: (class, row type).
TABLE_FUNCTIONS = {
    "flag_occurrences": (FlagOccurrences, flags._struct(flags._COLUMNS)), "tree_nodes": (TreeNodes, trees._NODE), "identifiers": (Identifiers, _IDENTIFIER), "program_names": (ProgramNames, _NAMES),
}
#: name: column function of pandas.
SCALAR_FUNCTIONS = {
    "statement_span": X.statement_span, "scope_renamed": rename.scope_renamed, "renamed": rename.renamed, "constant_labels": sites.constant_labels, "function_records": sites.records, "top_level_names": sites.top_level_names,
    "variable_places": sites.variable_places, "scope_facts": sites.scope_facts,
}


def register(spark: SparkSession) -> list[str]:
    """Registers all functions; their names."""
    for name, function in SCALAR_FUNCTIONS.items():
        spark.udf.register(name, function)
    for name, (cls, kind) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(cls, returnType=kind))
    return sorted([*SCALAR_FUNCTIONS, *TABLE_FUNCTIONS])
