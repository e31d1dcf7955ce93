"""Scope-correct renaming of a corpus, with the occurrences carried through the edits and checked by reading the new programs again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiprobe.functions.rename import scope_renamed
from lexiprobe.operators.joins import shift_spans


def rename_scopes(programs: DataFrame, occurrences: DataFrame, condition: str, program: str = "problem_id") -> DataFrame:
    """``programs`` (program, language, code) with new_code, edits, dropped and functions_left; those without occurrences are not considered.

    The targets of a program are the (function, variable) of its occurrences. Only Python is renamed: others are dropped as ``language``.
    """
    targets = occurrences.groupBy(program).agg(F.collect_set(F.struct("function", "variable")).alias("__targets"))
    python = F.when(F.col("language") == "Python", F.col("code"))
    rows = programs.join(targets, program).withColumn("__r", scope_renamed(python, F.lit(condition), F.col("__targets"), F.col(program).cast("string")))
    dropped = F.when(F.col("language") != "Python", "language").otherwise(F.col("__r.dropped"))
    return rows.select(*programs.columns, F.when(dropped.isNull(), F.col("__r.new_code")).alias("new_code"), "__r.edits", dropped.alias("dropped"), "__r.functions_left")


def carry_occurrences(renamed: DataFrame, occurrences: DataFrame, program: str = "problem_id") -> DataFrame:
    """Occurrences of the programs that were renamed, where they stand in the new code: s, e, variable and original_variable.

    A span that an edit touches in part has null s and e.
    """
    rows = occurrences.join(renamed.filter("dropped IS NULL").select(program, "new_code", "edits"), program)
    rows = rows.withColumn("__to", shift_spans(F.col("s"), F.col("e"), F.col("edits"))).withColumn("original_variable", F.col("variable"))
    own = F.filter("edits", lambda x: (x["s"] == F.col("s")) & (x["e"] == F.col("e")))
    rows = rows.withColumn("variable", F.coalesce(F.get(own, F.lit(0))["repl"], F.col("variable")))
    return rows.withColumns({"s": F.col("__to.s").cast("int"), "e": F.col("__to.e").cast("int")}).drop("__to", "edits")


def identity_gate(carried: DataFrame, extract: Callable[[DataFrame], DataFrame], label: str, program: str = "problem_id") -> DataFrame:
    """``carried`` of the programs all of whose rows hold: the new code has the variable at the span, and ``extract`` finds it there with the same label."""
    new = carried.groupBy(program).agg(F.first("language").alias("language"), F.first("new_code").alias("code"))
    found = extract(new).select(program, "s", "e", label).distinct()
    held = F.coalesce(F.expr("substring(new_code, s + 1, e - s) = variable"), F.lit(False))
    sites = carried.select(program, F.when(held, F.col("s")).alias("s"), "e", label)
    bad = sites.join(found, [program, "s", "e", label], "left_anti").select(program).distinct()
    return carried.join(bad, program, "left_anti")


def renaming_flow(programs: DataFrame, occurrences: DataFrame, condition: str, extract: Callable[[DataFrame], DataFrame], label: str = "occurrence_type", program: str = "problem_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(programs with new_code and dropped, carried occurrences, counts of programs by outcome).

    ``extract`` is what made ``occurrences``; ids travel with the spans. A program whose new code does not show every
    carried occurrence with its label is dropped as ``identity``. Outcomes: kept, or why dropped. What several results read is
    kept (in memory, else on disk), so that each program is read, renamed and read again once.
    """
    programs = programs.persist()
    occurrences = occurrences.persist()
    renamed = rename_scopes(programs, occurrences, condition, program).persist()
    carried = carry_occurrences(renamed, occurrences, program).persist()
    kept = identity_gate(carried, extract, label, program)
    whole = kept.select(program).distinct().withColumn("__kept", F.lit(True))
    renamed = renamed.join(whole, program, "left").withColumn("dropped", F.coalesce("dropped", F.when(F.col("__kept").isNull(), "identity"))).drop("__kept")
    renamed = renamed.withColumn("new_code", F.when(F.col("dropped").isNull(), F.col("new_code")))
    counts = renamed.groupBy(F.coalesce("dropped", F.lit("kept")).alias("outcome")).agg(F.count(F.lit(1)).alias("programs"), F.sum(F.aggregate(F.coalesce(F.map_values("functions_left"), F.array().cast("array<int>")), F.lit(0), lambda a, x: a + x)).alias("functions_left"))
    return renamed, kept.drop("new_code"), counts
