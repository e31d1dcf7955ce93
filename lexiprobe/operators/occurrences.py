"""Identifier occurrences: ids, duplicates, conflicts, edit sites and cases, label cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiprobe.functions.roles import ROLES


def occurrence_ids(rows: DataFrame, program: str, language: Column, function: str, variable: str, order: str) -> DataFrame:
    """Adds occurrence_id program:lang:f<i>:b<j>:o<k>: functions by first row, variables by first appearance in theirs, running index."""
    one_f, one_v = W.partitionBy(program, function), W.partitionBy(program, function, variable)
    rows = rows.withColumn("__ff", F.min(order).over(one_f)).withColumn("__fv", F.min(order).over(one_v))
    f = F.dense_rank().over(W.partitionBy(program).orderBy("__ff")) - 1
    b = F.dense_rank().over(W.partitionBy(program, function).orderBy("__fv")) - 1
    o = F.row_number().over(one_v.orderBy(order)) - 1
    text = F.concat(F.col(program).cast("string"), F.lit(":"), language, F.lit(":f"), f.cast("string"), F.lit(":b"), b.cast("string"), F.lit(":o"), o.cast("string"))
    return rows.withColumn("occurrence_id", text).drop("__ff", "__fv")


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, in file order (a plain drop of duplicates would keep any)."""
    from lexiprobe.operators.joins import wins

    ranked = rows.withColumn("__order", F.struct(*order))
    return wins(ranked, key, "__order", last=False).drop("__order")


def conflict_free(rows: DataFrame, span: list[str], label: str, order: str) -> DataFrame:
    """One row a span, of spans whose rows all have one label."""
    kept = [c for c in rows.columns if c not in span]
    one = rows.groupBy(*span).agg(F.min(label).alias("__a"), F.max(label).alias("__b"), F.min_by(F.struct(*kept), F.col(order)).alias("__r"))
    return one.filter("__a = __b").select(*span, *(F.col("__r")[c].alias(c) for c in kept))


def cases(rows: DataFrame, scope: list[str], name: str, role: str, start: str) -> DataFrame:
    """Per scope and target name: its edit sites (all starts but the last), readout (the last), and the
    smallest distractor of another role, and of the same, that starts before the readout."""
    per = rows.groupBy(*scope, name, role).agg(F.array_sort(F.collect_list(start)).alias("starts"))
    t, d = per.alias("t"), per.alias("d")
    both = t.join(d, [F.col(f"t.{c}") == F.col(f"d.{c}") for c in scope])
    both = both.filter((F.col(f"t.{name}") != F.col(f"d.{name}")) & (F.col("d.starts")[0] < F.element_at("t.starts", -1)) & (F.size("t.starts") > 1))
    other = F.col(f"t.{role}") != F.col(f"d.{role}")
    out = both.groupBy(*(F.col(f"t.{c}").alias(c) for c in scope), F.col(f"t.{name}").alias("target")).agg(
        F.first("t.starts").alias("__s"), F.min(F.when(other, F.col(f"d.{name}"))).alias("distractor"), F.min(F.when(~other, F.col(f"d.{name}"))).alias("same_role")
    )
    return out.select(*scope, "target", F.expr("slice(__s, 1, size(__s) - 1)").alias("edit_sites"), F.element_at("__s", -1).alias("readout"), "distractor", "same_role")


def drop_reasons(rows: DataFrame, gates: list[tuple[str, Column]], duplicate_key: list[str], order: str) -> DataFrame:
    """Adds drop_reason: the first failing gate, or 'duplicate' of an earlier row that passed all gates, or null.

    A key counts as seen only once a row with it has passed, so copies of failed rows are judged anew.
    """
    reason = F.lit(None).cast("string")
    for name, fails in reversed(gates):
        reason = F.when(F.coalesce(fails, F.lit(False)), name).otherwise(reason)
    rows = rows.withColumn("drop_reason", reason)
    first = F.min(F.when(F.col("drop_reason").isNull(), F.col(order))).over(W.partitionBy(*duplicate_key))
    return rows.withColumn("drop_reason", F.when(F.col("drop_reason").isNull() & (F.col(order) > first), "duplicate").otherwise(F.col("drop_reason")))


def cost_ledger(rows: DataFrame, phase: str, elapsed: str, hourly: str, order: str, budget: float) -> DataFrame:
    """Adds billed seconds (a minute at least, 15 % on top), cost (12 decimals), running total within the phase and whether it is over budget."""
    from lexiprobe.operators.splits import running

    rows = rows.withColumn("billed_s", F.greatest(F.lit(60.0), F.col(elapsed)) * 1.15).withColumn("usd", (F.col("billed_s") / 3600.0 * F.col(hourly)).cast("decimal(28,12)"))
    rows = running(rows, [phase], [F.col(order)], F.col("usd"), "__before").withColumn("running_usd", F.col("__before") + F.col("usd")).drop("__before")
    return rows.withColumn("over_budget", F.col("running_usd") > F.lit(budget))


def resampled_labels(rows: DataFrame, label: str, key: str, within: list[str], seed: int) -> DataFrame:
    """A control: labels of each group (of all rows, if ``within`` is empty) dealt anew among its rows, in hash order; ``key`` is unique.

    Rows are numbered over range partitions, so no group fills a task.
    """
    from lexiprobe.operators.splits import hash_unit, running

    a = running(rows, within, [F.col(key)], F.lit(1), "__n")
    dealt = rows.select(*within, F.col(key).alias("__key"), F.col(label).alias("control_label"), hash_unit(F.col(key), seed).alias("__u"))
    b = running(dealt, within, [F.col("__u"), F.col("__key")], F.lit(1), "__n").drop("__u", "__key")
    return a.join(b, [*within, "__n"]).drop("__n")


def label_by_name(rows: DataFrame, name: str, label: str, seed: int) -> DataFrame:
    """A control: each name gets one label, drawn by hash from the labels' shares."""
    from lexiprobe.operators.splits import hash_unit

    share = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = W.orderBy(label).rowsBetween(W.unboundedPreceding, 0)  # one row a class
    cdf = share.select(F.col(label).alias("control_label"), (F.sum("n").over(total) / F.sum("n").over(W.partitionBy())).alias("upto"))
    steps = cdf.agg(F.array_sort(F.collect_list(F.struct("upto", "control_label"))).alias("steps"))
    names = rows.select(name).distinct().crossJoin(F.broadcast(steps)).withColumn("u", hash_unit(F.col(name), seed))
    names = names.select(name, F.coalesce(F.filter("steps", lambda s: s["upto"] >= F.col("u"))[0]["control_label"], F.element_at("steps", -1)["control_label"]).alias("control_label"))
    return rows.join(names, name)


# --- programs ---------------------------------------------------------------------------------------


def program_occurrences(programs: DataFrame, program: str = "problem_id") -> DataFrame:
    """The flag occurrences of programs (program, language, code): spans that hold their name, one row a span whose rows agree, with ids."""
    from lexiprobe.functions.flags import occurrences
    from lexiprobe.functions.text import span_holds

    rows = programs.select(program, "language", "code", F.posexplode(occurrences("code", "language")).alias("ord", "o")).select(program, "language", "code", "ord", "o.*")
    rows = rows.filter(span_holds(F.col("code"), F.col("s"), F.col("e"), F.col("variable"))).drop("code")
    rows = conflict_free(rows, [program, "function", "variable", "s", "e"], "occurrence_type", "ord")
    keyed = rows.withColumn("__f", F.concat_ws(":", "function_line", "function")).withColumn("__o", F.struct("line", "col_offset", "ord"))
    return occurrence_ids(keyed, program, F.col("language"), "__f", "variable", "__o").drop("__f", "__o", "ord")


def role_site_rows(programs: DataFrame, program: str = "problem_id", roles: tuple[str, ...] = ROLES, drop_shared: bool = True) -> DataFrame:
    """Every place in code of every name that has one of ``roles`` in the scope of the place: program, language, role, variable, scope, function, span.

    A scope is the innermost function around; its roles follow from what its own text does with the name, the
    module's from all of the program. Names with several roles in a scope are dropped (unless ``drop_shared`` is off),
    and so are names that blocks, loop headers and parameters of a scope bind more than once: several variables of one
    spelling. Programs are read once; facts and places meet in one shuffle by program, scope and name.
    """
    from lexiprobe.functions.sites import scope_facts

    rows = programs.select(program, "language", F.explode(scope_facts("code", "language")).alias("o")).select(program, "language", "o.*")
    one = W.partitionBy(program, "scope", "variable")
    rows = rows.withColumn("__f", F.collect_set("fact").over(one)).withColumn("__n", F.sum((F.col("fact") == "declared").cast("int")).over(one)).filter("s IS NOT NULL")
    has = lambda f: F.array_contains("__f", f)
    ignored = (F.col("language") == "Python") & (F.col("variable") == "_")
    fed = has("accumulator") | (has("fed") & ~has("iterator") & ~has("index_key"))
    holds = {"index_key": has("index_key"), "accumulator": fed & ~ignored, "iterator": has("iterator") & ~ignored, "boolean": has("boolean"), "class_struct": has("class_struct")}
    rows = rows.withColumn("__r", F.array_compact(F.array(*(F.when(holds[r], r) for r in ROLES)))).filter(F.coalesce("__n", F.lit(0)) <= 1)
    if drop_shared:
        rows = rows.filter(F.size("__r") == 1)
    rows = rows.select(program, "language", F.explode("__r").alias("role"), "variable", F.col("span").alias("scope"), "function", "scope_known", "s", "e", "line", "col_offset", "end_col_offset")
    return rows.filter(F.col("role").isin(*roles))


def role_occurrence_rows(programs: DataFrame, program: str = "problem_id") -> DataFrame:
    """The places of all role names of programs, with ids: variables by first appearance within the program and role, running index."""
    rows = role_site_rows(programs, program)
    one = W.partitionBy(program, "role", "variable")
    rows = rows.withColumn("__first", F.min("s").over(one))
    b = F.dense_rank().over(W.partitionBy(program, "role").orderBy("__first")) - 1
    o = F.row_number().over(one.orderBy("s")) - 1
    return rows.withColumn("occurrence_id", F.concat_ws(":", F.col(program).cast("string"), "language", F.lit("f0"), F.concat(F.lit("b"), b), F.concat(F.lit("o"), o))).drop("__first")


# --- label cleaning and freezing ----------------------------------------------------------------------

# What a label row must have, and the least lines and places of what it labels.
LABEL_FIELDS, MIN_LINES, MIN_PLACES = ("repo", "path", "function", "variable"), 5, 2


def _with_code(records: DataFrame, canonical: DataFrame) -> DataFrame:
    """Adds idx (source_row as a number) and code: by idx where a row names one, else the first of its (repo, path)."""
    from lexiprobe.operators.joins import lookup_two_ways, wins

    first = wins(canonical.select("repo", "path", "idx", "code"), ["repo", "path"], "idx", last=False).select("repo", "path", "code")
    rows = records.withColumn("idx", F.expr("try_cast(source_row AS BIGINT)")).withColumn("__key", F.when(F.col("source_row").isNotNull(), F.coalesce("idx", F.lit(-1))))
    return lookup_two_ways(rows, canonical.select(F.col("idx").alias("__key"), "code"), first, "__key", ["repo", "path"], "code").drop("__key")


def _label_gates() -> list[tuple[str, Column]]:
    missing = F.lit(False)
    for c in LABEL_FIELDS:
        missing = missing | F.coalesce(F.col(c) == "", F.lit(True))
    return [("parse_error", F.coalesce(F.col("parse_error") != "", F.lit(False))), ("non_boolean", F.coalesce(F.col("role") != "boolean_flag", F.lit(True))), ("missing_fields", missing)]


def clean_labels(records: DataFrame, canonical: DataFrame, order: str) -> DataFrame:
    """Label rows with drop_reason: the first of twelve that holds, or null for those that stay.

    ``canonical``: idx, repo, path, code. A row repeats another of its (source row or repository and path, function,
    variable) only where that one has passed.
    """
    from lexiprobe.functions.sites import top_level_names, variable_places
    from lexiprobe.functions.text import full_lines, generated, notebook

    rows = _with_code(records, canonical).withColumn("__names", top_level_names("code")).withColumn("__places", variable_places("code", "function", "variable"))
    gates = [
        *_label_gates(), ("bad_source_row", F.col("source_row").isNotNull() & F.col("idx").isNull()), ("missing_canonical", F.col("code").isNull()), ("notebook_artifact", notebook(F.col("path"), F.col("code"))),
        ("autogenerated", generated(F.col("code"))), ("malformed_canonical", F.col("__names").isNull()), ("no_matching_function", ~F.array_contains("__names", F.col("function"))),
        ("short_function", full_lines(F.col("code")) < MIN_LINES), ("variable_few_occurrences", F.coalesce(F.size("__places"), F.lit(0)) < MIN_PLACES),
    ]
    key = F.when(F.col("idx").isNotNull(), F.struct(F.lit("").alias("repo"), F.lit("").alias("path"), "idx")).otherwise(F.struct("repo", "path", F.lit(-1).cast("long").alias("idx")))
    return drop_reasons(rows.withColumn("__dk", key), gates, ["__dk", "function", "variable"], order).drop("__dk", "__names", "__places")


def freeze_labels(records: DataFrame, canonical: DataFrame, splits: DataFrame) -> DataFrame:
    """Label rows with their repository's split, the variable's places, and skip_reason: the first of eight that holds, or null. ``splits``: repo, split."""
    from lexiprobe.functions.sites import top_level_names, variable_places

    rows = _with_code(records, canonical).join(splits, "repo", "left").withColumn("__names", top_level_names("code"))
    gates = [
        *_label_gates(), ("repo_not_in_split", F.col("split").isNull()), ("bad_source_row", F.col("source_row").isNotNull() & F.col("idx").isNull()), ("missing_code", F.col("code").isNull()),
        ("bad_code", F.col("__names").isNull()), ("no_function", ~F.array_contains("__names", F.col("function"))),
    ]
    reason = F.lit(None).cast("string")
    for name, fails in reversed(gates):
        reason = F.when(F.coalesce(fails, F.lit(False)), name).otherwise(reason)
    return rows.withColumn("skip_reason", reason).withColumn("places", variable_places("code", "function", "variable")).drop("__names")
