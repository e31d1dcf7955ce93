"""Paired prompts as a factorial of small tables, with character spans, a canonical payload and its checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# This engine's own prompt material.
PREFIXES = ("", "# module notes\n", "import math\n\n", "limit = 10\n\n")
BODIES = ("    pass\n", "    x = 1\n", "    note = 'ready'\n")
GAPS = ("", "\n# later\n", "\nvalue = 3\n", "\nstep = limit_of(2)\n")
NAMES = tuple(f"{a}{b}" for a in ("Amber", "Birch", "Cedar", "Delta", "Ember", "Fjord") for b in ("Node", "Unit", "Card", "Ring"))
LEXICAL = 6


def literal_table(spark: SparkSession, name: str, values: tuple[str, ...]) -> DataFrame:
    items = F.array(*(F.lit(v) for v in values))
    return spark.range(1).select(F.posexplode(items).alias(f"{name}_id", name))


def prompt_pairs(spark: SparkSession) -> DataFrame:
    """288 pairs: 48 clusters (prefix x body x gap) by 6 names; class and function versions with the name's spans."""
    grid = literal_table(spark, "prefix", PREFIXES).crossJoin(literal_table(spark, "body", BODIES)).crossJoin(literal_table(spark, "gap", GAPS))
    grid = grid.withColumn("cluster_id", (F.col("prefix_id") * len(BODIES) + F.col("body_id")) * len(GAPS) + F.col("gap_id"))
    grid = grid.withColumn("lexical_variant", F.explode(F.sequence(F.lit(0), F.lit(LEXICAL - 1))))
    names = F.array(*(F.lit(n) for n in NAMES))
    # each name serves as often as any other: 288 / 24 = 12 times
    grid = grid.withColumn("name", F.element_at(names, F.pmod(F.col("cluster_id") * LEXICAL + F.col("lexical_variant"), F.lit(len(NAMES))) + 1))

    def prompt(word: str) -> Column:
        return F.concat("prefix", F.lit(f"{word} "), "name", F.lit(":\n" if word == "class" else "():\n"), "body", "gap", F.lit("item = "), "name")

    rows = grid.select("cluster_id", "prefix_id", "body_id", "gap_id", "lexical_variant", "name", prompt("class").alias("clean_prompt"), prompt("def").alias("corrupt_prompt"))
    pair = F.concat_ws("-", F.lit("pair"), F.lpad(F.col("cluster_id").cast("string"), 2, "0"), F.col("lexical_variant").cast("string"))

    def spans(word: str, col: str) -> list[Column]:
        at = F.locate(f"{word} ", F.col(col)) - 1 + len(word) + 1
        return [at.alias(f"{word}_decl_s"), (at + F.length("name")).alias(f"{word}_decl_e"), (F.length(col) - F.length("name")).alias(f"{word}_query_s"), F.length(col).alias(f"{word}_query_e")]

    return rows.select(pair.alias("pair_id"), "*", *spans("class", "clean_prompt"), *spans("def", "corrupt_prompt"))


def decoded_cluster(cluster_id: Column) -> Column:
    """prefix_id, body_id and gap_id of a cluster's number, which counts gaps first, then bodies, then prefixes; null outside of its range."""
    bodies, gaps = len(BODIES), len(GAPS)
    parts = F.struct((F.floor(cluster_id / (bodies * gaps))).cast("int").alias("prefix_id"), F.pmod(F.floor(cluster_id / gaps), F.lit(bodies)).cast("int").alias("body_id"), F.pmod(cluster_id, F.lit(gaps)).cast("int").alias("gap_id"))
    return F.when((cluster_id >= 0) & (cluster_id < len(PREFIXES) * bodies * gaps), parts)


def balance(rows: DataFrame, factors: list[str]) -> DataFrame:
    """factor, level, n in one GROUPING SETS pass."""
    sets = ", ".join(f"({f})" for f in factors)
    pick = " ".join(f"WHEN grouping({f}) = 0 THEN '{f}'" for f in factors)
    level = ", ".join(f"CAST({f} AS STRING)" for f in factors)
    rows.createOrReplaceTempView("__balance")
    return rows.sparkSession.sql(f"SELECT CASE {pick} END AS factor, coalesce({level}) AS level, count(*) AS n FROM __balance GROUP BY GROUPING SETS ({sets})")


def canonical_payload(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row: sha256 of the rows as compact JSON lines with sorted keys, in order. For small frozen tables (it is one string)."""
    line = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    lines = rows.select(F.struct(*order, line.alias("__line")).alias("r")).agg(F.array_sort(F.collect_list("r")).alias("rs"))
    text = F.concat(F.array_join(F.transform("rs", lambda r: r["__line"]), "\n"), F.lit("\n"))
    return lines.select(F.sha2(text, 256).alias("sha256"), F.size("rs").cast("long").alias("n"))


def check_frozen(rows: DataFrame, expected: DataFrame, key: str) -> list[str]:
    """Keys whose row is not exactly the expected one, at most ten."""
    differ = rows.exceptAll(expected.select(*rows.columns)).select(key).union(expected.select(*rows.columns).exceptAll(rows).select(key)).distinct()
    return [r[0] for r in differ.orderBy(key).limit(10).collect()]
