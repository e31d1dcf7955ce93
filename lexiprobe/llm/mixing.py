"""Operator 3, mixing sources to target weights by Poisson replication (DataFrame functions only).

Each source has a mean repetition rate: target rows / own rows. A uniform number hashed from seed,
document and part is pushed through the inverse Poisson distribution of that mean, the document is
exploded by the count, and the copies are dealt out and sorted by a hash of (document, copy), which
is a global shuffle. Nothing is gathered by source after the counts, so a hot source needs no salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiprobe.llm.shared import uniform

#: Means above this are split into equal independent parts (sums of Poisson numbers are Poisson).
PART_MEAN = 16.0
#: Terms of a part's distribution; beyond it less than 1e-40 is left.
TERMS = 96
#: Up to so many sources the table of rates (under 1 kB a source) is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 10_000
#: Parts over which the rows of one key are dealt.
SALTS = 4096


def poisson_cdf(mean: Column) -> Column:
    """P(X <= k) for k = 0 .. TERMS of a Poisson number X."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), F.array(first).alias("c"))
    step = lambda a, k: F.struct(
        (a.p * mean / k).alias("p"), F.concat(a.c, F.array(F.element_at(a.c, -1) + a.p * mean / k)).alias("c")
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)).cast("array<double>"), start, step, lambda a: a.c)


def source_rates(docs: DataFrame, weights: dict[str, float] | None, rows: int | None, source_col: str) -> tuple[DataFrame, int]:
    """Per source: mean, number of parts, CDF of a part; and the number of sources."""
    sizes = docs.groupBy(F.col(source_col).cast("string").alias("__source")).agg(F.count(F.lit(1)).alias("__n"))
    sources, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("__n"), F.lit(0))).first()
    if weights is None:
        share = F.lit(1.0 / max(1, sources))
    else:
        whole = sum(weights.values()) or 1.0
        table = F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, float(v) / whole))) if weights else None
        share = F.coalesce(F.try_element_at(table, F.coalesce(F.col("__source"), F.lit(""))), F.lit(0.0)) if weights else F.lit(0.0)
    mean = F.lit(float(total if rows is None else rows)) * share / F.col("__n")
    rates = sizes.select("__source", mean.alias("__mean")).filter("__mean > 0")
    rates = rates.withColumn("__parts", F.greatest(F.lit(1), F.ceil(F.col("__mean") / PART_MEAN)).cast("int"))
    return rates.withColumn("__cdf", poisson_cdf(F.col("__mean") / F.col("__parts"))).drop("__mean"), sources


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, rows: int | None = None, seed: int = 7, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` replicated so that sources get ``weights`` of about ``rows`` rows, in a globally shuffled order.

    ``weights`` (default: all sources alike) need not sum to 1; a source without a weight gets no
    rows. ``rows`` defaults to the number of input rows. All columns of ``docs`` return, with
    ``copy`` (from 1) and ``mix_key`` (the hash that orders the mixture); input columns of these
    two names are replaced. A null source is a source of its own (its weight is that of ''). Rows
    repeated with one id draw the same number and are still dealt to all partitions; rows without
    an id draw each their own, by their place in the input. Text is not looked at, so null, empty
    and very long ones are carried as they are. An empty table gives no rows.
    """
    rates, sources = source_rates(docs, weights, rows, source_col)
    if sources <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    row = docs.select(F.struct("*").alias("__row"), F.col(id_col).cast("string").alias("__doc"), F.col(source_col).cast("string").alias("__of"), F.monotonically_increasing_id().alias("__place"))
    row = row.withColumn("__doc", F.coalesce("__doc", F.concat(F.lit("null:"), "__place")))
    row = row.join(rates, F.col("__of").eqNullSafe(F.col("__source")))
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("__parts")),
        F.lit(0),
        lambda n, part: n + F.size(F.filter(F.col("__cdf"), lambda c: c <= uniform("copies", seed, F.col("__doc"), part))),
    )
    row = row.withColumn("__copies", count).filter("__copies > 0")
    row = row.select("__row", "__doc", F.pmod(F.xxhash64("__place"), F.lit(SALTS)).alias("__salt"), F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("copy"))
    key = F.substring(F.sha2(F.concat_ws(":", F.lit("order"), F.lit(str(seed)), F.col("__doc"), F.col("copy").cast("string")), 256), 1, 16)
    row = row.withColumn("mix_key", key).repartition("mix_key", "__salt").sortWithinPartitions("mix_key", "copy")
    kept = [F.col("__row").getField(c).alias(c) for c in docs.columns if c not in ("copy", "mix_key")]
    return row.select(*kept, "copy", "mix_key")


OP3_SQL = """
WITH RECURSIVE n AS (SELECT source, count(*) AS c FROM documents GROUP BY source),
m AS (SELECT source, (SELECT count(*) FROM documents)::DOUBLE * (1.0::DOUBLE / (SELECT count(*) FROM n)) / c AS mean FROM n),
p AS (SELECT source, greatest(1, ceil(mean / 16.0))::INT AS parts, mean / greatest(1, ceil(mean / 16.0))::INT AS part FROM m),
cdf AS (SELECT source, part, 0 AS k, exp(-part) AS t, exp(-part) AS c FROM p
  UNION ALL SELECT source, part, k + 1, t * part / (k + 1), c + t * part / (k + 1) FROM cdf WHERE k < 96),
u AS (SELECT d.doc_id, d.source, ('0x' || substr(sha256('copies:7:' || d.doc_id || ':' || j), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents d JOIN p ON d.source IS NOT DISTINCT FROM p.source, range(1, p.parts + 1) r(j)),
k AS (SELECT u.doc_id, count(*)::INT AS copies FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= u.u GROUP BY u.doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, i::INT AS copy,
       substr(sha256('order:7:' || d.doc_id || ':' || i), 1, 16) AS mix_key
FROM documents d JOIN k USING (doc_id), range(1, k.copies + 1) r2(i)
"""


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources alike, as many rows as there are documents."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
