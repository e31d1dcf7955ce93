"""Operator 2, exact dedup: a persistent digest index, bucketed and sorted by hash.

New data is digested (SHA-256 of the normalised text), sort-merge anti-joined with the index and
what is new is appended. The index holds one row per distinct text, so its buckets have no hot key;
copies are collapsed by partial aggregation before any shuffle by digest, and in the only join that
sees every row the texts with the most copies meet their group through a small broadcast table.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiprobe.llm.shared import WHITE, cut, fresh_path, spread_join

#: Digests of a bucket of a fresh index (about 100 bytes each), and Spark's bound of buckets.
BUCKET_ROWS, MOST_BUCKETS = 1_000_000, 100_000


def text_sha256(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text with each run of white space as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE, " "), 256)


class DigestIndex:
    """A bucketed, sorted parquet table at ``path``: digest, keep_id, batch. Opening an existing path resumes it.

    The number of buckets belongs to the path and is noted beside it when the index is made: ``buckets``, or
    enough for ``rows`` digests (name those of all batches to come). Appending is idempotent: a batch that
    was appended already adds no digest again.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, rows: int = 64 * BUCKET_ROWS):
        note = f"{path.rstrip('/')}-buckets"
        try:
            known = int(spark.read.text(note).first()[0])
        except AnalysisException:  # no such path: a new index
            known = buckets or max(8, min(MOST_BUCKETS, -(-rows // BUCKET_ROWS)))
            spark.createDataFrame([(str(known),)], "value string").coalesce(1).write.text(note)
        if buckets not in (None, known):
            raise ValueError(f"the index at {path} has {known} buckets, not {buckets}")
        self.spark, self.path, self.buckets = spark, path, known
        self.table = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest STRING, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {known} BUCKETS LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def forget(self) -> None:
        """Takes the table's name out of the catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def append_new(self, groups: DataFrame, batch: str) -> None:
        """Add the digests of ``groups`` (digest, keep_id) that the index does not hold."""
        new = groups.join(self.read().hint("merge"), "digest", "left_anti")
        (
            new.select("digest", "keep_id", F.lit(batch).alias("batch"))
            .repartition(self.buckets, "digest")
            .sortWithinPartitions("digest")
            .write.format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .mode("append")
            .option("path", self.path)
            .saveAsTable(self.table)
        )


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str = "batch-0", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Without ``index`` a fresh one is made in the checkpoint folder. A text that an earlier batch of
    the index holds is dropped in favour of that batch's keep_id; group_size counts this batch.

    Null text counts as empty. A null id is larger than all others (a group of null ids alone keeps
    one of its rows under keep_id null). Of rows repeated with the same id and text one is kept.
    An empty table gives no rows. Other columns of ``docs`` are ignored whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_sha256(F.col(text_col)).alias("digest"))
    rows = cut(rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("times")))
    n = rows.count()
    own = DigestIndex(spark, fresh_path(spark, "digest-index"), rows=n) if index is None else index
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.sum("times").alias("group_size"), F.count(F.lit(1)).alias("members"))
    own.append_new(groups.select("digest", "keep_id"), batch)
    groups = cut(groups.drop("keep_id").join(own.read().hint("merge"), "digest"))
    if index is None:
        own.forget()
    mine = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("batch") == batch)
    return (
        spread_join(rows, groups, "digest", "members", n)
        .select("doc_id", "keep_id", "group_size", mine.alias("mine"), "digest", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth"))
        .select("doc_id", "keep_id", "group_size", (F.col("mine") & (F.col("nth") == 1)).alias("kept"), F.col("digest").alias("text_sha256"))
    )


def keep_first_texts(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns."""
    kept = exact_dedup(docs, **how).filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__digest"))
    row = docs.select(F.struct("*").alias("__row"), F.col("doc_id").cast("long").alias("__doc"), text_sha256(F.col("text")).alias("__sha"))
    one = row.join(kept, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__digest")), "left_semi")
    return one.dropDuplicates(["__doc", "__sha"]).select("__row.*")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY h ORDER BY doc_id NULLS LAST) = 1 AS kept, h AS text_sha256
FROM d WINDOW g AS (PARTITION BY h)
"""


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
