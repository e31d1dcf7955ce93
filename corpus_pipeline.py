"""The corpus pipeline: documents go through five operators; each stage is written as Parquet and read again.

Quality (documents that it rejects go), exact dedup (the smallest id of equal texts stays), n-gram
Jaccard join (the smallest id of each group of near copies stays), mixing (sources alike, as many
rows as came in) and byte-level BPE (encoded, decoded again, as digests). All stages but the last
return the columns of documents. What each does with nulls, empty and long texts, ties, repeated
rows and empty tables is said at its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiprobe.llm.byte_bpe import bpe_digests
from lexiprobe.llm.exact_dedup import keep_first_texts
from lexiprobe.llm.jaccard import jaccard_components
from lexiprobe.llm.mixing import mix_sources
from lexiprobe.llm.quality import documents_sites, score_quality
from lexiprobe.llm.shared import fresh_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, labels, *documents_sites(), carry=True)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first_texts(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that name their component stay: one of each group, where ids are unique."""
    groups = jaccard_components(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(groups, docs.doc_id.eqNullSafe(groups["__kept"]), "left_semi")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs).select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_digests(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources", mixing),
    ("byte-level BPE", bpe),
]

#: Not in SQL: the classifier is fitted and BPE merges are not relational. The tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
