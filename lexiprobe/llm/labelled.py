"""Bounded, repeatable samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text is divisible by ``folds``: such rows are never learned from. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, folds: int = 5) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, y, text) of at most ``per_class`` documents of each class, and the rows each class has in all.

    The sample takes the smallest hashes of ids. Labels other than 0 and 1, null ones and those of
    held-out documents are left out; a document labelled both ways counts as 1.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.filter(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"), folds)).groupBy("doc_id").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    by_hash = known.orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = by_hash.filter("y = 1").limit(per_class).unionByName(by_hash.filter("y = 0").limit(per_class))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most 2 * per_class rows of 12 bytes: a bound that does not grow with the data
    return text.join(F.broadcast(sample), "doc_id"), sizes
