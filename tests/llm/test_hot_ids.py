"""Mixing when ids are null or repeated, and texts are null, empty or long."""

from helpers import CLASH
from pyspark.sql import functions as F

from lexiprobe.llm.mixing import mix_sources


def rows_of(spark, ids):
    df = spark.createDataFrame([(i, t, f"s{k % 2}") for k, (i, t) in enumerate(ids)], "doc_id long, text string, source string")
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASH)).repartition(6)


def test_rows_without_an_id_draw_their_own_numbers(spark):
    mixed = mix_sources(rows_of(spark, [(None, f"t{k}") for k in range(4000)]), {"s0": 1, "s1": 3})
    by = {r.source: (r.n, r.d) for r in mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("d")).collect()}
    assert abs(by["s0"][0] - 1000) < 150 and abs(by["s1"][0] - 3000) < 250
    assert abs(by["s0"][1] - 2000 * 0.393) < 120  # 1 - exp(-1/2) of them are drawn at all
    assert mixed.select("mix_key").distinct().count() == mixed.count()


def test_an_id_of_a_third_of_all_rows_fills_no_partition(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        for hot in (None, 7):
            docs = rows_of(spark, [(hot if k % 3 else k, "x") for k in range(9000)])
            sizes = [r.n for r in mix_sources(docs, rows=20_000).groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
            assert len(sizes) == 8 and max(sizes) < 1.5 * sum(sizes) / 8
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_texts_are_carried_whole(spark):
    texts = [None, "", "long " * 200_000]
    mixed = mix_sources(rows_of(spark, list(enumerate(texts))), rows=300)
    assert {r.text for r in mixed.select("text").distinct().collect()} == set(texts)
