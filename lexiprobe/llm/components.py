"""Connected components by alternating large and small stars; no vertex gathers its neighbours in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiprobe.llm.shared import cut, fewer, spread_join


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (u, v) of any orderable type to (u, root): the smallest vertex reachable, for every u but the roots."""
    edges = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    n, state = edges.count(), None
    edges = fewer(edges, n)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).select("u", F.least("u", "m").alias("m"), "c")
        least = cut(fewer(least, 2 * n))
        edges = spread_join(both, least, "u", "c", 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(fewer(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), 2 * n))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select("u", F.col("v").alias("root"))
        n, state = now[0], now
