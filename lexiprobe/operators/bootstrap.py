"""Cluster bootstrap over sufficient statistics.

A draw table gives each replicate the clusters it takes and how often. Joined with one row of sums a
cluster it yields every statistic of every replicate in one aggregation; cells that share the draw
table are resampled together, which is what paired deltas and contrasts need.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def draws(clusters: DataFrame, cluster: str, n_boot: int) -> DataFrame:
    """replicate, ``cluster``, times: each replicate draws as many clusters as there are, by hash, with replacement."""
    from lexiprobe.operators.splits import global_rank

    numbered = global_rank(clusters.select(cluster).distinct(), [F.col(cluster)], "__k")
    k = numbered.count()
    pick = F.conv(F.substring(F.sha1(F.concat_ws(":", "b", "j").cast("binary")), 1, 8), 16, 10).cast("long") % F.lit(max(k, 1)) + 1
    spark = clusters.sparkSession
    grid = spark.range(n_boot).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(max(k - 1, 0)))).alias("j"))
    times = grid.select("b", pick.alias("__k")).groupBy("b", "__k").agg(F.count(F.lit(1)).alias("times"))
    return times.join(numbered, "__k").select(F.col("b").alias("replicate"), cluster, "times")


def replicates(cells: DataFrame, drawn: DataFrame, cluster: str, sums: list[str], by: list[str]) -> DataFrame:
    """by, replicate and the weighted sums of each replicate."""
    return cells.join(drawn, cluster).groupBy(*by, "replicate").agg(*(F.sum(F.col(s) * F.col("times")).alias(s) for s in sums))


def percentile_interval(values: DataFrame, by: list[str], stat: Column, level: float = 0.95) -> DataFrame:
    a = (1 - level) / 2
    g = values.groupBy(*by).agg(F.percentile(stat, F.array(F.lit(a), F.lit(1 - a))).alias("__q"), F.count(stat).alias("n_boot"))
    return g.select(*by, F.col("__q")[0].alias("lo"), F.col("__q")[1].alias("hi"), "n_boot")


def jackknife(cells: DataFrame, cluster: str, sums: list[str], by: list[str] | None = None) -> DataFrame:
    """Each cluster's totals without it: sums over all less its own."""
    own = cells.groupBy(*(by or []), cluster).agg(*(F.sum(s).alias(s) for s in sums))
    all_ = own.groupBy(*(by or [])).agg(*(F.sum(s).alias(f"__{s}") for s in sums))
    both = own.join(all_, by) if by else own.crossJoin(F.broadcast(all_))  # one row of totals
    return both.select(*(by or []), cluster, *((F.col(f"__{s}") - F.col(s)).alias(s) for s in sums))


def bca_bounds(observed: float, boot: list[float], accel: float, level: float = 0.95) -> tuple[float, float]:
    """Bias-corrected and accelerated bounds; the share below the observed is kept within 1e-9 of 0 and 1, places within 0 and 1."""
    boot = sorted(b for b in boot if math.isfinite(b))
    n = len(boot)
    if n < 2:
        return float("nan"), float("nan")
    normal = NormalDist()
    z0 = normal.inv_cdf(min(max(sum(b < observed for b in boot) / n, 1e-9), 1 - 1e-9))

    def at(q: float) -> float:
        z = z0 + normal.inv_cdf(q)
        place = min(1.0, max(0.0, normal.cdf(z0 + z / (1 - accel * z)))) * (n - 1)
        i = min(int(place), n - 2)
        return boot[i] + (boot[i + 1] - boot[i]) * (place - i)

    return at((1 - level) / 2), at((1 + level) / 2)


def acceleration(jack: list[float]) -> float:
    """From leave-one-out values: their skew over six times their spread to the power 3/2."""
    mean = sum(jack) / len(jack)
    squares = sum((mean - j) ** 2 for j in jack)
    return sum((mean - j) ** 3 for j in jack) / (6 * squares**1.5) if squares > 0 else 0.0


def accelerations(jack: DataFrame, by: list[str]) -> DataFrame:
    """by, accel, n_clusters of leave-one-out values (by, stat), from two rounds of sums."""
    mean = jack.groupBy(*by).agg(F.avg("stat").alias("__m"))
    gap = F.col("__m") - F.col("stat")
    both = jack.join(mean, by) if by else jack.crossJoin(F.broadcast(mean))
    s = both.groupBy(*by).agg(F.sum(gap * gap * gap).alias("c"), F.sum(gap * gap).alias("q"), F.count(F.lit(1)).alias("n_clusters"))
    return s.select(*by, F.when(F.col("q") > 0, F.col("c") / (6 * F.pow("q", F.lit(1.5)))).otherwise(0.0).alias("accel"), "n_clusters")


def bca_interval(boot: DataFrame, jack: DataFrame, observed: DataFrame, by: list[str]) -> DataFrame:
    """by, observed, lo, hi from (by, stat) of replicates, of leave-one-out clusters and of all rows; null bounds under two clusters.

    Clusters are summed where they are; a group's replicates, whose number is chosen, meet in one task.
    """

    @F.pandas_udf("lo double, hi double")
    def bounds(seen: pd.Series, values: pd.Series, accel: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = [bca_bounds(s, list(v), a) if k >= 2 else (float("nan"), float("nan")) for s, v, a, k in zip(seen, values, accel, n, strict=True)]
        return pd.DataFrame(rows, columns=["lo", "hi"])

    name = lambda d, *cols: d.toDF(*(f"__{i}" if i < len(by) else c for i, c in enumerate([*by, *cols])))  # noqa: E731 - all may come from one table
    values = boot.groupBy(*by).agg(F.collect_list("stat").alias("values"))
    a, b, c = name(observed.select(*by, "stat"), "observed"), name(values.select(*by, "values"), "values"), name(accelerations(jack.select(*by, "stat"), by), "accel", "n_clusters")
    keys = [f"__{i}" for i in range(len(by))]
    both = a.join(b, keys).join(c, keys) if by else a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))
    return both.withColumn("ci", bounds("observed", "values", "accel", "n_clusters")).select(*(F.col(k).alias(n) for k, n in zip(keys, by, strict=True)), "observed", "ci.lo", "ci.hi")
