"""Which cells (layer, span, direction, control) an experiment runs, as small generated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The names that cells are made of.
DIRECTIONS = ("denoise", "noise")
NAME_SPANS = ("query_name", "declaration_name")
CELL = "layer int, span string, direction string, control string"


def cells(spark: SparkSession, layers: list[int], spans: tuple[str, ...], controls: tuple[str, ...]) -> DataFrame:
    """Every combination with both directions."""
    each = lambda values: F.explode(F.array(*(F.lit(v) for v in values)))
    if not layers:
        return spark.createDataFrame([], CELL)
    out = spark.range(1).select(F.explode(F.array(*(F.lit(int(v)) for v in layers))).alias("layer"))
    return out.withColumn("span", each(spans)).withColumn("direction", each(DIRECTIONS)).withColumn("control", each(controls))


def schedule(spark: SparkSession, name: str, n_layers: int, probe: int, expanded: bool = False, frozen: list[int] | None = None) -> DataFrame:
    """Cells of behavior, primary, core, full, expanded (full less primary and core) or fp32."""
    every = list(range(n_layers))
    if name == "behavior":
        return spark.createDataFrame([], CELL)
    if name == "core":
        return cells(spark, every, ("query_name",), ("target",))
    if name == "primary":
        out = cells(spark, [probe], ("query_name",), ("target", "random", "same_source"))
        return out.union(cells(spark, [probe], ("placebo",), ("target",))).union(cells(spark, [0], ("query_name",), ("target",))).distinct()
    if name == "full":
        battery = every if expanded else [probe]
        out = cells(spark, every, ("query_name",), ("target",)).union(cells(spark, battery, ("declaration_name", "placebo"), ("target",)))
        return out.union(cells(spark, battery, NAME_SPANS, ("random",))).union(cells(spark, [probe], NAME_SPANS, ("same_source",))).distinct()
    if name == "expanded":
        done = schedule(spark, "primary", n_layers, probe).union(schedule(spark, "core", n_layers, probe))
        return schedule(spark, "full", n_layers, probe, expanded).subtract(done)
    if name == "fp32":
        unique = list(dict.fromkeys(frozen or []))
        if len(unique) != 3 or not all(0 <= x < n_layers for x in unique):
            raise ValueError(f"fp32 takes three different layers under {n_layers}, not {frozen}")
        return cells(spark, unique, ("query_name",), ("target", "random")).union(cells(spark, unique, ("placebo",), ("target",)))
    raise ValueError(f"no schedule {name}")


def expected_keys(pairs: DataFrame, plan: DataFrame) -> DataFrame:
    """pair_id x cells, and the four unpatched and clean baselines of a pair (layer -1)."""
    base = pairs.sparkSession.range(1).select(F.lit(-1).alias("layer"), F.explode(F.array(*(F.lit(s) for s in ("baseline_class", "baseline_function")))).alias("span"), F.lit("none").alias("direction"))
    base = base.withColumn("control", F.explode(F.array(F.lit("unpatched"), F.lit("repeat"))))
    return pairs.select("pair_id").crossJoin(F.broadcast(plan.unionByName(base)))


def forward_estimate(pairs: int, plan: DataFrame, batch: int) -> DataFrame:
    """Passes by layer: pairs x cells, in batches."""
    return plan.groupBy("layer").agg((F.count(F.lit(1)) * pairs).alias("rows"), F.ceil(F.count(F.lit(1)) * pairs / F.lit(batch)).alias("passes"))


def strongest_layers(rows: DataFrame, n_layers: int, probe: int, k: int = 2) -> DataFrame:
    """layer, score of the ``k`` inner layers with the largest |mean of (denoise + noise) / 2| over exact pairs; ties to the lower layer."""
    wide = rows.groupBy("layer", "pair_id").agg(F.max(F.when(F.col("direction") == "denoise", F.col("signed_effect"))).alias("d"), F.max(F.when(F.col("direction") == "noise", F.col("signed_effect"))).alias("n"))
    scores = wide.filter(~F.col("layer").isin(0, n_layers - 1, probe)).groupBy("layer").agg(F.abs(F.avg((F.col("d") + F.col("n")) / 2)).alias("score"))
    return scores.orderBy(F.desc("score"), "layer").limit(k)
