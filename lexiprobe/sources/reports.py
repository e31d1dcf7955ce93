"""Published tables: results in wide and long form, exports, completion markers, steps that run once."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiprobe.functions.vectors import specificity
from lexiprobe.operators.metrics import resolution


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write_marked(rows: DataFrame, path: str, stats: dict[str, Column]) -> dict:
    """Writes JSON lines, and statistics of what was written beside them as the sign that they are complete; an older sign goes first."""
    spark, marker = rows.sparkSession, f"{path.rstrip('/')}.stats"
    _delete(spark, marker)
    rows.write.mode("overwrite").json(path)
    found = spark.read.schema(rows.schema).json(path).agg(*(c.alias(n) for n, c in stats.items())).first().asDict()
    spark.createDataFrame([(json.dumps(found, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(marker)
    return found


def marked(spark: SparkSession, path: str) -> dict | None:
    """The statistics of a completed output, or None."""
    marker = f"{path.rstrip('/')}.stats"
    return json.loads(spark.read.text(marker).first()[0]) if _exists(spark, f"{marker}/_SUCCESS") else None


def run_once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> bool:
    """Writes ``make()`` to ``path`` unless it is there complete; whether it ran."""
    if _exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        return False
    make().write.mode("overwrite").parquet(path)
    return True


def checkpoint_part(rows: DataFrame, path: str, part: str, value: str) -> None:
    """Replaces one part (as a strategy's) of a partitioned table; the others, finished before, stay."""
    rows.withColumn(part, F.lit(value)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def pivoted(rows: DataFrame, by: list[str], column: str, values: list, value: str, prefix: str = "") -> DataFrame:
    """A row for each ``by``, a column for each value."""
    return rows.groupBy(*by).agg(*(F.max(F.when(F.col(column) == v, F.col(value))).alias(f"{prefix}{v}") for v in values))


def unpivoted(rows: DataFrame, by: list[str], prefix: str, column: str, value: str) -> DataFrame:
    """The columns of a prefix as rows (number behind the prefix, value)."""
    wide = [c for c in rows.columns if c.startswith(prefix)]
    long = rows.unpivot([*by], wide, column, value)
    return long.withColumn(column, F.substring(column, len(prefix) + 1, 20).cast("int"))


def symmetric_matrix(pairs: DataFrame, a: str, b: str, value: str, names: list[str]) -> DataFrame:
    """name and a column for each name, from pairs given once; null on the diagonal, 0 where a pair is missing."""
    both = pairs.select(F.col(a).alias("name"), F.col(b).alias("other"), value).unionByName(pairs.select(F.col(b).alias("name"), F.col(a).alias("other"), value))
    grid = pairs.sparkSession.range(1).select(F.explode(F.array(*(F.lit(n) for n in names))).alias("name"))
    wide = grid.join(pivoted(both, ["name"], "other", names, value), "name", "left")
    return wide.select("name", *(F.when(F.col("name") != n, F.coalesce(F.col(n), F.lit(0))).alias(n) for n in names))


def probe_rows(results: DataFrame, by: list[str], f1: str, baselines: list[str], small: str, big: str) -> DataFrame:
    """by, macro_f1, best_baseline, their difference, rho (the step of one row of the smaller class), the difference in such steps and whether it is under one."""
    best = F.greatest(*(F.col(b) for b in baselines)) if len(baselines) > 1 else F.col(baselines[0])
    rho = resolution(F.col(small), F.col(big))
    out = results.select(*by, F.col(f1).alias("macro_f1"), best.alias("best_baseline"), rho.alias("rho")).withColumn("probe_minus_baseline", F.col("macro_f1") - F.col("best_baseline"))
    return out.withColumn("in_rho_units", F.when(F.col("rho") > 0, F.col("probe_minus_baseline") / F.col("rho"))).withColumn("below_resolution", F.abs("probe_minus_baseline") < F.col("rho"))


def causal_rows(layers: DataFrame, by: list[str], layer: str, clean: str, changed: str, control: str) -> DataFrame:
    """by, peak_layer (largest effect) with its specificity, and the layer of the best specificity with it; ties to the lower, and to the higher layer."""
    rows = layers.withColumn("__s", specificity(F.col(clean), F.col(changed), F.col(control))).withColumn("__d", F.abs(F.col(clean) - F.col(changed)))
    known = F.when(F.col("__s").isNotNull(), F.struct("__s", layer))
    out = rows.groupBy(*by).agg(F.max_by(F.struct(layer, "__s"), F.struct("__d", -F.col(layer))).alias("p"), F.max(known).alias("b"))
    return out.select(*by, F.col(f"p.{layer}").alias("peak_layer"), F.col("p.__s").alias("peak_specificity"), F.col(f"b.{layer}").alias("best_layer"), F.col("b.__s").alias("best_specificity"))


def condition_effects(rows: DataFrame, condition: str, value: str, far: Column) -> DataFrame:
    """condition, near, far, effect, n: means of cells on either side of the boundary and their difference."""
    out = rows.groupBy(condition).agg(F.avg(F.when(~far, F.col(value))).alias("near"), F.avg(F.when(far, F.col(value))).alias("far"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("effect", F.col("far") - F.col("near"))


def one_model(rows: DataFrame, model: str = "model_id") -> str | None:
    """The model that all rows come from; one table cannot hold two."""
    found = [r[0] for r in rows.select(model).filter(F.col(model).isNotNull()).distinct().limit(3).collect()]
    if len(found) > 1:
        raise ValueError(f"results of several models: {sorted(found)}")
    return found[0] if found else None
