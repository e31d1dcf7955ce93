"""Classification metrics from confusion counts; statistics are sums, so they combine and resample cheaply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion_by(rows: DataFrame, by: list[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Binary tn, fp, fn, tp per group: the sufficient statistics of accuracy and F1."""
    hit = lambda a, b: F.count_if((F.col(y) == a) & (F.col(p) == b)).cast("long")
    return rows.groupBy(*by).agg(hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(1, 1).alias("tp"))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """2tp / (2tp + fp + fn), 0 where there is nothing."""
    den = 2 * tp + fp + fn
    return F.when(den > 0, 2.0 * tp / den).otherwise(F.lit(0.0))


def macro_f1_binary(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    return (f1(tp, fp, fn) + f1(tn, fn, fp)) / 2.0


def accuracy(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    return (tp + tn) / (tp + fp + fn + tn)


def per_class_f1(rows: DataFrame, by: list[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """by, label, support, f1 over the labels seen in truth or prediction."""
    side = lambda c, t, q: rows.groupBy(*by, F.col(c).alias("label")).agg(F.count(F.lit(1)).alias(t), F.count_if(F.col(y) == F.col(p)).alias(q))
    both = side(y, "support", "tp").join(side(p, "predicted", "tp2").drop("tp2"), [*by, "label"], "full_outer")
    both = both.na.fill(0, ["support", "tp", "predicted"])
    return both.select(*by, "label", F.col("support").cast("long").alias("support"), f1(F.col("tp"), F.col("predicted") - F.col("tp"), F.col("support") - F.col("tp")).alias("f1"))


def macro_f1(rows: DataFrame, by: list[str], labels: list | None = None, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Macro F1 over a fixed list of labels (missing ones count 0), or over those seen."""
    each = per_class_f1(rows, by, y, p)
    if labels is None:
        return each.groupBy(*by).agg(F.avg("f1").alias("macro_f1"))
    return each.filter(F.col("label").isin(labels)).groupBy(*by).agg((F.sum("f1") / F.lit(float(len(labels)))).alias("macro_f1"))


def average_ranks(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the rank (from 1, ties at their mean) of ``value`` within ``by``; rows without a value go.

    Values are counted first and their counts summed in order over range partitions, so no task holds a whole group.
    """
    from lexiprobe.operators.splits import running

    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    before = running(counted, by, [F.col(value)], F.col("__c"), "__below")
    keys = [*by, value]
    ranks = before.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)), (F.col("__below") + (F.col("__c") + 1) / 2.0).alias(name))
    return rows.join(ranks, [rows[c].eqNullSafe(ranks[f"__k{i}"]) for i, c in enumerate(keys)]).drop(*(f"__k{i}" for i in range(len(keys))))


def auc(rows: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Mann-Whitney AUC with ties counted half; null where a class is missing."""
    r = average_ranks(rows, by, score, "__r")
    g = r.groupBy(*by).agg(F.sum(F.when(F.col(label) == 1, F.col("__r"))).alias("s"), F.count_if(F.col(label) == 1).alias("a"), F.count_if(F.col(label) == 0).alias("b"))
    return g.select(*by, F.when((F.col("a") > 0) & (F.col("b") > 0), (F.col("s") - F.col("a") * (F.col("a") + 1) / 2.0) / (F.col("a") * F.col("b"))).alias("auc"))


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation of rows that have both values."""
    rows = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("x"), F.col(y).alias("y"))
    r = average_ranks(average_ranks(rows, by, "x", "rx"), by, "y", "ry")
    return r.groupBy(*by).agg(F.corr("rx", "ry").alias("rho"))


def resolution(n_small: Column, n_big: Column) -> Column:
    """Drop of macro F1 from 1 if one row of the smaller class is predicted as the bigger one."""
    return 1.0 - ((2.0 * (n_small - 1)) / (2.0 * (n_small - 1) + 1.0) + (2.0 * n_big) / (2.0 * n_big + 1.0)) / 2.0


def leave_one_out_means(rows: DataFrame, group: list[str], own: list[str], value: str) -> DataFrame:
    """group, own, rest_mean: the mean of a group without the rows that share ``own``, from sums; null where nothing is left."""
    parts = rows.groupBy(*group, *own).agg(F.sum(value).alias("v"), F.count(value).alias("n"))
    all_ = parts.groupBy(*group).agg(F.sum("v").alias("all_v"), F.sum("n").alias("all_n"))
    return parts.join(all_, group).select(*group, *own, F.when(F.col("all_n") > F.col("n"), (F.col("all_v") - F.col("v")) / (F.col("all_n") - F.col("n"))).alias("rest_mean"))
