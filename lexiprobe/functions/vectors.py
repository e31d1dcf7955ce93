"""Vector arithmetic on arrays of doubles, in Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where either is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def mean_vector(rows: DataFrame, by: list[str], vec: str, weight: Column | None = None) -> DataFrame:
    """by, vec: the mean of each component (arrays in component order)."""
    long = rows.select(*by, F.posexplode(vec).alias("i", "x"))
    mean = long.groupBy(*by, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias(vec))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def top_dimensions(a: Column, k: int) -> Column:
    """Indices (from 0) of the k largest by magnitude, ties to the smaller index."""
    order = F.array_sort(F.transform(a, lambda x, i: F.struct((-F.abs(x)).alias("a"), i.alias("i"))))
    return F.transform(F.slice(order, 1, k), lambda s: s["i"])


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def fold_scaler(weights: Column, bias: Column, mean: Column, scale: Column) -> Column:
    """Weights and bias for unscaled inputs: w / scale, b - sum(w * mean / scale)."""
    w = F.zip_with(weights, scale, lambda x, s: x / s)
    return F.struct(w.alias("weights"), (bias - dot(w, mean)).alias("bias"))


def margin(weights: Column, bias: Column, x: Column) -> Column:
    return dot(weights, x) + bias


def pooled(tokens: DataFrame, by: list[str], order: str, vec: str, how: str = "mean") -> DataFrame:
    """One vector a group: the mean of its tokens', or the first or last one's."""
    if how == "mean":
        return mean_vector(tokens, by, vec)
    pick = F.min_by if how == "first" else F.max_by
    return tokens.groupBy(*by).agg(pick(vec, order).alias(vec))


def context_pooled(tokens: DataFrame, spans: DataFrame, key: str, width: int = 16) -> DataFrame:
    """Mean of the tokens (key, ix, vec) within ``width`` of a span's own (key, span_id, own: array of ix), those left out."""
    near = tokens.join(spans, key).filter((F.col("ix") >= F.array_min("own") - width) & (F.col("ix") <= F.array_max("own") + width) & ~F.array_contains("own", F.col("ix")))
    return mean_vector(near, [key, "span_id"], "vec")


def signed_effect(clean: Column, corrupt: Column, patched: Column, direction: Column) -> Column:
    """How far a patch moves towards its source: patched - corrupt when denoising, clean - patched when noising."""
    return F.when(direction == "denoise", patched - corrupt).otherwise(clean - patched)


def effect_share(effect: Column, gap: Column, floor: float = 1e-6) -> Column:
    """effect / gap, NaN where the gap is next to nothing."""
    return F.when(F.abs(gap) < floor, F.lit(float("nan"))).otherwise(effect / gap)


def specificity(clean: Column, intervened: Column, control: Column) -> Column:
    """|clean - intervened| / |clean - control|, null without a control that moves."""
    den = F.abs(clean - control)
    return F.when(den.isNull() | (den < 1e-9), F.lit(None)).otherwise(F.abs(clean - intervened) / den)


def matched_random(seed: str, direction: list[float]) -> list[float]:
    """A vector orthogonal to ``direction`` with its norm, the same for the same seed (Gram-Schmidt on hashed normals)."""
    import hashlib

    import numpy as np

    d = np.asarray(direction, float)
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(seed.encode()).digest()[:8], "little"))
    n = float(np.linalg.norm(d))
    if n == 0 or len(d) < 2:
        return [0.0] * len(d)
    r = rng.standard_normal(len(d))
    for _ in range(2):
        r = r - d * (r @ d) / (n * n)
    return (r * (n / np.linalg.norm(r))).tolist()


def chance_overlap(k: int, d: int) -> Column:
    """Jaccard overlap to expect of two choices of ``k`` of ``d`` dimensions at random."""
    return F.lit(k / (2 * d - k))
