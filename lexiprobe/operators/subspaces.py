"""Subspaces of groups of vectors from one pass over the rows: Gram matrices, principal axes, angles between them, projections and ellipses.

A task sums the products of its own rows, a shuffle by group and row of the matrix adds the tasks' sums, and the
driver sees one matrix a group, whose size follows from the width of the vectors, not from the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups times squared width that may come to the driver (8 bytes each).
CELLS = 1 << 27


@dataclass
class Moments:
    """Rows, mean and centred products of a group's vectors."""

    n: int
    mean: np.ndarray
    products: np.ndarray

    def axes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(variances with divisor n - 1, falling; unit axes as columns) of the first ``k`` principal directions."""
        values, vectors = np.linalg.eigh(self.products)
        order = np.argsort(-values, kind="stable")[:k]
        return np.maximum(values[order], 0.0) / max(1, self.n - 1), vectors[:, order]


def moments(rows: DataFrame, vec: str, group: str | None = None) -> dict:
    """Moments of the vectors of each group (None for all rows), in one pass.

    Null vectors take no part; all must have the length of the first. Products are taken about one of the vectors, so that
    far-off means cost no digits.
    """
    rows = rows.filter(F.col(vec).isNotNull()).select((F.lit(None).cast("string") if group is None else F.col(group)).alias("g"), F.col(vec).cast("array<double>").alias("v"))
    first = rows.select("v").first()
    if first is None:
        return {}
    origin = np.array(first["v"])
    d = len(origin)
    kind = rows.schema["g"].dataType.simpleString()

    def partial(batches):
        sums: dict = {}
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            if len(values) != d * batch.num_rows:
                raise ValueError(f"a vector does not have {d} entries")
            x = np.column_stack([np.ones(batch.num_rows), values.reshape(-1, d) - origin])
            groups = pd.Series(batch.column(0).to_pylist(), dtype=object)
            codes, names = pd.factorize(groups, use_na_sentinel=False)
            for i, name in enumerate(names):
                own = x[codes == i]
                key = None if name is None or name != name else name
                sums[key] = sums.get(key, 0.0) + own.T @ own
        for name, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * (d + 1), rows_type), pa.array(range(d + 1), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], ["g", "i", "row"])

    rows_type = _arrow(kind)
    parts = rows.mapInArrow(partial, f"g {kind}, i int, row array<double>").select("g", "i", F.posexplode("row").alias("j", "v"))
    cells = parts.groupBy("g", "i", "j").agg(F.sum("v").alias("v")).groupBy("g", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda c: c["v"]).alias("row"))
    groups = rows.select("g").distinct().limit(CELLS // (d + 1) ** 2 + 2).count()
    if groups * (d + 1) ** 2 > CELLS:
        raise ValueError(f"{groups} groups or more of {d} dimensions are too many matrices for the driver")
    whole: dict = {}
    for r in cells.collect():
        whole.setdefault(r["g"], np.zeros((d + 1, d + 1)))[r["i"]] = r["row"]
    out = {}
    for name, m in whole.items():
        n, mean = int(round(m[0, 0])), m[0, 1:] / m[0, 0]
        out[name] = Moments(n, origin + mean, m[1:, 1:] - m[0, 0] * np.outer(mean, mean))
    return out


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}[kind]


def principal_angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles in radians, falling, between the spaces of two matrices of orthonormal columns; small ones from their sines, as cosines near 1 lose them."""
    cosines = np.clip(np.linalg.svd(a.T @ b, compute_uv=False), -1.0, 1.0)
    if a.shape[1] < b.shape[1]:
        a, b = b, a
    sines = np.clip(np.linalg.svd(b - a @ (a.T @ b), compute_uv=False), -1.0, 1.0)
    return np.where(cosines[::-1] ** 2 >= 0.5, np.arcsin(sines), np.arccos(cosines[::-1]))


def subspace_angles(rows: DataFrame, vec: str, group: str, base, ks: list[int]) -> DataFrame:
    """other, k, mean_degrees, largest_degrees: between the first k axes of the ``base`` group and those of each other one; k is at most the rows less one."""
    found = moments(rows, vec, group)
    out = []
    own = found.get(base)
    for name in sorted((n for n in found if n != base and n is not None), key=str) if own else ():
        other = found[name]
        for k in ks:
            size = min(k, own.n - 1, other.n - 1, len(own.mean))
            angles = np.degrees(principal_angles(own.axes(size)[1], other.axes(size)[1])) if size > 0 else np.array([np.nan])
            out.append((str(name), k, float(angles.mean()), float(angles.max())))
    return rows.sparkSession.createDataFrame(out, "other string, k int, mean_degrees double, largest_degrees double")


def principal_coordinates(rows: DataFrame, vec: str, k: int = 2) -> DataFrame:
    """``rows`` with the column coordinates: the vector less the mean of all rows, along the first ``k`` axes of all rows; null for null vectors.

    An axis points to where its largest entry is positive.
    """
    found = moments(rows, vec).get(None)
    if found is None:
        return rows.withColumn("coordinates", F.lit(None).cast("array<double>"))
    axes = found.axes(k)[1]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    mean = found.mean

    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else ((np.asarray(x, float) - mean) @ axes) for x in v], dtype=object)

    return rows.withColumn("coordinates", project(F.col(vec).cast("array<double>")))


def covariance_ellipses(rows: DataFrame, x: str, y: str, by: list[str], sigmas: float = 2.0) -> DataFrame:
    """by, n, x, y (centre), width, height (of the contour at ``sigmas``), degrees of the long axis in (-90, 90], by the closed form of 2 x 2 matrices.

    Covariances have divisor n - 1; with one row they are null.
    """
    g = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y"), F.var_samp(x).alias("a"), F.var_samp(y).alias("c"), F.covar_samp(x, y).alias("b"))
    mid, gap = (F.col("a") + F.col("c")) / 2, F.sqrt(F.pow((F.col("a") - F.col("c")) / 2, F.lit(2.0)) + F.col("b") * F.col("b"))
    wide = lambda v: 2 * sigmas * F.sqrt(F.greatest(v, F.lit(0.0)))
    angle = F.degrees(F.atan2(2 * F.col("b"), F.col("a") - F.col("c")) / 2)
    known = F.col("b").isNotNull()
    return g.select(*by, "n", "x", "y", F.when(known, wide(mid + gap)).alias("width"), F.when(known, wide(mid - gap)).alias("height"), F.when(known, angle).alias("degrees"))
