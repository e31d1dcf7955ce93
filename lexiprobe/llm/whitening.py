"""Operator 12, embedding whitening by a tiled covariance.

Vectors are read as integers, floor(scale * c). The fit list holds each distinct vector once (a shuffle by
its packed bytes, combined before it, so that copies in any number are no hot key). Pairs of dimension blocks
are the tiles: every row-block of the list sends each of its column blocks to the tiles that need it, a tile
multiplies the centred pair of each row-block, and the products are summed first in the task and
then by tile. The assembled matrix has one entry a pair of dimensions whatever the number of rows;
it alone comes to the driver, for its eigenvectors. Rows are then whitened where they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiprobe.llm.shared import fresh_path, small_batches

#: Bytes of a packed row-block that is shuffled as one row.
BLOCK_BYTES = 1 << 20
#: The covariance is assembled on the driver: 8 bytes a pair of dimensions.
MAX_DIMS = 4096
_LIMIT = float(1 << 62)
_TILE = "i int, j int, chunk long, left boolean, rows int, payload binary"


def finite_vectors(rows: DataFrame, vector: str = "embedding") -> Column:
    """Whether a vector is there, not empty, and has no null, infinite or NaN entry."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & good, F.lit(False))


def common_length(rows: DataFrame, vector: str = "embedding") -> int:
    """The length that most vectors have, the larger one of two as common; 0 if there is none."""
    most = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return most["d"] if most else 0


def _entries(column: pa.Array, dims: int) -> np.ndarray:
    """A list column without nulls as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dims)


def quantised(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * c) as 64-bit integers; what is beyond their range is at its end."""
    return np.clip(np.floor(scale * values), -_LIMIT, _LIMIT).astype(np.int64)


def _packed(x: np.ndarray) -> list[bytes]:
    """Each row of integers in the smallest of 1, 2, 4 or 8 bytes an entry that holds it: equal rows are equal bytes."""
    most = np.maximum(x.max(axis=1, initial=0), -(x.min(axis=1, initial=0) + 1))
    width = np.select([most < 1 << 7, most < 1 << 15, most < 1 << 31], [1, 2, 4], 8)
    out: list[bytes] = [b""] * len(x)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        raw = x[at].astype(f"<i{w}").tobytes()
        step = len(raw) // len(at)
        for k, i in enumerate(at.tolist()):
            out[i] = raw[k * step : (k + 1) * step]
    return out


def _unpacked(column: pa.Array, dims: int) -> np.ndarray:
    out = np.empty((len(column), dims), np.int64)
    for k, raw in enumerate(column.to_pylist()):
        out[k] = np.frombuffer(raw, f"<i{len(raw) // dims}")
    return out


def fit_list(rows: DataFrame, dims: int, scale: float, vector: str = "embedding") -> DataFrame:
    """x (binary): each distinct integer vector of ``rows``, whose vectors are finite and of ``dims`` entries, once."""

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_packed(quantised(_entries(batch.column(0), dims), scale)), pa.binary())], ["x"])

    return rows.select(vector).mapInArrow(pack, "x binary").distinct()


def _column_sums(listed: DataFrame, dims: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""

    def partial(batches):
        n, low, high = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x = _unpacked(batch.column(0), dims)
            n += len(x)
            high += (x >> 32).sum(axis=0)  # two halves: sums of large entries stay exact
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(dims, n)), pa.array(np.arange(dims)), pa.array(high), pa.array(low)], ["n", "dim", "high", "low"])

    sums = listed.mapInArrow(partial, "n long, dim long, high long, low long").groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).collect()
    out = [0] * dims
    for r in sums:
        out[r["dim"]] = (int(r["high"]) << 32) + int(r["low"])
    return (sums[0]["n"] if sums else 0), out


def _send_blocks(dims: int, tile: int):
    """mapInArrow: the fit list to column blocks of row-blocks, one row for each tile that needs the block."""
    edges = [(s, min(dims, s + tile)) for s in range(0, dims, tile)]

    def run(batches):
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        rows = max(1, BLOCK_BYTES // (8 * tile))

        def block(x: np.ndarray):
            chunk = (part << 32) | nth
            parts = [x[:, s:e] for s, e in edges]
            packed = [_narrow(p) for p in parts]
            out = []
            for i in range(len(edges)):
                for j in range(i, len(edges)):
                    out.append((i, j, chunk, True, len(x), packed[i]))
                    if i != j:
                        out.append((i, j, chunk, False, len(x), packed[j]))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["i", "j", "chunk", "left", "rows", "payload"])

        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                held.append(_unpacked(batch.column(0).slice(at, rows), dims))
                n += len(held[-1])
                if n >= rows:
                    yield block(np.concatenate(held))
                    held, n, nth = [], 0, nth + 1
        if held:
            yield block(np.concatenate(held))

    return run


def _narrow(x: np.ndarray) -> bytes:
    """A matrix of integers in the smallest entries that hold it, compressed."""
    import zstandard

    most = max(int(x.max(initial=0)), -int(x.min(initial=0)) - 1)
    w = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
    return bytes([w]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.T, f"<i{w}").tobytes())


def _wide(payload: bytes, rows: int) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload[1:]), f"<i{payload[0]}")
    return flat.reshape(-1, rows).T


def _multiply(mean: np.ndarray, tile: int):
    """mapInArrow over rows sorted by tile, row-block and side: one partial product a tile and task."""

    def run(batches):
        names, key, total, left = ["i", "j", "cells"], None, None, None
        for batch in batches:
            for i, j, side, rows, payload in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4, 5)), strict=True):
                if (i, j) != key:
                    if key is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([total.ravel()], pa.list_(pa.float64()))], names)
                    key, total = (i, j), 0.0
                own = i if side else j
                centred = _wide(payload, rows) - mean[own * tile : (own + 1) * tile]
                if i == j:
                    total = total + centred.T @ centred
                elif side:
                    left = centred
                else:
                    total = total + left.T @ centred
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([total.ravel()], pa.list_(pa.float64()))], names)

    return run


def tiled_covariance(listed: DataFrame, n: int, sums: list[int], tile: int = 32) -> np.ndarray:
    """The covariance (divisor ``n``) of the fit list of :func:`fit_list`, from products of tiles of ``tile`` x ``tile`` dimensions.

    A tile's row-blocks are dealt by (tile, row-block), so a tile's work spreads over all tasks however few tiles there are.
    """
    dims = len(sums)
    mean = np.array([s / n for s in sums])
    sent = listed.mapInArrow(_send_blocks(dims, tile), _TILE).repartition("i", "j", "chunk").sortWithinPartitions("i", "j", "chunk", F.desc("left"))
    partial = sent.mapInArrow(_multiply(mean, tile), "i int, j int, cells array<double>")
    cells = partial.select("i", "j", F.posexplode("cells").alias("cell", "v")).groupBy("i", "j", "cell").agg(F.sum("v").alias("v"))
    whole = cells.groupBy("i", "j").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "v"))), lambda c: c["v"]).alias("cells"))
    out = np.zeros((dims, dims))
    for r in whole.collect():  # one row a tile
        a, b = slice(r["i"] * tile, min(dims, (r["i"] + 1) * tile)), slice(r["j"] * tile, min(dims, (r["j"] + 1) * tile))
        out[a, b] = np.array(r["cells"]).reshape(a.stop - a.start, b.stop - b.start)
        out[b, a] = out[a, b].T
    return out / n


@dataclass
class Whitening:
    """A fitted whitening: of ``n`` distinct vectors, their sums, and the unit components by falling eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    scale: float
    identity_error: float | None = None

    @property
    def dims(self) -> int:
        return len(self.sums)

    def usable(self) -> np.ndarray:
        """Which components have an eigenvalue above rounding; along the others nothing can be whitened."""
        return self.eigenvalues > 1e-12 * max(self.trace, 0.0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Integer vectors to their whitened coordinates; NaN along components that are not usable."""
        mean = np.array([s / self.n for s in self.sums])
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (x - mean) @ self.components / np.sqrt(np.maximum(self.eigenvalues, 0.0))
        out[:, ~self.usable()] = np.nan
        return out

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n * x - S)^2 of each vector, exact; null where 64 bits do not hold it."""
        most = self.n * (float(np.abs(x).max(initial=0)) + 1) + max(map(abs, self.sums), default=0)
        if self.dims * most * most < _LIMIT:
            diff = self.n * x - np.array(self.sums, np.int64)
            return (diff * diff).sum(axis=1).tolist()
        exact = (sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist())
        return [v if v < 1 << 63 else None for v in exact]


def _identity_error(listed: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity, over the usable components."""
    use = np.flatnonzero(model.usable())
    k = len(use)
    if not k:
        return None

    def partial(batches):
        total = np.zeros(k + k * k)
        for batch in batches:
            y = model(_unpacked(batch.column(0), model.dims))[:, use]
            total += np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], [f"c{i}" for i in range(k + k * k)])

    names = [f"c{i}" for i in range(k + k * k)]
    sums = np.array(listed.mapInArrow(partial, ", ".join(f"{c} double" for c in names)).agg(*(F.sum(c) for c in names)).first())
    mean, second = sums[:k] / model.n, sums[k:].reshape(k, k) / model.n
    # whitened coordinates have a mean of rounding size, so taking it out afterwards loses nothing
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def fit_whitening(rows: DataFrame, components: int = 4, scale: float = 256.0, tile: int = 32, vector: str = "embedding") -> Whitening | None:
    """The whitening of the distinct integer vectors of ``rows``; None if no row has a vector.

    Vectors that are null, empty, hold null or non-finite entries or have another length than the commonest
    (the larger of two as common) take no part. Copies count once, null ids and repeated ids do not matter.
    """
    rows = rows.select(vector).filter(finite_vectors(rows, vector))
    dims = common_length(rows, vector)
    if not dims:
        return None
    if dims > MAX_DIMS:
        raise ValueError(f"vectors of {dims} entries: the covariance of at most {MAX_DIMS} is assembled")
    spark = rows.sparkSession
    small_batches(spark)
    path = fresh_path(spark, "fit-list")
    fit_list(rows.filter(F.size(vector) == dims), dims, scale, vector).write.parquet(path)
    listed = spark.read.parquet(path)
    n, sums = _column_sums(listed, dims)
    covariance = tiled_covariance(listed, n, sums, tile)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    model = Whitening(n, sums, vectors[:, order], values[order], float(np.trace(covariance)), scale)
    model.identity_error = _identity_error(listed, model)
    return model


def whiten(rows: DataFrame, model: Whitening | None, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """vec_id, n, deviation and whitened (array of one double a component) of each row whose vector takes part.

    Null and repeated ids keep their rows; entries along components without variance are null; other columns are
    ignored whatever their names. Without a model there are no rows.
    """
    schema = "vec_id long, n long, deviation long, whitened array<double>"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            x = quantised(_entries(batch.column(1), model.dims), model.scale)
            y = model(x)
            lists = [[None if np.isnan(v) else v for v in row] for row in y.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), model.n)), pa.array(model.deviations(x), pa.int64()), pa.array(lists, pa.list_(pa.float64()))], ["vec_id", "n", "deviation", "whitened"])

    # the test of lengths comes first, so that vectors of another length are never tested
    good = (F.size(vector) == model.dims) & finite_vectors(rows, vector)
    return rows.filter(good).select(F.col(id_col).cast("long").alias("vec_id"), vector).mapInArrow(run, schema)


def whitening_rows(rows: DataFrame, model: Whitening | None, **names) -> DataFrame:
    """A row for each row of :func:`whiten` and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    made = whiten(rows, model, **names)
    shares = [] if model is None else [float(v) / model.trace if model.trace > 0 else 0.0 for v in model.eigenvalues]
    out = made.select("vec_id", "n", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.element_at(F.array(*(F.lit(s) for s in shares)), F.col("at") + 1) if shares else F.lit(None)
    error = None if model is None else model.identity_error
    return out.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", explained.cast("double").alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whitening_rows(rows, fit_whitening(rows))
