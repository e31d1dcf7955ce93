"""Operator 5, approximate nearest neighbours by adaptive dimension scan.

Largest inner product becomes smallest distance by one more dimension (the square root of what the
norm lacks to the largest norm). Vectors are turned by a random rotation and dealt to the lists of
their nearest centroids; queries visit the lists of their nearest centroids, as many as the sample needs for
the recall asked for. Within a list,
columns are read in blocks: after each block a hypothesis test on the partial distance (its expected
share of the whole is the share of dimensions seen, with a deviation that falls with their number)
abandons the candidates that will hardly come under the k-th best, that of the nearest list at first. What is left is scored exactly on
the original vectors. A list that holds many of the vectors, or is visited by many of the queries, is
cut into chunks of both, so that no task holds more than one chunk of either.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiprobe.llm.shared import cut

#: Rows that centroids are fitted on, at most (smallest hashes of ids).
FIT_ROWS = 40_000
#: Lists number half the square root of the rows, at most MAX_LISTS. A query visits as many as FIT_QUERIES rows of
#: the sample need for RECALL of their neighbours in the sample, MIN_PROBES at least: few where data has structure.
MAX_LISTS, MIN_PROBES, FIT_QUERIES, RECALL = 16_384, 16, 256, 0.97
CHUNK_VECTORS, CHUNK_QUERIES = 4_096, 2_048
#: Columns of a block, and the test's slack in deviations.
BLOCK, SLACK = 8, 2.1


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v (array of doubles) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0.0)
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(fine)


def _matrix(col, width: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Space:
    """Augmentation, rotation and centroids; bounded by MAX_LISTS and the number of dimensions."""

    def __init__(self, sample: np.ndarray, norm: float, lists: int, k: int = 20, recall: float = RECALL, seed: int = 11):
        self.width, self.norm = sample.shape[1], norm
        self.padded = -(-(self.width + 1) // BLOCK) * BLOCK
        rng = np.random.default_rng(seed)
        self.turn = np.linalg.qr(rng.standard_normal((self.padded, self.padded)))[0]
        x = self.turned(sample, data=True).astype(np.float32)
        c = x[rng.permutation(len(x))[: min(lists, len(x))]]
        for _ in range(8):
            own = self._nearest(x, c, 1)[:, 0]
            order = np.argsort(own, kind="stable")
            heads = np.flatnonzero(np.diff(own[order], prepend=-1))
            c = c.copy()
            c[own[order][heads]] = np.add.reduceat(x[order], heads, axis=0) / np.diff(np.append(heads, len(x)))[:, None]
        self.centroids = c
        self.probes = self._probes(sample, x, k, recall)

    def _probes(self, sample: np.ndarray, x: np.ndarray, k: int, recall: float) -> int:
        """The fewest lists in which FIT_QUERIES rows of the sample find ``recall`` of their true neighbours there."""
        asked = np.arange(0, len(sample), max(1, len(sample) // FIT_QUERIES))
        own = self._nearest(x, self.centroids, 1)[:, 0]
        place = np.argsort(self.lists_of(sample[asked], False, len(self.centroids)), axis=1)
        ranks = []
        for row, q in zip(place, asked.tolist(), strict=True):
            score = sample @ sample[q]
            score[q] = -np.inf
            near = np.argpartition(-score, min(k, len(score)) - 1)[:k]
            ranks.append(row[own[near[near != q]]])
        ranks = np.sort(np.concatenate(ranks))
        return 1 + int(ranks[min(len(ranks) - 1, int(recall * len(ranks)))]) if len(ranks) else len(self.centroids)

    @staticmethod
    def _nearest(x, c, k):
        out = np.empty((len(x), k), np.int64)
        half = (c * c).sum(1) / 2
        for s in range(0, len(x), 1024):
            d = half - x[s : s + 1024] @ c.T
            near = np.argpartition(d, k - 1, axis=1)[:, :k] if k < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(d), 1))
            out[s : s + 1024] = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
        return out

    def turned(self, x: np.ndarray, data: bool) -> np.ndarray:
        wide = np.zeros((len(x), self.padded))
        wide[:, : self.width] = x
        if data:
            wide[:, self.width] = np.sqrt(np.maximum(0.0, self.norm**2 - (x * x).sum(1)))
        return wide @ self.turn

    def lists_of(self, x: np.ndarray, data: bool, k: int) -> np.ndarray:
        return self._nearest(self.turned(x, data).astype(np.float32), self.centroids, min(k, len(self.centroids)))


def _assign(space: Space, data: bool, k: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                lists = space.lists_of(_matrix(batch.column(1), space.width), data, k)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(lists), pa.list_(pa.int64()))], ["vec_id", "v", "lists"])

    return run


def _survivors(space: Space, x: np.ndarray, q: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) places that no test abandons: turned vectors against turned queries, block by block of columns.

    ``limit`` is each query's squared distance to beat. As long as many pairs are alive their partial
    distances come from matrix products; then only the pairs left are read on.
    """
    near = limit[:, None]
    part = np.zeros((len(q), len(x)))
    alive = np.ones(part.shape, bool)
    done = 0
    while done < space.padded and alive.mean() > 0.2:
        a, b = x[:, done : done + BLOCK], q[:, done : done + BLOCK]
        part += (b * b).sum(1)[:, None] + (a * a).sum(1) - 2 * (b @ a.T)
        done += BLOCK
        alive &= part <= near * _share(done, space.padded) + 1e-9 * space.norm**2
    i, j = np.nonzero(alive)
    rest = part[i, j]
    while done < space.padded and len(i):
        rest = rest + ((x[j, done : done + BLOCK] - q[i, done : done + BLOCK]) ** 2).sum(1)
        done += BLOCK
        stay = rest <= limit[i] * _share(done, space.padded) + 1e-9 * space.norm**2
        i, j, rest = i[stay], j[stay], rest[stay]
    return i, j


def _share(seen: int, of: int) -> float:
    """Most that a partial distance should be of the one to beat, given how many dimensions it has seen."""
    return 1 + 1e-9 if seen >= of else (seen / of) * (1 + SLACK / seen**0.5) ** 2


def _scan_list(space: Space, k: int):
    """One chunk of a list and the queries that visit it: query_id, vec_id, score of the best k that beat the query's floor."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if left.num_rows and right.num_rows:
            ids = left.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], _matrix(left.column("v"), space.width)[order]
            tx = space.turned(x, True)
            all_q, all_ids, floor = _matrix(right.column("q"), space.width), right.column("query_id").to_numpy(), right.column("floor").to_numpy()
            step = max(1, (1 << 19) // len(x))  # queries at a time: half a million pairs
            for s in range(0, len(all_q), step):
                q, qids, least = all_q[s : s + step], all_ids[s : s + step], floor[s : s + step]
                tq = space.turned(q, False)
                base = space.norm**2 + (q * q).sum(1)
                limit = base - 2 * least  # of the distance that a score at the floor has
                head = min(len(x), 4 * k)
                if head > k:  # one more than k: the query's own row may be among them
                    score = q @ x[:head].T
                    limit = np.minimum(limit, base - 2 * -np.partition(-score, k, axis=1)[:, k])
                i, j = _survivors(space, tx, tq, limit * (1 + 1e-9) + 1e-9)
                own = ids[j] != qids[i]
                i, j = i[own], j[own]
                score = (x[j] * q[i]).sum(1)
                best = np.lexsort((ids[j], -score, i))
                i, j, score = i[best], j[best], score[best]
                first = np.searchsorted(i, i)
                keep = (np.arange(len(i)) - first < k) & (score >= least[i] - 1e-12)
                for o, v in zip(out, (qids[i[keep]], ids[j[keep]], score[keep]), strict=True):
                    o.append(v)
        cols = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.table({"query_id": pa.array(cols[0].astype(np.int64)), "vec_id": pa.array(cols[1].astype(np.int64)), "score": pa.array(cols[2].astype(float))})

    return run


def _scan(data: DataFrame, asked: DataFrame, space: Space, k: int) -> DataFrame:
    """All lists' chunks with the queries (query_id, q, list, floor) that visit them."""
    # at most MAX_LISTS rows each
    sizes = data.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CHUNK_VECTORS).cast("long").alias("parts"))
    sizes = F.broadcast(sizes.join(asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CHUNK_QUERIES).cast("long").alias("asks")), "list"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = data.join(sizes, "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).withColumn("ask", every("asks"))
    right = asked.join(sizes, "list").withColumn("ask", F.pmod(F.xxhash64("query_id"), F.col("asks"))).withColumn("part", every("parts"))
    return (
        left.select("list", "part", "ask", "vec_id", "v").groupBy("list", "part", "ask")
        .cogroup(right.select("list", "part", "ask", "query_id", "q", "floor").groupBy("list", "part", "ask"))
        .applyInArrow(_scan_list(space, k), "query_id long, vec_id long, score double")
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    """query_id, near: the best k (s: negative score, vec_id), nearest first."""
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return one.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("near"))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, probes: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row whose id is divisible by ``every``.

    All others are returned where there are fewer than ``k``: a query whose lists hold too few goes through all.
    Vectors that are null, empty, all zero, of another than the most common length, or hold null or
    non-finite components take no part, nor do rows with a null id. Rows that repeat an id are the
    same record: none is its own neighbour, and of several with one id the best score counts. Ties
    go to the smaller vec_id. An empty table gives no rows; other columns are ignored.
    """
    rows = usable(vectors, id_col, vec_col)
    widths = rows.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top"))
    common = widths.orderBy(F.desc("n"), F.desc("w")).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return vectors.sparkSession.createDataFrame([], empty)
    rows = rows.filter(F.size("v") == common["w"])
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("vec_id", "v").toArrow()
    x = _matrix(sample.column("v"), common["w"])
    x = x[np.lexsort((*x.T[:2], sample.column("vec_id").to_numpy()))]
    lists = max(1, min(MAX_LISTS, int(common["n"] ** 0.5 / 2)))
    space = Space(x, float(common["top"]) ** 0.5, lists, k)
    probes = max(MIN_PROBES, space.probes) if probes is None else probes
    schema = "vec_id long, v array<double>, lists array<long>"
    data = cut(rows.mapInArrow(_assign(space, True, 1), schema).select("vec_id", "v", F.col("lists")[0].alias("list")))
    asked = rows.filter(F.pmod(F.col("vec_id"), F.lit(every)) == 0).mapInArrow(_assign(space, False, probes), schema)
    asked = cut(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.posexplode("lists").alias("at", "list")))
    # the nearest list first: its k-th best is the floor that the other lists' candidates must reach
    first = cut(_scan(data, asked.filter("at = 0").withColumn("floor", F.lit(float("-inf"))), space, k))
    floors = _best(first, k).select("query_id", F.when(F.size("near") >= k, -F.col("near")[k - 1]["s"]).alias("floor"))
    rest = asked.filter("at > 0").join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    best = cut(_best(first.unionByName(_scan(data, rest, space, k)), k))
    # a query whose lists held too few others goes through all lists
    others = data.agg(F.count_distinct("vec_id")).first()[0] - 1
    enough = best.filter(F.size("near") >= min(k, others)).select("query_id")
    short = cut(asked.filter("at = 0").select("query_id", "q").join(enough, "query_id", "left_anti"))
    if others and not short.isEmpty():
        every_list = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(space.centroids) - 1).cast("long")))
        wide = short.withColumn("list", every_list).withColumn("floor", F.lit(float("-inf")))
        best = best.join(enough, "query_id", "left_semi").unionByName(_best(_scan(data, wide, space, k), k))
    out = best.select("query_id", F.posexplode("near").alias("at", "n"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("vec_id"), (-F.col("n.s")).alias("score"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
