"""Operator 1, toxicity by the nearest labelled examples.

Terms are the words of the bounded sample of labelled documents, all of them. A term weighs its inverse
document frequency times its contrast, by how much its frequencies in the two classes differ beyond
sampling error: plain inverse document frequency lets topic words decide.
Examples are TF-IDF vectors of their whole texts in a block-max inverted index, which finds the nearest
by cosine exactly. Votes are weighted by closeness, and a monotone map learned from the examples
themselves, each left out in turn, makes the votes probabilities. The index is bounded by the sample;
texts are scored where they are read, without any shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiprobe.llm.labelled import held_out, labelled_sample
from lexiprobe.llm.shared import small_batches

#: Labelled rows of each class that are learned from, at most.
PER_CLASS = 8_000
#: Examples of a block; terms of more than a COMMON-th of the examples are kept as a matrix; texts are scored BATCH at a time.
NEIGHBOURS, BLOCK, COMMON, BATCH = 25, 512, 16, 64
#: Rows at the common rate that a term's class frequencies are shrunk by.
SHRINK = 10.0
#: Weight of the rate of texts without any known term beside the neighbours' votes.
_LITTLE = 0.05
_WORD = re.compile(r"[^\W\d_]+")


def word_counts(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    size = end - start
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


class BlockMaxIndex:
    """Exact k nearest examples by cosine.

    Examples stand in blocks of BLOCK, in the order of their heaviest terms, so that a block's examples
    are alike. Terms of more than a COMMON-th of the examples are a matrix, one product for a batch of
    queries. The others are inverted lists, cut by block; an entry (term, block) has its largest weight
    beside. A block's bound is the largest common part in it and its terms' largest weights; the blocks
    of the highest bounds are scored first, the rest only where its bound reaches the k-th best so far.
    """

    def __init__(self, row: np.ndarray, term: np.ndarray, times: np.ndarray, weight: np.ndarray):
        """Example i has the distinct terms term[row[i]:row[i + 1]], in order, as often as ``times`` says."""
        self.row, self.term, self.weight = row.astype(np.int64), term.astype(np.int32), np.asarray(weight, float)
        n = len(row) - 1
        self.impact = (1 + np.log(times)) * self.weight[term]
        of = np.repeat(np.arange(n), np.diff(self.row))
        norm = np.sqrt(np.bincount(of, self.impact**2, n))
        self.impact /= np.where(norm > 0, norm, 1.0)[of]
        self.ready = False

    def __len__(self) -> int:
        return len(self.row) - 1

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("row", "term", "weight", "impact")} | {"ready": False}

    def _make(self) -> None:
        """What each worker builds when first asked."""
        n, size = len(self), len(self.weight)
        of = np.repeat(np.arange(n), np.diff(self.row))
        full = np.diff(self.row) > 0
        heaviest = np.full(n, -1.0)
        by = np.lexsort((self.term, -self.impact, of))
        heaviest[full] = self.term[by[self.row[:-1][full]]]
        strength = np.zeros(n)
        strength[full] = self.impact[by[self.row[:-1][full]]]
        self.order = np.lexsort((-strength, heaviest)).astype(np.int32)  # place in the blocks to example
        self.at = np.empty(n, np.int32)
        self.at[self.order] = np.arange(n, dtype=np.int32)
        self.blocks = max(1, -(-n // BLOCK))
        df = np.bincount(self.term, minlength=size)
        common = np.flatnonzero(df * COMMON > n)
        self.wide = np.full(size, -1, np.int32)
        self.wide[common] = np.arange(len(common), dtype=np.int32)
        self.dense = np.zeros((len(common), self.blocks * BLOCK), np.float32)
        is_wide = self.wide[self.term] >= 0
        self.dense[self.wide[self.term[is_wide]], self.at[of[is_wide]]] = self.impact[is_wide]
        t, e, w = self.term[~is_wide], self.at[of[~is_wide]], self.impact[~is_wide]
        by = np.lexsort((e, t))
        t, self.e, self.w = t[by], e[by].astype(np.int64), w[by]
        # entries (term, block): where their part of the list begins, and their largest weight
        key = t.astype(np.int64) * self.blocks + self.e // BLOCK
        self.head = np.flatnonzero(np.diff(key, prepend=-1))
        self.block = (key[self.head] % self.blocks).astype(np.int32)
        self.most = np.maximum.reduceat(self.w, self.head) if len(self.head) else np.zeros(0)
        self.entry = np.searchsorted(t[self.head], np.arange(size + 1))
        self.head = np.append(self.head, len(t))
        self.ready = True

    def vector(self, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        w = (1 + np.log(times)) * self.weight[terms]
        norm = math.sqrt(float(w @ w))
        return w / norm if norm else w

    def example(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.row[i], self.row[i + 1])
        return self.term[at], self.impact[at]

    def nearest(self, many: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """(cosine, example) of the ``k`` nearest of each unit vector (terms, weights), ties to the smaller example; only those over 0."""
        if not self.ready:
            self._make()
        n = len(self)
        if not n:
            return [[] for _ in many]
        q = np.zeros((len(many), len(self.dense)), np.float32)
        for i, (t, w) in enumerate(many):
            at = self.wide[t]
            q[i, at[at >= 0]] = w[at >= 0]
        common = q @ self.dense
        top = common.reshape(len(many), self.blocks, BLOCK).max(2)
        # vectors are of length 1 at most: no single-precision sum is off by more
        slack = 2 * (len(self.dense) + 64) * 2.0**-24
        return [self._best(*many[i], common[i], top[i], min(k, n), -1 if without is None else without[i], slack) for i in range(len(many))]

    def _best(self, t, w, near, top, k, without, slack) -> list[tuple[float, int]]:
        if not len(t):
            return []
        rare = self.wide[t] < 0
        s, e = self.entry[t[rare]], self.entry[t[rare] + 1]
        entry, weight = _ranges(s, e), np.repeat(w[rare], e - s)
        block = self.block[entry]
        bound = top + np.bincount(block, weight * self.most[entry], self.blocks) + slack
        left = -1 if without < 0 else int(self.at[without])
        score = np.full(self.blocks * BLOCK, -1.0)

        def scan(some: np.ndarray, kth: float) -> float:
            """Scores the examples of some blocks; the k-th best of all so far."""
            mine = np.zeros(self.blocks, bool)
            mine[some] = True
            on = mine[block]
            a, b = self.head[entry[on]], self.head[entry[on] + 1]
            flat = _ranges(a, b)
            got = np.bincount(self.e[flat], self.w[flat] * np.repeat(weight[on], b - a), len(score)) + near
            score.reshape(self.blocks, BLOCK)[some] = got.reshape(self.blocks, BLOCK)[some]
            if left >= 0:
                score[left] = -1.0
            have = score[score > kth]
            return float(np.partition(have, len(have) - k)[len(have) - k]) if len(have) >= k else kth

        # the blocks of the highest bounds give the k-th best to beat, then all that may beat it
        order = np.argsort(-bound, kind="stable")
        first = order[: 1 + 2 * k // BLOCK]
        kth = scan(first, 0.0)
        rest = order[len(first) :]
        rest = rest[bound[rest] > max(kth - slack, 0.0)]
        if len(rest):
            kth = scan(rest, max(kth - slack, 0.0))
        own = self.order[np.flatnonzero(score[: len(self)] > max(kth - 2 * slack, 0.0))].astype(np.int64)
        s, e = self.row[own], self.row[own + 1]
        if not len(own):
            return []
        # these few again, in double precision
        terms = self.term[flat := _ranges(s, e)]
        hit = np.searchsorted(t, terms).clip(0, len(t) - 1)
        shared = np.where(t[hit] == terms, w[hit], 0.0) * self.impact[flat]
        exact = np.round(np.add.reduceat(shared, np.cumsum(e - s) - (e - s)), 14)
        best = np.lexsort((own, -exact))[:k]
        return [(c, p) for c, p in zip(exact[best].tolist(), own[best].tolist(), strict=True) if c > 0]


def _monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: increasing steps, each smoothed by one row at the mean, as the corners (x, value) of a line."""
    mean = float((y * w).sum() / w.sum())
    steps: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        if steps and steps[-1][3] == x[i]:
            steps[-1][1] += y[i] * w[i]
            steps[-1][2] += w[i]
        else:
            steps.append([x[i], y[i] * w[i], w[i], x[i]])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            last = steps.pop()
            steps[-1] = [steps[-1][0], steps[-1][1] + last[1], steps[-1][2] + last[2], last[3]]
    value = [(s[1] + mean * w.mean()) / (s[2] + w.mean()) for s in steps]
    return np.array([x for s in steps for x in (s[0], s[3])]), np.repeat(np.maximum.accumulate(value), 2)


class ToxicityModel:
    """What is learned: terms and their weights, the index of examples, the map to probabilities. Bounded by the sample."""

    def __init__(self, ids: list[int], y: np.ndarray, row: np.ndarray, words: pa.Array, times: np.ndarray, sizes: dict[int, int]):
        """Example i of class y[i] holds the distinct words words[row[i]:row[i + 1]] as often as ``times`` says."""
        self.ids, self.labels = ids, np.asarray(y, np.int64)
        self.prior = sizes.get(1, 0) / sum(sizes.values()) if sum(sizes.values()) else 0.5
        n = np.bincount(self.labels, minlength=2).astype(float)
        #: rows of the table that a sampled row of class 0 or 1 stands for
        self.share = np.array([sizes.get(c, 0) / n[c] if n[c] else 0.0 for c in (0, 1)])
        coded = words.dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        self.words = coded.dictionary if len(coded) else pa.array([], pa.string())
        term = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(coded) else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(ids)), np.diff(row))
        by = np.lexsort((term, of))
        term, times = term[by], np.asarray(times)[by]
        df = [np.bincount(term[self.labels[of] == c], minlength=len(self.words)).astype(float) for c in (0, 1)]
        weight = self._weights(df, n)
        # terms that weigh nothing need no place in the index
        on = weight[term] > 0
        new = np.cumsum(weight > 0) - 1
        row = np.concatenate([[0], np.cumsum(np.bincount(of[on], minlength=len(ids)))])
        self.words = self.words.filter(pa.array(weight > 0))
        self.index = BlockMaxIndex(row, new[term[on]], times[on], weight[weight > 0])
        w, empty = self.share[self.labels], np.diff(row) == 0
        self.blank = float((self.labels * w)[empty].sum() + self.prior) / float(w[empty].sum() + 1)
        self.steps = None

    def _weights(self, df: list[np.ndarray], n: np.ndarray) -> np.ndarray:
        """Inverse document frequency in the table times the contrast of the classes.

        A class's frequency of a term is its share of all the class's (document, term) pairs, so that long
        documents of one class favour no term. What sampling alone may make of a difference, one standard
        error, is taken off; what is left of topic words is little or nothing.
        """
        if not n.all():
            return np.zeros(len(df[0]))
        rows, found = float(self.share @ n), df[0] * self.share[0] + df[1] * self.share[1]
        pairs = np.array([df[0].sum(), df[1].sum()])
        add = SHRINK * pairs / max(1.0, pairs.sum())
        a, b = df[0] + add[0], df[1] + add[1]
        contrast = np.abs(np.log(b / (pairs[1] + add[1])) - np.log(a / (pairs[0] + add[0]))) - np.sqrt(1 / a + 1 / b)
        return np.log((1 + rows) / np.maximum(found, 1e-9)).clip(0) * contrast.clip(0)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The text's terms, in order, and their weights, as a vector of length 1."""
        if "known" not in self.__dict__:  # built by each worker
            self.known = dict(zip(self.words.to_pylist(), range(len(self.words)), strict=True))
        got, known = word_counts(text), self.known
        pairs = [(known[w], c) for w, c in got.items() if w in known]
        pairs = np.array(pairs, np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0])]
        return pairs[:, 0], self.index.vector(pairs[:, 0], pairs[:, 1])

    def calibrate(self, spark: SparkSession) -> None:
        """Learns the map from votes to probabilities from each example's vote without it, worked out by the executors."""
        w = self.share[self.labels]
        if not w.sum() > 0:
            return
        raw = np.zeros(len(w))
        sent = spark.sparkContext.broadcast(self)
        table = spark.createDataFrame(pa.table({"place": pa.array(range(len(w)), pa.int64())})).repartition(spark.sparkContext.defaultParallelism * 2, "place")
        for r in table.mapInArrow(_left_out(sent), "place long, vote double").collect():
            raw[r["place"]] = r["vote"]
        sent.destroy()
        self.steps = _monotone(raw, self.labels.astype(float), w)

    def votes(self, many: list[tuple], without: list[int] | None = None) -> list[tuple[float, list]]:
        """The vote of the nearest, of each: closeness squared, and a little of the blank rate beside."""
        out, most = [], max(1e-9, float(self.share.max()))
        for near in self.index.nearest(many, NEIGHBOURS, without):
            for_it = all_ = 0.0
            for cos, place in near:
                y = int(self.labels[place])
                v = cos * cos * self.share[y] / most
                for_it += v * y
                all_ += v
            out.append(((for_it + _LITTLE * self.blank) / (all_ + _LITTLE), near[:3]))
        return out

    def score(self, texts: list[str]) -> list[tuple[float, list]]:
        out = []
        for raw, near in self.votes([self.vector(t) for t in texts]):
            if self.steps is not None and len(self.steps[0]):
                raw = float(np.interp(raw, *self.steps))
            out.append((min(1.0, max(0.0, raw)), [{"doc_id": self.ids[p], "similarity": c, "label": int(self.labels[p])} for c, p in near]))
        return out


def _left_out(sent):
    def run(batches):
        model = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                places = batch.column(0).slice(at, BATCH)
                p = places.to_pylist()
                votes = [v for v, _ in model.votes([model.index.example(i) for i in p], p)]
                yield pa.RecordBatch.from_arrays([places, pa.array(votes, pa.float64())], ["place", "vote"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> ToxicityModel:
    """Learns from at most 2 * ``per_class`` labelled documents, whose words' counts come to the driver."""
    sample, sizes = labelled_sample(docs, labels, label, per_class)
    found = sample.mapInArrow(_examples, "doc_id long, y int, words array<string>, times array<int>").toArrow()
    # of repeated ids one text counts, the last in the order of its words and counts
    key = found.column("doc_id").to_pylist()
    same: dict[int, list[int]] = {}
    for i, doc_id in enumerate(key):
        same.setdefault(doc_id, []).append(i)
    text = lambda i: (found["words"][i].as_py(), found["times"][i].as_py())
    chosen = [max(at, key=text) if len(at) > 1 else at[0] for _, at in sorted(same.items())]
    found = found.take(pa.array(chosen, pa.int64()))
    words = found.column("words").combine_chunks() if found.num_rows else pa.array([], pa.list_(pa.string()))
    row = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))]).astype(np.int64)
    times = found.column("times").combine_chunks().flatten().to_numpy(zero_copy_only=False) if found.num_rows else np.zeros(0, np.int64)
    model = ToxicityModel(found.column("doc_id").to_pylist(), np.array(found.column("y").to_pylist(), np.int64), row, words.flatten(), times, sizes)
    model.calibrate(docs.sparkSession)
    return model


def _examples(batches):
    """Each example's distinct words, sorted, and how often it holds each."""
    for batch in batches:
        of = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        found = [sorted(word_counts(t or "").items()) for t in of["text"].to_pylist()]
        words, times = pa.array([[w for w, _ in f] for f in found], pa.list_(pa.string())), pa.array([[c for _, c in f] for f in found], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([of["doc_id"], of["y"].cast(pa.int32()), words, times], ["doc_id", "y", "words", "times"])


_EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))


def _score(sent):
    def run(batches):
        model = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                texts = [t or "" for t in part.column(2).to_pylist()]
                own = list(dict.fromkeys(texts))
                known = dict(zip(own, model.score(own), strict=True))
                scores, evidence = pa.array([known[t][0] for t in texts], pa.float64()), pa.array([known[t][1] for t in texts], _EVIDENCE)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), scores, evidence], ["doc_id", "held_out", "score", "evidence"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted, evidence (the three nearest examples), for every row of ``docs``.

    Only text is looked at. A text without any term of the examples, null and empty ones too, gets the
    calibrated rate of such examples; without labels all get 0.5. Null and repeated ids are scored
    alone and never learned from if null. An empty table gives no rows; other columns are ignored
    whatever their names.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    model = fit_toxicity(docs, labels, label, per_class)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    out = rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, held_out boolean, score double, evidence array<struct<doc_id:long,similarity:double,label:int>>")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
