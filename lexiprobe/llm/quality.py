"""Operator 7, quality by hierarchical empirical Bayes.

A document classifier (logistic regression on text statistics, learned on a bounded sample) gives
each document's evidence. Grouped aggregation over all documents sums it up by host and by path
within the host; each host's rate is shrunk to the global one and each path's to its host's, by
strengths that the method of moments takes from the spread between sites. A document's log-odds are
its evidence plus what its path's posterior differs from the global rate. Sites are summed up with
partial aggregation, so a hot host is one row a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiprobe.llm import kernels as K
from lexiprobe.llm.labelled import held_out, labelled_sample
from lexiprobe.llm.shared import cut, small_batches

#: Labelled rows of each class that are learned from, at most.
PER_CLASS = 8_000
#: Up to so many sites their table (under 200 bytes a row) is broadcast; beyond, it is joined by shuffle.
BROADCAST_SITES = 50_000
_CLASSES = {
    "upper": [*range(65, 91)],
    "digit": [*range(48, 58)],
    "stop": [ord(c) for c in ".,;:?'\"()-"],
    "sign": [ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"],
    "break": [10, 13],
    "space": [9, 11, 12, 32],
    "high": [*range(128, 256)],
}
_KIND = np.zeros(256, np.int64)
for _i, _members in enumerate(_CLASSES.values(), 1):
    _KIND[_members] = _i
N_STATS = 13


def text_stats(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """N_STATS numbers a document: shares of byte classes, words' number and length, repetition."""
    n = len(offsets) - 1
    out = np.zeros((n, N_STATS))
    for i, j in K.pieces(offsets):
        offs = offsets[i : j + 1]
        size = np.diff(offs)
        doc = np.repeat(np.arange(j - i), size)
        kinds = np.bincount(doc * 8 + _KIND[data[offs[0] : offs[-1]]], minlength=8 * (j - i)).reshape(j - i, 8)
        out[i:j, :7] = kinds[:, 1:] / np.maximum(size, 1)[:, None]
        starts, ends, of = K.words(data, offs)
        h = K.spans_hash(data, starts, ends, K.LOWER)
        words = np.diff(of)
        own = np.repeat(np.arange(j - i), words)
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
        some = np.maximum(words, 1)
        order = np.lexsort((h, own))
        hs, os_ = h[order], own[order]
        fresh = np.concatenate([[True], (hs[1:] != hs[:-1]) | (os_[1:] != os_[:-1])]) if len(h) else np.zeros(0, bool)
        heads = np.flatnonzero(fresh)
        times = np.diff(np.append(heads, len(h)))
        distinct = np.bincount(os_[heads], minlength=j - i)
        most = np.zeros(j - i)
        np.maximum.at(most, os_[heads], times)
        out[i:j, 7] = np.log1p(words)
        out[i:j, 8] = np.log1p(size / some)
        out[i:j, 9] = distinct / some
        out[i:j, 10] = np.log1p(words) * distinct / some
        out[i:j, 11] = np.bincount(own[again], minlength=j - i) / some
        out[i:j, 12] = most / some
    return out


class QualityModel:
    """Logistic regression on standardised statistics and hinges at their deciles."""

    def __init__(self, x: np.ndarray, y: np.ndarray, share: np.ndarray, prior: float):
        self.prior, self.beta = prior, None
        if len(set(y.tolist())) < 2:
            return
        self.mean, self.std = x.mean(0), x.std(0) + 1e-9
        z = self._scaled(x)
        self.knots = np.quantile(z, [0.1, 0.3, 0.7, 0.9], axis=0)
        f = self._features(x)
        w = share / share.mean()
        beta = np.zeros(f.shape[1])
        for _ in range(40):  # Newton steps with a ridge
            p = 1 / (1 + np.exp(-np.clip(f @ beta, -30, 30)))
            grad = f.T @ (w * (y - p)) - beta
            step = np.linalg.solve((f * (w * p * (1 - p))[:, None]).T @ f + np.eye(len(beta)), grad)
            beta = beta + step
            if np.abs(step).max() < 1e-6:
                break
        self.beta = beta

    def _scaled(self, x):
        return np.clip((x - self.mean) / self.std, -8, 8)

    def _features(self, x):
        z = self._scaled(x)
        return np.concatenate([np.ones((len(x), 1)), z, *(np.maximum(z - k, 0) for k in self.knots)], axis=1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Evidence of documents: the log-odds of quality 1, within 12 of 0."""
        if self.beta is None:
            p = min(max(self.prior, 1e-6), 1 - 1e-6)
            return np.full(len(x), np.log(p / (1 - p)))
        return np.clip(self._features(x) @ self.beta, -12, 12)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> QualityModel:
    """Learns from at most 2 * ``per_class`` labelled documents, whose statistics come to the driver."""
    sample, sizes = labelled_sample(docs, labels, label, per_class)

    def stats(batches):
        for batch in batches:
            x = text_stats(*K.text_buffer(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    rows = sample.select("y", "text").mapInArrow(stats, "y int, x array<double>").collect()
    rows.sort(key=lambda r: (r["y"], r["x"]))
    y = np.array([r["y"] for r in rows], float)
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), N_STATS)
    own = [max(1, int((y == c).sum())) for c in (0, 1)]
    share = np.array([sizes.get(int(c), 0) / own[int(c)] for c in y])
    return QualityModel(x, y, share, sizes.get(1, 0) / sum(sizes.values()) if sizes else 0.5)


def evidence_of(model: QualityModel):
    """A column function: text to log-odds."""

    @F.pandas_udf(T.DoubleType())
    def evidence(text: pd.Series) -> pd.Series:
        out = [model.log_odds(text_stats(*K.text_buffer(pa.array(text.iloc[i : i + 512].tolist(), pa.string())))) for i in range(0, len(text), 512)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return evidence


def _logit(p):
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    return F.log(p / (1 - p))


def _strength(n, mean, spread, squares, groups, total):
    """Pseudo-rows of a prior by the method of moments: within-site variance over the spread between sites."""
    inside = mean * (1 - mean)
    room = max(total - squares / total, 1e-9) if total else 1e-9
    between = max((spread - (groups - 1) * inside) / room, 1e-9)
    return float(min(1e6, max(1.0, inside / between - 1)))


def site_posteriors(evidence: DataFrame) -> tuple[DataFrame, float]:
    """From (host, path, p): a row for each path with host_rate, path_rate; and the global rate."""
    paths = cut(evidence.groupBy("host", "path").agg(F.sum("p").alias("y"), F.count(F.lit(1)).alias("n")))
    hosts = cut(paths.groupBy("host").agg(F.sum("y").alias("hy"), F.sum("n").alias("hn")))
    y, n, groups, squares = hosts.agg(F.sum("hy"), F.sum("hn"), F.count(F.lit(1)), F.sum(F.col("hn").cast("double") * F.col("hn"))).first()
    if not n:
        return paths.select("host", "path", F.lit(0.5).alias("host_rate"), F.lit(0.5).alias("path_rate")), 0.5
    mean = y / n
    spread = hosts.agg(F.sum(F.col("hn") * F.pow(F.col("hy") / F.col("hn") - mean, 2))).first()[0]
    k = _strength(n, mean, spread, squares, groups, n)
    hosts = hosts.withColumn("host_rate", (F.col("hy") + k * mean) / (F.col("hn") + k))
    both = paths.join(hosts, paths.host.eqNullSafe(hosts.host)).drop(hosts.host)
    inner = both.agg(
        F.sum(F.col("n") * F.pow(F.col("y") / F.col("n") - F.col("host_rate"), 2)), F.count(F.lit(1)), F.sum(F.col("n").cast("double") * F.col("n") / F.col("hn"))
    ).first()
    k2 = _strength(n, mean, inner[0], inner[2] * n / max(1, groups), inner[1] - groups + 1, n)
    return both.select("host", "path", "host_rate", ((F.col("y") + k2 * F.col("host_rate")) / (F.col("n") + k2)).alias("path_rate")), mean


def score_quality(docs: DataFrame, labels: DataFrame, host, path, label: str = "quality", per_class: int = PER_CLASS, carry: bool = False) -> DataFrame:
    """doc_id, held_out, evidence, host_rate, path_rate, score, keep (score >= 0.5), for every row of ``docs``.

    ``host`` and ``path`` are columns (or their expressions) of ``docs``; nulls are a site of their
    own. With ``carry`` the result is the input's rows and columns that are kept instead, found
    without moving a text. Learned labels take the place of the classifier's probability in the
    sums of their sites. Null text counts as empty and is judged by its site and by what empty texts
    look like; null or repeated ids are judged alone; an empty table gives no rows; clashing column
    names do no harm, as inputs are wrapped before anything is added.
    """
    small_batches(docs.sparkSession)
    row = docs.select(F.struct("*").alias("__row"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit_quality(row.select("doc_id", "text"), labels, label, per_class)
    evidence = evidence_of(model)
    slim = cut(row.select("doc_id", "host", "path", evidence("text").alias("evidence")))
    known = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("double").alias("__y")).filter(F.col("__y").isin(0.0, 1.0) & ~held_out(F.col("__id")))
    known = known.groupBy("__id").agg(F.max("__y").alias("__y"))
    p = F.coalesce("__y", 1 / (1 + F.exp(-F.col("evidence"))))
    sites, mean = site_posteriors(slim.join(known, slim.doc_id == known["__id"], "left").select("host", "path", p.alias("p")))
    sites = cut(sites.select(F.col("host").alias("__h"), F.col("path").alias("__p"), "host_rate", "path_rate"))
    if sites.count() <= BROADCAST_SITES:
        sites = F.broadcast(sites)
    left = row.select("__row", "host", "path", evidence("text").alias("evidence")) if carry else slim
    out = left.join(sites, F.col("host").eqNullSafe(F.col("__h")) & F.col("path").eqNullSafe(F.col("__p")), "left")
    odds = F.col("evidence") + _logit(F.col("path_rate")) - _logit(F.lit(float(mean)))
    out = out.withColumn("score", 1 / (1 + F.exp(-odds)))
    if carry:
        return out.filter("score >= 0.5").select("__row.*")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "evidence", "host_rate", "path_rate", "score", (F.col("score") >= 0.5).alias("keep"))


def documents_sites():
    """Documents' hosts are their sources; paths are the languages within."""
    return F.col("source"), F.concat_ws("/", F.col("source"), F.col("lang"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), *documents_sites())
