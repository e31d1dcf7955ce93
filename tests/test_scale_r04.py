"""Findings of round 4: what a task held grew with its Arrow batch, what a fit shuffled with its partitions."""

import re

import pyarrow as pa
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors

from lexiprobe.functions import text as X
from lexiprobe.operators import models as M


def test_features_leave_a_task_by_blocks(monkeypatch):
    """a batch's vectors are not held together; those of a text longer than a block are those of the whole text."""
    texts = [None, b"", b"ab ab cd"] + [b"ab cd ef gh"] * 60 + [b"ab ef " * 90 + b"cd", b" \t", b"zz", b"gh"]
    vocabulary, weights = [" a", "ab", " ef ", "cd", "gh "], [1.0, 2.0, 3.0, 1.5, 1.25]
    cut = M._gram_features(vocabulary, weights, 2, 4).func
    whole = pa.concat_arrays(list(cut(iter([pa.array(texts, pa.binary())])))).to_pylist()
    monkeypatch.setattr(X, "BLOCK_CHARS", 64)
    parts = list(cut(iter([pa.array(texts[:50], pa.binary()), pa.array([], pa.binary()), pa.array(texts[50:], pa.binary())])))
    assert len(parts) > 10 and max(len(p) for p in parts) < 20
    got = pa.concat_arrays(parts).to_pylist()
    assert len(got) == len(texts)
    for t, a, b in zip(texts, got, whole, strict=True):
        words = [f" {w} " for w in (t or b"").decode().split()]
        x = [sum(w[i:].startswith(g) for w in words for i in range(len(w))) * weight for g, weight in zip(vocabulary, weights, strict=True)]
        norm = sum(v * v for v in x) ** 0.5 or 1.0
        assert a["size"] == 5 and a["indices"] == b["indices"] == [i for i, v in enumerate(x) if v]
        assert a["values"] == pytest.approx([v / norm for v in x if v]) and a["values"] == pytest.approx(b["values"])
    assert list(cut(iter([]))) == []


def test_a_fit_has_few_partitions(spark, monkeypatch):
    """partitions of a fit, each of which shuffles a vector of the weights in every step, are bounded by the cores."""
    rows = spark.createDataFrame([(Vectors.dense([float(i % 7), float(i % 3)]), float(i % 2)) for i in range(200)], ["features", "y"]).repartition(150)
    seen, fit = [], LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, d, *a: seen.append((d.rdd.getNumPartitions(), d.count())) or fit(self, d, *a))
    M.fit_logistic(rows)
    assert seen[0][1] == 200 and seen[0][0] <= 4 * spark.sparkContext.defaultParallelism


def test_features_of_a_baseline_are_not_kept(spark, tmp_path):
    """of texts and features nothing is kept for the figures but fold, label and prediction."""
    docs = spark.createDataFrame([(i, f"{'zuq zuq' if i % 2 else 'bam bam'} w{i % 5}", f"s{i % 30}", float(i % 2)) for i in range(120)], "doc_id long, text string, source string, y double")
    docs.write.parquet(f"{tmp_path}/docs")
    rows = spark.read.parquet(f"{tmp_path}/docs").join(docs.select("doc_id").distinct(), "doc_id")
    found = M.surface_baseline(rows, "doc_id", "text", "y", "source", 0)
    kept = re.findall(r"InMemoryRelation \[([^\]]*)\]", found._jdf.queryExecution().withCachedData().toString())
    kept = [{c.split("#")[0] for c in k.split(", ")} for k in kept]
    assert {"fold", "y", "y_pred"} in kept and not any("features" in k for k in kept)
    assert all(r["ngram_f1"] == 1.0 > r["majority_f1"] for r in found.collect())
