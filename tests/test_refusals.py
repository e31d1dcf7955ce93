"""What is refused or decoded: pairings of predictions, tolerances by dtype, cluster numbers; and fits in one job a step."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiprobe.operators.batched_fits import fit_probes
from lexiprobe.operators.joins import Refused, paired_predictions
from lexiprobe.plans import gates, prompts
from lexiprobe.streaming import leases


def predictions(spark, keys, flip=(), seed=0):
    return spark.createDataFrame([(k, seed, int(k in flip), 1, f"c{i % 3}") for i, k in enumerate(keys)], "id string, seed int, y_true int, y_pred int, cluster string")


def test_pairings_need_shared_keys_and_one_truth(spark):
    a = predictions(spark, [f"k{i}" for i in range(20)] + [None])
    assert paired_predictions(a, predictions(spark, [f"k{i}" for i in range(2, 40)]), "id").count() == 18
    with pytest.raises(Refused, match="17 keys are shared of 20"):
        paired_predictions(a, predictions(spark, [f"k{i}" for i in range(3, 40)]), "id")
    assert paired_predictions(a, predictions(spark, [f"k{i}" for i in range(3, 40)]), "id", partial=True).count() == 17
    with pytest.raises(Refused, match="y_true differs for 1 of 20"):
        paired_predictions(a, predictions(spark, [f"k{i}" for i in range(20)], flip=("k3",)), "id", partial=True)
    with pytest.raises(Refused, match="twice"):
        paired_predictions(a, predictions(spark, ["k1", "k1"]), "id")
    with pytest.raises(Refused, match="no seed"):
        paired_predictions(a, predictions(spark, ["k1"], seed=1), "id")


def test_tolerance_follows_the_rows_dtype(spark):
    base = spark.createDataFrame([(0.001, "p", 0, "x", "denoise", "target", 0.0, 0.0)], "baseline_drift double, pair_id string, layer int, span string, direction string, control string, source_D double, signed_effect double")
    seen = []
    original = gates.identity_tolerance
    gates.identity_tolerance = lambda drift, dtype="float16": seen.append(dtype) or original(drift, dtype)
    try:
        for rows in (base, base.withColumn("dtype", F.lit("Float32")), base.withColumn("dtype", F.lit("fp16")), base.withColumn("dtype", F.lit(None).cast("string")), base.withColumn("dtype", F.lit("float32")).unionByName(base.withColumn("dtype", F.lit("float16")))):
            gates.smoke_gate(rows, 18)
    finally:
        gates.identity_tolerance = original
    assert seen == ["float16", "float32", "float16", "float16", "float16"]


def test_cluster_numbers_decode(spark):
    rows = prompts.prompt_pairs(spark).select("cluster_id", "prefix_id", "body_id", "gap_id", prompts.decoded_cluster(F.col("cluster_id")).alias("d"))
    assert rows.filter("d.prefix_id <> prefix_id OR d.body_id <> body_id OR d.gap_id <> gap_id").count() == 0
    out = spark.range(3).select(prompts.decoded_cluster(F.col("id") * 1000 - 1000).alias("d")).collect()
    assert [r.d is None for r in out] == [True, False, True]


def plain_fit(x, y, c, balanced):
    """Newton's method on one fit."""
    mean, deviation = x.mean(axis=0), x.std(axis=0)
    deviation[deviation == 0] = 1
    z = np.column_stack([(x - mean) / deviation, np.ones(len(x))])
    k = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum())) if balanced else np.ones(len(y))
    w, flat = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], 1 / c), 0)
    for _ in range(40):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve((z * (k * p * (1 - p))[:, None]).T @ z + np.diag(flat), z.T @ (k * (p - y)) + flat * w)
    return w[:-1] / deviation, w[-1] - (w[:-1] / deviation) @ mean


@pytest.mark.parametrize("balanced", [True, False])
def test_all_fits_advance_in_one_job_a_step(spark, balanced):
    rng = np.random.default_rng(2)
    layers, seeds, n = 3, 4, 150
    data, rows = {}, []
    for layer in range(layers):
        for i in range(n):
            y = int(rng.random() < 0.3)
            v = (rng.normal(size=4) * [1, 5, 0.1, 0] + [y * layer, 3, 0, 7]).tolist()
            use = [bool(rng.random() < 0.6) for _ in range(seeds - 1)] + [y == 1]
            rows.append((layer, v, y, use))
            for s, u in enumerate(use):
                if u:
                    data.setdefault((layer, s), []).append((v, y))
    df = spark.createDataFrame(rows, "layer int, vec array<double>, y int, use array<boolean>").repartition(3)
    jobs = {}
    for name, part in (("one", df.filter("layer = 0").withColumn("use", F.slice("use", 1, 1))), ("all", df)):
        spark.sparkContext.setJobGroup(f"{name}-{balanced}", name)
        got = fit_probes(part, 2.0, balanced)
        jobs[name] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"{name}-{balanced}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert set(got) == {(layer, s) for layer in range(layers) for s in range(seeds - 1)}  # the last seed's folds have one class
    for key, (w, b) in got.items():
        x, y = np.array([v for v, _ in data[key]]), np.array([t for _, t in data[key]])
        want, bias = plain_fit(x, y, 2.0, balanced)
        assert np.allclose(w, want, atol=1e-6) and b == pytest.approx(bias, abs=1e-5)
    assert jobs["all"] <= 2 * jobs["one"]  # nine fits take the steps of the slowest one


def test_leases_of_events_equal_a_plain_loop(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"r{rng.randrange(4)}", f"h{rng.randrange(3)}", rng.choice(["acquire", "acquire", "heartbeat", "release"]), float(rng.randrange(5000)), i) for i in range(300)]
    rows.sort(key=lambda r: (r[3], r[4]))
    for part in range(3):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], leases.REQUEST).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    leases.stream_leases(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    held, want = {}, {}
    for resource, holder, action, at, seq in rows:
        held[resource], granted, _ = leases.answer(held.get(resource), holder, action, at)
        want[seq] = granted
    assert {r.seq: r.granted for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
