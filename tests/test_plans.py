"""Interval joins, ranks of replicates and subspaces against plain versions, at sizes where the plain plan would not do."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiprobe.operators import bootstrap as B
from lexiprobe.operators import joins as J
from lexiprobe.operators import splits as S
from lexiprobe.operators import subspaces as G
from lexiprobe.operators import summaries as U


def intervals(seed, n, top, wide):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = rng.randrange(top)
        out.append((rng.choice("ab"), i, s, s + rng.choice((0, 1, 3, 64, 65, 500, wide))))
    return out


@pytest.mark.parametrize("wide", [700, 40_000])
def test_overlaps_equal_all_pairs(spark, wide):
    t, s = intervals(1, 120, 3000, wide), intervals(2, 90, 3000, 9 * wide)
    df = lambda rows: spark.createDataFrame(rows, "k string, i int, s long, e long")
    got = J.overlapping(df(t), df(s), "k").select("t.i", F.col("s.i").alias("j")).collect()
    want = [(a[1], b[1]) for a in t for b in s if a[0] == b[0] and a[2] < b[3] and b[2] < a[3]]
    assert sorted(map(tuple, got)) == sorted(want)
    scopes = df(s).select("k", "s", "e", F.concat(F.lit("x"), "i").alias("scope"))
    got = {(r.k, r.i): r.scope for r in J.innermost(df(t).select("k", "i", F.col("s").alias("pos")), scopes, "k", "pos", "i").collect()}
    best = lambda a: min(((b[3] - b[2], f"x{b[1]}") for b in s if a[0] == b[0] and b[2] <= a[2] < b[3]), default=(0, None))[1]
    assert got == {(a[0], a[1]): best(a) for a in t}


def test_one_program_of_many_spans(spark):
    n = 100_000
    tokens = spark.range(n).select(F.lit("p").alias("k"), (F.col("id") * 7).alias("s"), (F.col("id") * 7 + 5).alias("e"))
    spans = spark.range(n).select(F.lit("p").alias("k"), (F.col("id") * 7 + 3).alias("s"), (F.col("id") * 7 + 8).alias("e")).unionByName(spark.createDataFrame([("p", 0, 7 * n)], "k string, s long, e long"))
    began = time.time()
    assert J.overlapping(tokens, spans, "k").count() == n + (n - 1) + n
    assert time.time() - began < 120  # all pairs would be 10^10


def test_ranks_and_sums_over_parts(spark):
    rows = spark.createDataFrame([(i * 37 % 101, i % 3) for i in range(500)], "v int, g int").repartition(7)
    got = S.global_rank(rows, [F.col("v"), F.col("g")], "r").collect()
    assert sorted(r.r for r in got) == list(range(1, 501))
    ordered = sorted(got, key=lambda r: r.r)
    assert [(r.v, r.g) for r in ordered] == sorted((r.v, r.g) for r in got)
    assert S.global_rank(rows.limit(0), [F.col("v")], "r").count() == 0
    sums = S.running(rows, ["g"], [F.col("v")], F.col("v"), "before").collect()
    for g in range(3):
        own = sorted((r.v, r.before) for r in sums if r.g == g)
        assert sorted(b for _, b in own) == [sum(v for v, _ in own[:i]) for i in range(len(own))]


def plain_rho(x, y):
    def ranks(v):
        v = np.array(v)
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    return float(np.corrcoef(ranks(x), ranks(y))[0, 1]) if len(set(x)) > 1 and len(set(y)) > 1 else float("nan")


def test_weighted_rank_correlation_is_that_of_copied_rows():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x, y, w = rng.integers(0, 4, 12), rng.integers(0, 5, 12), rng.integers(0, 4, 12)
        w[0] += 2
        got, want = U.weighted_rho(x, y, w.astype(float)), plain_rho(np.repeat(x, w), np.repeat(y, w))
        assert got == pytest.approx(want, abs=1e-12, nan_ok=True)


@pytest.mark.parametrize("cells", [10_000, 0])
def test_clustered_rank_interval_both_ways(spark, monkeypatch, cells):
    monkeypatch.setattr(U, "CELLS", cells)  # without cells, replicates are shuffled
    rng = random.Random(5)
    rows = [(f"c{rng.randrange(6)}", rng.randrange(5) * 1.0, rng.randrange(4) * 1.0) for _ in range(80)] + [("c1", None, 1.0), (None, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "c string, x double, y double")
    drawn = {}
    for r in B.draws(df, "c", 30).collect():
        drawn.setdefault(r.replicate, {})[r.c] = r.times
    rhos = []
    for times in drawn.values():
        taken = [(x, y) for c, x, y in rows if x is not None and c is not None for _ in range(times.get(c, 0))]
        rhos.append(plain_rho([t[0] for t in taken], [t[1] for t in taken]))
    rhos = [r for r in rhos if r == r]
    got = U.spearman_interval(df, "x", "y", "c", 30).first()
    assert (got.lo, got.hi, got.n_boot) == (pytest.approx(np.percentile(rhos, 2.5), abs=1e-9), pytest.approx(np.percentile(rhos, 97.5), abs=1e-9), len(rhos))
    full = [(x, y) for _, x, y in rows if x is not None]
    assert got.point == pytest.approx(plain_rho([a for a, _ in full], [b for _, b in full]), abs=1e-9)


def vectors(spark):
    rng = np.random.default_rng(7)
    rows = [("a" if i % 3 else "b", (rng.normal(size=6) * [5, 3, 1, 1, 1, 1] + 1000 + (i % 3)).tolist()) for i in range(90)] + [("c", [1.0] * 6), (None, [2.0] * 6)]
    return rows, spark.createDataFrame([*rows, ("a", None)], "g string, v array<double>").repartition(5)


def test_moments_and_angles(spark):
    rows, df = vectors(spark)
    found = G.moments(df, "v", "g")
    for name in ("a", "b", "c", None):
        x = np.array([v for g, v in rows if g == name])
        assert found[name].n == len(x) and np.allclose(found[name].mean, x.mean(axis=0))
        assert np.allclose(found[name].products, (x - x.mean(axis=0)).T @ (x - x.mean(axis=0)), atol=1e-6)
    got = {(r.other, r.k): r.mean_degrees for r in G.subspace_angles(df, "v", "g", "a", [1, 3, 50]).collect()}
    top = lambda name, k: np.linalg.svd(np.array([v for g, v in rows if g == name]) - found[name].mean, full_matrices=False)[2][:k].T
    for k in (1, 3):
        want = np.degrees(np.arccos(np.clip(np.linalg.svd(top("a", k).T @ top("b", k), compute_uv=False), -1, 1))).mean()
        assert got["b", k] == pytest.approx(want, abs=1e-6)
    assert got["b", 50] == pytest.approx(0, abs=1e-9) and np.isnan(got["c", 1]) and G.moments(df.limit(0), "v") == {}
    with pytest.raises(Exception, match="entries"):
        G.moments(spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "v array<double>").coalesce(1), "v")


def test_small_angles_keep_their_digits():
    a, tiny = np.eye(4)[:, :2], 1e-9
    b = np.array([[np.cos(tiny), 0], [0, 1.0], [np.sin(tiny), 0], [0, 0]])
    assert G.principal_angles(a, b)[0] == pytest.approx(tiny, rel=1e-6)
    assert np.degrees(G.principal_angles(a, np.eye(4)[:, 1:4])) == pytest.approx([90, 0], abs=1e-9)


def test_coordinates_and_ellipses(spark):
    rows, df = vectors(spark)
    placed = G.principal_coordinates(df.filter("g <> 'c'"), "v", 2).select("g", F.col("coordinates")[0].alias("x"), F.col("coordinates")[1].alias("y"))
    assert placed.filter("x IS NULL").count() == 1
    known = placed.filter("x IS NOT NULL")
    for r in G.covariance_ellipses(known, "x", "y", ["g"]).collect():
        p = np.array([(q.x, q.y) for q in known.filter(F.col("g") == r.g).collect()])
        values, axes = np.linalg.eigh(np.cov(p.T))
        assert (r.width, r.height) == (pytest.approx(4 * np.sqrt(values[1])), pytest.approx(4 * np.sqrt(values[0])))
        assert abs(np.cos(np.radians(r.degrees)) * axes[0, 1] + np.sin(np.radians(r.degrees)) * axes[1, 1]) == pytest.approx(1)
    one = G.covariance_ellipses(spark.createDataFrame([("a", 1.0, 2.0)], "g string, x double, y double"), "x", "y", ["g"]).first()
    assert (one.n, one.width, one.degrees) == (1, None, None)
