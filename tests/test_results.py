"""Summaries, published tables, stores, sweeps and baselines on small tables of our own."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lexiprobe.operators import models as L
from lexiprobe.operators import occurrences as O
from lexiprobe.operators import summaries as U
from lexiprobe.operators.joins import Refused
from lexiprobe.sources import reports as R
from lexiprobe.sources import tables as T
from lexiprobe.streaming import store as I


def test_nothing_to_divide_by(spark):
    """No rows, weights of 0 and no spread give nulls, not errors."""
    rows = spark.createDataFrame([("a", 1.0, 1.0, 0.0), ("b", 2.0, 3.0, 1.0), ("b", 2.0, 4.0, 1.0)], "g string, x double, y double, w double")
    got = {r["g"]: r for r in U.weighted_agreement(rows, "x", "y", "w", ["g"]).collect()}
    assert got["a"]["agreement"] is None and got["a"]["sign_disagreement"] is None and got["b"]["agreement"] is None and got["b"]["sign_disagreement"] == 0
    out = U.layer_effects(spark.createDataFrame([(0, 0.0, 1.0, None), (0, float("nan"), 2.0, 0.0)], "layer int, clean double, changed double, c double"), "layer", "clean", "changed", ["c"]).first()
    assert (out["n"], out["clean_mean"], out["effect_mean"], out["c_n"], out["c_ratio"]) == (2, 0.0, None, 1, None)
    assert U.surviving_mass(rows.limit(0), "x", "y", "w").first()["surviving_mass"] == 0.0
    assert U.scope_summaries(rows.withColumn("z", F.lit(0.0)), ["g"], [], "x", "y", gap="z").filter("recovery IS NOT NULL").count() == 0


def test_refusals_of_results(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "id int, y string")
    with pytest.raises(Refused):
        U.unique_counts(rows, ["y"], "id")
    with pytest.raises(Refused):
        U.restricted(rows, spark.range(100).select(F.col("id").cast("int")), "id")
    with pytest.raises(Refused):
        U.require_disjoint(rows, rows.filter("id = 1"), ["id"])
    with pytest.raises(ValueError):
        U.split_group("other")
    with pytest.raises(ValueError):
        R.one_model(rows, "y")
    side = rows.select("id", *(F.lit(1.0).alias(c) for c in ("source", "destination", "patched", "signed_effect")))
    with pytest.raises(Refused):
        U.probe_link(side, side.filter("id = 1"), "id")
    assert U.matches_prior({"f1": 0.9}, {"f1": 0.9015})["pass"] and not U.matches_prior({"f1": 0.9}, {"f1": 0.91})["pass"]
    assert R.one_model(rows.filter("id = 1"), "y") == "x" and R.one_model(rows.limit(0), "y") is None


def test_best_of_and_strongest(spark):
    rows = spark.createDataFrame([("a", "p", float("nan")), ("a", "q", 0.5), ("a", "r", 0.5), ("b", "p", None)], "g string, k string, f double")
    assert [tuple(r) for r in U.strongest(rows, ["g"], "k", "f").collect()] == [("a", "r", 0.5)]
    assert rows.select(U.best_of(F.col("f"), F.lit(float("inf"))).alias("b")).filter("b IS NULL").count() == 2


def test_baselines_belong_to_the_original(spark):
    cells = spark.createDataFrame([("i", "original", 1.0), ("i", "C1", 2.0), ("j", "original", 3.0)], "role string, condition string, f double")
    out = {(r["role"], r["condition"]): r["b"] for r in U.with_baselines(cells, spark.createDataFrame([("i", 9.0)], "role string, b double"), ["role"]).collect()}
    assert out == {("i", "original"): 9.0, ("i", "C1"): None, ("j", "original"): None}


def test_markers_steps_and_parts(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    path = f"{tmp_path}/out"
    assert R.marked(spark, path) is None
    assert R.write_marked(rows, path, {"n": F.count(F.lit(1))}) == {"n": 2} == R.marked(spark, path)
    ran = []
    assert R.run_once(spark, f"{tmp_path}/once", lambda: ran.append(1) or rows) and not R.run_once(spark, f"{tmp_path}/once", lambda: ran.append(1) or rows) and ran == [1]
    R.checkpoint_part(rows, f"{tmp_path}/parts", "strategy", "one")
    R.checkpoint_part(rows.limit(1), f"{tmp_path}/parts", "strategy", "two")
    R.checkpoint_part(rows.limit(1), f"{tmp_path}/parts", "strategy", "two")
    assert {r["strategy"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/parts").groupBy("strategy").count().collect()} == {"one": 2, "two": 1}


def test_wide_and_long(spark):
    rows = spark.createDataFrame([("s", 0, 0.1), ("s", 1, 0.2), ("t", 1, 0.3)], "k string, layer int, c double")
    wide = R.pivoted(rows, ["k"], "layer", [0, 1], "c", "layer_")
    assert {tuple(r) for r in wide.collect()} == {("s", 0.1, 0.2), ("t", None, 0.3)}
    assert {tuple(r) for r in R.unpivoted(wide, ["k"], "layer_", "layer", "c").filter("c IS NOT NULL").collect()} == {tuple(r) for r in rows.collect()}
    m = R.symmetric_matrix(spark.createDataFrame([("a", "b", 3)], "x string, y string, n int"), "x", "y", "n", ["a", "b", "c"])
    assert {tuple(r) for r in m.collect()} == {("a", None, 3, 0), ("b", 3, None, 0), ("c", 0, 0, None)}


def test_chunk_store(spark, tmp_path):
    schema = "model_id string, dtype string, configuration string, layer int, pair_id string, v double"
    store = I.ChunkStore(spark, str(tmp_path / "run"), schema, ["layer", "pair_id"])
    names = {"model_id": "Org/M 1", "dtype": "float16", "configuration": "c" * 40, "phase": "primary", "layer": 3, "block": 0}
    row = lambda p, v, layer=3: ("Org/M 1", "float16", "c" * 40, layer, p, v)
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    first = store.write_block(rows(row("a", 1.0)), **names)
    assert first["path"] == f"chunks/Org--M--1/float16/{'c' * 16}/primary/L003/B0000" and store.path_of("m", "d", "c", "p", -1, 2).endswith("baseline/B0002")
    assert store.write_block(rows(row("a", 1.0)), **names) == first  # again: nothing changes
    second = store.write_block(rows(row("b", 2.0)), **names)
    assert second["rows"] == 2 and sorted(r["pair_id"] for r in store.load(strict=True).collect()) == ["a", "b"]
    for bad in (rows(row("a", 9.0)), rows(row("z", 1.0, layer=4))):
        with pytest.raises(Refused):
            store.write_block(bad, **names)
    store.write_block(rows(row("a", 5.0)), **names | {"block": 1})
    with pytest.raises(Refused):  # one key in two blocks
        store.load().collect()
    other = store.write_block(rows(row("q", 1.0)), merge=False, **names | {"block": 1})
    assert store.load(phase="primary").count() == 3 and store.load(phase="other").count() == 0
    folder = tmp_path / "run" / other["folder"]
    for part in folder.glob("part-*"):
        part.write_text(part.read_text().replace("1.0", "7.0"))
    for crc in folder.glob(".*.crc"):
        crc.unlink()
    assert store.load().count() == 2
    with pytest.raises(Refused):
        store.load(strict=True)
    with pytest.raises(Refused):
        store.write_block(rows(row("r", 1.0)), repair=False, **names | {"block": 1})
    assert store.write_block(rows(row("q", 1.0), row("r", 1.0)), **names | {"block": 1})["rows"] == 2 and store.load(strict=True).count() == 4
    with pytest.raises(Refused):
        store.path_of("//", "d", "c", "p", 0, 0)


def test_synthetic_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text('example_id,code\n3,"a = 1\nb = 2"\nx,z\n1,y\n2,\n')
    assert [tuple(r) for r in T.read_synthetic(spark, str(tmp_path / "s.csv")).collect()] == [(0, "z"), (1, "y"), (3, "a = 1\nb = 2")]
    assert T.project_repository(spark.createDataFrame([("java",)], "language string")).first()["repo"] is None


def planted(spark, n=240, layers=3, seed=3):
    """Vectors of which layer 1 tells the label, layer 2 a little."""
    rng = random.Random(seed)
    shift = {0: 0.0, 1: 3.0, 2: 0.8}
    rows = [(layer, f"g{i}", i % 2, f"n{i % 7}", [rng.gauss(shift[layer] * (i % 2) if j == 0 else 0.0, 1.0) * (j + 1) + j for j in range(4)]) for i in range(n) for layer in range(layers)]
    return spark.createDataFrame(rows, "layer int, g string, y int, name string, vec array<double>")


def test_sweep_persistence_and_transfer(spark, tmp_path):
    rows = planted(spark).persist()
    probes, curves, chosen = L.layer_sweep(rows, "g", "y", "vec", [0, 1])
    summary = L.sweep_summary(chosen)
    assert summary["selected_layers"] == [1, 1] and summary["selected_layer"] == 1 and summary["test_f1_mean"] > 0.85
    assert curves.count() == 3 * 2 * 3 and probes.count() == 6
    with pytest.raises(Refused):
        L.layer_sweep(rows.withColumn("y", F.lit(1)), "g", "y", "vec", [0])
    # probes apply elsewhere, and only as they were written
    L.write_probes(probes, str(tmp_path / "p"), {"model_id": "m", "label_field": "y"})
    again = L.read_probes(spark, str(tmp_path / "p"), {"model_id": "m"})
    for r in L.evaluate_probes(planted(spark, seed=8), again, "y").collect():
        assert r["macro_f1"] > 0.85 if r["layer"] == 1 else r["macro_f1"] < 0.85
    with pytest.raises(Refused):
        L.read_probes(spark, str(tmp_path / "p"), {"model_id": "other"})
    meta = json.loads(spark.read.text(str(tmp_path / "p/metadata")).first()[0]) | {"sha256": "0"}
    spark.createDataFrame([(json.dumps(meta),)], "value string").write.mode("overwrite").text(str(tmp_path / "p/metadata"))
    with pytest.raises(Refused):
        L.read_probes(spark, str(tmp_path / "p"), {"model_id": "m"})
    assert {(r["layer_a"], r["layer_b"]) for r in L.nearest_layers(rows, spark.range(5).select(F.col("id").alias("layer"))).collect()} == {(0, 0), (1, 2), (2, 4)}
    matrix = {(m["source"], m["target"]): m["macro_f1"] for m in L.cross_model_matrix({"a": probes.filter("layer = 1")}, {"a": rows.filter("layer = 1")}, "y")}
    assert matrix["a", "a"] > 0.85


def test_probe_link_fit_and_selectivity(spark):
    rows = planted(spark).filter("layer = 1").drop("layer")
    fit = L.fit_probe_link(rows, "g", "y", "vec", [0, 1])
    assert fit["probes"].count() == 2 and fit["test_f1_mean"] > 0.85
    assert L.fit_probe_link(rows, "g", "y", "vec", [0], expected_splits={0: fit["splits"][0]})["splits"] == {0: fit["splits"][0]}
    with pytest.raises(Refused):
        L.fit_probe_link(rows, "g", "y", "vec", [0], expected_splits={0: 1})
    with pytest.raises(Refused):
        L.fit_probe_link(rows.withColumn("y", F.lit(0)), "g", "y", "vec", [0])
    got = L.selectivity(planted(spark).filter("layer = 1"), "g", "name", "y", "vec", [0])
    assert got["selectivity"] == pytest.approx(got["macro_f1"] - got["control_macro_f1"]) and got["selectivity"] > 0.2


def test_scaling_is_that_of_a_population(spark):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = spark.createDataFrame([([1.0, 5.0],), ([2.0, 5.0],), ([6.0, 5.0],)], "v array<double>").select(array_to_vector("v").alias("raw"))
    got = [r[0] for r in L.scaled(rows, rows)[0].select(vector_to_array("features")).collect()]
    sd = math.sqrt(((1 - 3) ** 2 + (2 - 3) ** 2 + (6 - 3) ** 2) / 3)
    assert [x for x, _ in got] == pytest.approx([-2 / sd, -1 / sd, 3 / sd]) and all(z == 0 for _, z in got)


def texts(spark, n=120, swap=False):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        y = i % 2
        said = f"for VAR in {rng.choice(['xs', 'ys'])} {{" if y else f"VAR = {rng.choice(['True', 'False'])};"
        rows.append((f"o{i}", f"p{i}", "iterator" if y else "boolean", rng.choice(["i", "j"]) if y else rng.choice(["ok", "done"]), float(i % 5), said, "same everywhere", said if not swap else said.replace("for", "loop")))
    return spark.createDataFrame(rows, "occurrence_id string, problem string, y string, name_only string, size double, line_masked string, statement_masked string, window_masked string")


def test_surface_baselines(spark):
    figures, predictions = L.surface_baselines(texts(spark), "occurrence_id", "y", "problem", [0], ["size"])
    f1 = {r["family"]: r["macro_f1"] for r in figures.collect()}
    assert set(f1) == {"majority", "covariates_only", *L.FAMILIES}
    assert f1["line_masked"] == f1["name_only"] == f1["window_masked"] == 1.0 and f1["majority"] < 0.5 and f1["statement_masked"] < 0.7
    rows = predictions.collect()
    assert rows and {r["family"] for r in rows} == {"window_masked"} and all(r["y_true"] == r["y_pred"] and r["cluster"] for r in rows)
    with pytest.raises(Refused):
        L.surface_baselines(texts(spark).withColumn("occurrence_id", F.lit("one")), "occurrence_id", "y", "problem", [0], [])


def test_mechanism(spark):
    out = L.mechanism(texts(spark), texts(spark, swap=True), "occurrence_id", "problem", "iterator", "y", texts=("line_masked",), classes=("brace", "terminator"))
    assert out["best"] == "line_masked" and out["macro_f1"] == 1.0 and out["surviving_mass"] == pytest.approx(1.0, abs=0.05) and out["agreement"] > 0.9 and out["sign_disagreement"] < 0.1
    assert {c["class"] for c in out["by_class"]} >= {"alpha", "brace", "terminator"} and sum(c["share_of_lost"] for c in out["by_class"]) == pytest.approx(1.0) or out["surviving_mass"] == pytest.approx(1.0)
    assert {a["class"] for a in out["ablations"]} == {"terminator", "brace"} and all(a["delta"] <= 0 for a in out["ablations"])


def test_role_ids_and_freezing(spark):
    rows = spark.createDataFrame([("p", "Python", "def f(a):\n    for i in a:\n        s += i\n    return s\n")], "problem_id string, language string, code string")
    got = sorted((r["occurrence_id"], r["variable"], r["s"]) for r in O.role_occurrence_rows(rows).collect())
    assert [g[0] for g in got] == ["p:Python:f0:b0:o0", "p:Python:f0:b0:o0", "p:Python:f0:b0:o1", "p:Python:f0:b0:o1"] and {g[1] for g in got} == {"i", "s"}
    canonical = spark.createDataFrame([(1, "r", "p.py", "def f(a):\n    b = a\n"), (2, "r", "p.py", "(")], "idx long, repo string, path string, code string")
    labels = [("r", "p.py", "f", "a", "1"), ("r", "p.py", "f", "a", None), ("r", "p.py", "f", "a", "2"), ("r", "p.py", "f", "a", "x"), ("r", "p.py", "g", "a", "1"), ("q", "p.py", "f", "a", "1"), ("r", "", "f", "a", "1"), ("r", "p.py", "f", "a", "9")]
    records = spark.createDataFrame([(i, None, "boolean_flag", *x) for i, x in enumerate(labels)], "ord int, parse_error string, role string, repo string, path string, function string, variable string, source_row string")
    out = {r["ord"]: r for r in O.freeze_labels(records, canonical, spark.createDataFrame([("r", "train")], "repo string, split string")).collect()}
    assert [out[i]["skip_reason"] for i in range(8)] == [None, None, "bad_code", "bad_source_row", "no_function", "repo_not_in_split", "missing_fields", "missing_code"]
    assert [(p["line"], p["ctx"]) for p in out[0]["places"]] == [(1, "arg"), (2, "Load")]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from lexiprobe import __main__ as cli

    monkeypatch.setattr(cli, "local_session", lambda: spark)
    (tmp_path / "in.jsonl").write_text(json.dumps({"problem_id": "p", "language": "Python", "split": "train", "code": "def f(ok):\n    if ok:\n        done = True\n    return done\n"}) + "\n" + json.dumps({"problem_id": "q", "language": "Python", "split": "train", "code": "x = 1"}) + "\n")
    cli.main(["extract", "--input", f"{tmp_path}/in.jsonl", "--output", f"{tmp_path}/occ"])
    assert spark.read.json(f"{tmp_path}/occ").count() == 3 and R.marked(spark, f"{tmp_path}/occ") == {"programs": 1, "rows": 3}
    cli.main(["build", "--input", f"{tmp_path}/in.jsonl", "--output", f"{tmp_path}/built"])
    assert spark.read.json(f"{tmp_path}/built").count() == 1
    cli.main(["split", "--group", "problem_id", "--input", f"{tmp_path}/in.jsonl", "--output", f"{tmp_path}/split"])
    assert spark.read.json(f"{tmp_path}/split").count() == 2
    cli.main(["names"])
    assert "flag_occurrences" in capsys.readouterr().out
