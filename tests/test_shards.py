"""Shards, dumps and tensor files: round trips, pruned partitions, skipped rows."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiprobe.sources import shards
from lexiprobe.sources import tables as T


def make_store(path, n=60, layers=3, dim=4):
    path.mkdir()
    x = np.random.default_rng(1).normal(size=(n, layers, dim)).astype(np.float16)
    np.save(path / "shard.npy", x)
    lines = []
    for i in range(n):
        lines.append(json.dumps({"occurrence_id": f"o{i}é", "occurrence_type": "loop_use", "problem_id": i // 3, "function": "f", "variable": "x", "row": n - 1 - i} | ({"skip": "too_long"} if i % 7 == 0 else {})))
        lines += [""] if i % 11 == 0 else []
    (path / "index.jsonl").write_text("\n".join(lines) + "\n")
    (path / "meta.json").write_text(json.dumps({"model_id": "m", "label_field": "occurrence_type"}))
    return x


@pytest.mark.parametrize("index_bytes", [50, 137, 1 << 20])
def test_a_store_is_read_by_ranges_of_its_index(spark, tmp_path, index_bytes):
    x = make_store(tmp_path / "s")
    rows = shards.read_shards(spark, str(tmp_path / "s"), index_bytes=index_bytes).collect()
    want = {(f"o{i}é", k): x[59 - i, k].astype(np.float32).tolist() for i in range(60) if i % 7 for k in range(3)}
    assert len(rows) == len(want) and {(r.occurrence_id, r.layer): r.vec for r in rows} == want
    assert {(r.label, r.variable, r.function) for r in rows} == {("loop_use", "x", "f")} and {r.problem_id for r in rows} <= {str(i) for i in range(20)}


def test_layers_prune_partitions(spark, tmp_path):
    x = make_store(tmp_path / "s")
    rows = spark.createDataFrame([(f"o{i}", "p", "a", "v", "f", k, [float(i), float(k)]) for i in range(50) for k in range(4)], T.ACTIVATION).repartition(3)
    shards.write_shards(rows, str(tmp_path / "w"), {"model_id": "m"}, store_rows=10)
    reader = shards.ShardReader(str(tmp_path / "w"), 1 << 20, 10)
    every = reader.partitions()
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    left = list(reader.pushFilters([In(("layer",), (1, 2)), EqualTo(("layer",), 2), GreaterThan(("layer",), 0), EqualTo(("label",), "a")]))
    assert len(left) == 2 and reader.layers == {2}
    asked = reader.partitions()
    assert 0 < len(asked) < len(every) and all(p.layers == [2] for p in asked)
    some = shards.read_shards(spark, str(tmp_path / "w"), [2])
    assert sorted((r.occurrence_id, r.vec) for r in some.collect()) == sorted((f"o{i}", [float(i), 2.0]) for i in range(50))
    assert some.rdd.getNumPartitions() == len(asked)
    one = shards.read_shards(spark, str(tmp_path / "s"), [1]).filter("occurrence_id = 'o1é'").collect()
    assert [r.vec for r in one] == [x[58, 1].astype(np.float32).tolist()]


def test_stores_that_no_list_names_are_not_read(spark, tmp_path):
    path = str(tmp_path / "w")
    rows = lambda a, b: spark.createDataFrame([(f"o{i}", "p", None, None, None, 0, [1.0]) for i in range(a, b)], T.ACTIVATION)
    shards.write_shards(rows(0, 5), path)
    make_store(tmp_path / "w" / "stray")
    assert shards.read_shards(spark, path).count() == 5
    shards.write_shards(rows(5, 8), path, mode="append")
    assert shards.read_shards(spark, path).count() == 8 and shards.store_meta(path)["layers"] == [0]
    shards.write_shards(rows(8, 9), path)
    assert [r.occurrence_id for r in shards.read_shards(spark, path).collect()] == ["o8"]
    assert shards.store_exists(path) and not shards.store_exists(str(tmp_path)) and not shards.store_exists(path + "/none")
    with pytest.raises(Exception, match="no finished store"):
        shards.read_shards(spark, str(tmp_path / "none")).count()


def test_dumps(spark, tmp_path):
    x = np.arange(2 * 30 * 3, dtype=np.float32).reshape(2, 30, 3)
    for k in range(2):
        np.save(tmp_path / f"layer_{k}.npy", x[k])
    np.save(tmp_path / "labels.npy", np.array([f"l{i % 2}" for i in range(30)]))
    np.save(tmp_path / "programs.npy", np.array([f"prog{i}" for i in range(30)]))
    assert not shards.store_exists(str(tmp_path))
    (tmp_path / "meta.json").write_text(json.dumps({"n_layers": 2, "n_used": 25}))
    assert shards.store_exists(str(tmp_path))
    rows = shards.read_shards(spark, str(tmp_path), dump_rows=7)
    assert rows.rdd.getNumPartitions() == 8
    assert {(r.problem_id, r.layer): (r.label, r.vec) for r in rows.collect()} == {(f"prog{i}", k): (f"l{i % 2}", x[k, i].tolist()) for k in range(2) for i in range(25)}
    np.save(tmp_path / "labels.npy", np.array([None] * 30, object))
    with pytest.raises(Exception, match="plain values"):
        rows.count()


def test_tensor_files_and_manifest(spark, tmp_path):
    path = str(tmp_path / "npz")
    shards.write_tensors(spark.range(6).select(F.concat(F.lit("t"), "id", F.lit(".npz")).alias("name"), F.array(F.col("id").cast("float"), F.lit(1.5)).alias("vec")), path)
    np.savez(tmp_path / "npz" / "other.npz", last=np.zeros(2))
    tensors = shards.read_tensors(spark, path)
    assert {r["name"]: r["vec"] for r in tensors.collect()} == {f"t{i}.npz": [float(i), 1.5] for i in range(6)}
    manifest = spark.createDataFrame([(1, "a/t1.npz", "x", 1), (2, "a/t2.npz", "x", 1), (3, "a/t9.npz", "x", 2), (4, "a/t3.npz", "x", 3), (5, "a/t4.npz", "y", 3)], "ord int, activation_path string, occurrence_type string, span int")
    records, stats = T.manifest_records(manifest, tensors, ["span"], "ord")
    assert [(r.occurrence_id, r.vec) for r in records.collect()] == [("t1", [1.0, 1.5])]
    assert stats.first().asDict() == {"usable": 5, "duplicates": 1, "conflicts": 2, "missing": 1, "records": 1}
    with pytest.raises(Exception, match="plain file name"):
        shards.write_tensors(spark.range(1).select(F.lit("../x.npz").alias("name"), F.array(F.lit(1.0)).alias("vec")), path)
