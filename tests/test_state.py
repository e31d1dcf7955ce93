"""Keyed state: leases and seen keys across batches and restarts."""

from pyspark.sql import functions as F

from lexiprobe.streaming import leases, store


def test_rules_of_leases():
    def run(*requests):
        lease, said = None, []
        for holder, action, at in requests:
            lease, granted, why = leases.answer(lease, holder, action, at)
            said.append(granted if granted else why)
        return said

    assert run(("a", "acquire", 0), ("b", "acquire", 599.9), ("a", "acquire", 599.9), ("b", "acquire", 1199.8), ("b", "acquire", 1199.9)) == [True, "held by a", True, "held by a", True]
    assert run(("a", "heartbeat", 0), ("a", "acquire", 0), ("b", "heartbeat", 1), ("a", "heartbeat", 700), ("b", "acquire", 1299)) == ["no lease", True, "now of a", True, "held by a"]
    assert run(("a", "acquire", 0), ("b", "release", 1), ("a", "release", 2), ("a", "heartbeat", 3), ("b", "acquire", 3)) == [True, "held by a", True, "released", True]
    assert run(("a", "acquire", 0), ("b", "release", 600), ("c", "acquire", 601), ("c", "steal", 602)) == [True, True, True, "no action steal"]
    assert run(("a", "release", 0)) == ["no lease"]


def test_leases_survive_restarts(spark, tmp_path):
    base = str(tmp_path)
    send = lambda *rows: spark.createDataFrame(rows, leases.REQUEST).coalesce(1).write.mode("append").parquet(f"{base}/in")
    got = lambda: {(r.resource, r.seq): (r.granted, r.held_by) for r in spark.read.parquet(f"{base}/out").collect()}
    send(("x", "a", "acquire", 0.0, 1), ("x", "b", "acquire", 10.0, 2), ("y", "b", "acquire", 10.0, 3), ("y", "b", "release", 11.0, 4))
    leases.stream_leases(spark, f"{base}/in", f"{base}/out", f"{base}/state")
    assert got() == {("x", 1): (True, "a"), ("x", 2): (False, "a"), ("y", 3): (True, "b"), ("y", 4): (True, None)}
    send(("x", "b", "acquire", 500.0, 5), ("y", "a", "acquire", 12.0, 6))
    send(("x", "b", "acquire", 600.0, 7), ("x", "a", "heartbeat", 601.0, 8))
    for _ in range(2):  # the second run finds nothing to do
        leases.stream_leases(spark, f"{base}/in", f"{base}/out", f"{base}/state")
    new = {k: v for k, v in got().items() if k[1] > 4}
    assert new == {("x", 5): (False, "a"), ("y", 6): (True, "a"), ("x", 7): (True, "b"), ("x", 8): (False, "b")}
    assert spark.read.parquet(f"{base}/out").count() == 8


def test_seen_keys_are_state(spark, tmp_path):
    base = str(tmp_path)
    rows = lambda a, b: spark.range(a, b).select("id", F.lit(a).cast("long").alias("v"))
    rows(0, 50).write.parquet(f"{base}/in")
    go = lambda: store.stream_append_keyed(spark, f"{base}/in", "id long, v long", f"{base}/out", f"{base}/state", ["id"])
    go()
    rows(30, 80).write.mode("append").parquet(f"{base}/in")
    go()
    go()
    out = spark.read.parquet(f"{base}/out")
    assert out.count() == 80 and out.filter("v = 30").count() == 30
