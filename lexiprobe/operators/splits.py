"""Reproducible splits, samples and caps. Randomness is a hash of (key, seed), never a generator's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_unit(key: Column, seed: int | Column) -> Column:
    """A number in [0, 1] from the first 32 bits of sha1("key:seed")."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    text = F.concat_ws(":", key.cast("string"), seed.cast("string"))
    return F.conv(F.substring(F.sha1(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def hash_split(key: Column, seed: int | Column, test: float = 0.2, val: float = 0.1) -> Column:
    """'test', 'val' or 'train'; a key's fold does not depend on which other keys there are."""
    u = hash_unit(key, seed)
    return F.when(u < test, "test").when(u < test + val, "val").otherwise("train")


def hundred_fold(key: Column, seed: int | Column) -> Column:
    """Fold of 100 by the whole sha1 taken modulo 100 (Horner over its 40 hex digits)."""
    text = F.concat_ws(":", key.cast("string"), (seed if isinstance(seed, Column) else F.lit(seed)).cast("string"))
    digits = F.split(F.sha1(text.cast("binary")), "")
    return F.aggregate(F.slice(digits, 1, 40), F.lit(0).cast("bigint"), lambda a, d: (a * 16 + F.conv(d, 16, 10).cast("bigint")) % 100)


def ordered_split(rows: DataFrame, group: str, seed: int, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """One row a group with its split: groups in hash order, the first int(train*n), then int(val*n), the rest test."""
    groups = rows.select(group).distinct().withColumn("u", hash_unit(F.col(group), seed))
    n = groups.count()
    # ranks by range partitions: each partition's offset is a sum of a few counts, no single sorted task
    ranked = global_rank(groups, [F.col("u"), F.col(group)])
    split = F.when(F.col("rank") <= int(train * n), "train").when(F.col("rank") <= int(train * n) + int(val * n), "validation").otherwise("test")
    return ranked.select(group, split.alias("split"))


def global_rank(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place (from 1) in a total order, numbered by range partition in two passes.

    The second pass reads what the first has ranged, so it is kept on disk; the driver sees one
    count a partition.
    """
    from pyspark import StorageLevel

    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    at, starts = 0, {}
    for r in sorted(ranged.groupBy("__part").count().collect(), key=lambda r: r["__part"]):
        starts[r["__part"]] = at
        at += r["count"]
    if not starts:
        return rows.withColumn(name, F.lit(0).cast("long"))
    # the rows of a partition stand in order, and their ids count them from the partition's number shifted by 33 bits
    placed = ranged.withColumn("__id", F.monotonically_increasing_id())
    inner = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return _with_starts(placed, starts, "long").withColumn(name, (inner + F.col("__start")).cast("long")).drop("__part", "__id", "__start")


def _with_starts(rows: DataFrame, starts: dict, kind: str) -> DataFrame:
    """``rows`` with __start of their __part: a small table of one row a partition, met by hash."""
    small = rows.sparkSession.createDataFrame([(k, str(v)) for k, v in starts.items()], "__part int, v string").select("__part", F.col("v").cast(kind).alias("__start"))
    return rows.join(F.broadcast(small), "__part")


def running(rows: DataFrame, by: list[str], order: list[Column], weight: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``weight`` over the rows of their group that come before, in two passes over range partitions.

    A group may span any number of partitions: what is summed is the whole order, and each group's own start is taken
    off. The driver sees one number a partition. Weights must add exactly (integers or decimals).
    """
    from pyspark import StorageLevel

    whole = [*(F.col(c) for c in by), *order]
    ranged = rows.withColumn("__w", weight).repartitionByRange(*whole).sortWithinPartitions(*whole).withColumn("__part", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    at, starts = 0, {}
    for r in sorted(ranged.groupBy("__part").agg(F.sum("__w").alias("w")).collect(), key=lambda r: r["__part"]):
        starts[r["__part"]] = at
        at += r["w"] or 0
    kind = ranged.schema["__w"].dataType
    kind = f"decimal(38,{kind.scale})" if kind.typeName() == "decimal" else "long"
    if not starts:
        return rows.withColumn(name, F.lit(None).cast(kind))
    inner = F.sum("__w").over(W.partitionBy("__part").orderBy(*whole).rowsBetween(W.unboundedPreceding, -1))
    placed = _with_starts(ranged.withColumn("__in", F.coalesce(inner, F.lit(0))), starts, kind).withColumn("__acc", (F.col("__in") + F.col("__start")).cast(kind)).drop("__in", "__start")
    if not by:
        return placed.withColumnRenamed("__acc", name).drop("__w", "__part")
    first = placed.groupBy(*by).agg(F.min("__acc").alias("__start")).select(*(F.col(c).alias(f"__{c}") for c in by), "__start")
    same = [placed[c].eqNullSafe(first[f"__{c}"]) for c in by]
    return placed.join(first, same).withColumn(name, (F.col("__acc") - F.col("__start")).cast(kind)).drop("__acc", "__start", "__w", "__part", *(f"__{c}" for c in by))


def cap_whole_groups(rows: DataFrame, group: list[str], seed: int, cap: int, per: list[str] | None = None) -> DataFrame:
    """Whole groups in hash order, as long as the rows of those before are fewer than ``cap`` (within each ``per``)."""
    sizes = rows.groupBy(*(per or []), *group).agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.withColumn("__u", hash_unit(F.concat_ws("|", *group), seed))
    before = running(sizes, per or [], [F.col("__u"), *(F.col(c) for c in group)], F.col("__n"), "__earlier")
    return rows.join(before.filter(F.col("__earlier") < cap).select(*(per or []), *group), [*(per or []), *group], "left_semi")


def first_seen_cap(rows: DataFrame, key: str, order: str, cap: int) -> DataFrame:
    """Rows of the first ``cap`` different keys by order of appearance; later rows of those pass too."""
    first = rows.groupBy(key).agg(F.min(order).alias("__first")).orderBy("__first", key).limit(cap).select(key)
    return rows.join(first, key, "left_semi")


def stratified_split(rows: DataFrame, label: str, key: str, seed: int, test: float = 0.2) -> DataFrame:
    """Adds split: within each label the first int(test * n) rows in hash order are test."""
    from lexiprobe.operators.joins import small_side

    n = rows.groupBy(F.col(label).alias("__label")).agg(F.count(F.lit(1)).alias("__n"))
    placed = running(rows.withColumn("__u", hash_unit(F.col(key), seed)), [label], [F.col("__u"), F.col(key)], F.lit(1), "__place")
    both = placed.join(small_side(n), placed[label].eqNullSafe(F.col("__label")))
    return both.withColumn("split", F.when(F.col("__place") < F.floor(F.col("__n") * test), "test").otherwise("train")).drop("__label", "__n", "__u", "__place")


def class_policy(rows: DataFrame, label: str, least: int, drop: bool = True) -> DataFrame:
    """Drops rows of classes under ``least`` rows, or raises on the first such row."""
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    if drop:
        return rows.join(n.filter(F.col("__n") >= least), label, "left_semi")
    bad = [r[label] for r in n.filter(F.col("__n") < least).select(label).limit(10).collect()]
    if bad:
        raise ValueError(f"classes under {least} rows: {bad}")
    return rows


def sampled_positions(n: Column, avoid: Column, count: int, seed: str) -> Column:
    """``count`` positions of 0 .. n-1 outside of ``avoid`` in hash order, or an empty array where there are too few."""
    free = F.array_except(F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>")), avoid)
    ordered = F.array_sort(F.transform(free, lambda p: F.struct(F.sha1(F.concat(F.lit(seed), p.cast("string")).cast("binary")).alias("h"), p.alias("p"))))
    return F.when(F.size(free) >= count, F.transform(F.slice(ordered, 1, count), lambda x: x["p"])).otherwise(F.array().cast("array<int>"))
