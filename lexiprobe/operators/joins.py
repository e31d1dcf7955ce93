"""Lookups, matched samples, exact pairing, spans and completeness, as equi-joins wherever a key exists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Refused(ValueError):
    """Input that must not be analysed: duplicates, gaps, too small an overlap."""


def wins(rows: DataFrame, key: list[str], order: str, last: bool) -> DataFrame:
    """One row a key: the last (or first) by ``order``."""
    pick = F.max_by if last else F.min_by
    kept = [c for c in rows.columns if c not in key]
    one = rows.groupBy(*key).agg(pick(F.struct(*kept), F.col(order)).alias("__r"))
    return one.select(*key, *(F.col("__r")[c].alias(c) for c in kept))


def lookup(left: DataFrame, right: DataFrame, key: list[str], order: str, last: bool = True, how: str = "inner") -> DataFrame:
    """Each left row with the winning right row of its key."""
    return left.join(wins(right, key, order, last), key, how)


def lookup_two_ways(left: DataFrame, first: DataFrame, second: DataFrame, key1: str, key2: list[str], value: str) -> DataFrame:
    """``value`` by ``key1`` where the left row has one, else by ``key2``."""
    a = first.select(key1, F.col(value).alias("__a"))
    b = second.select(*key2, F.col(value).alias("__b"))
    out = left.join(a, key1, "left").join(b, key2, "left")
    return out.withColumn(value, F.when(F.col(key1).isNotNull(), F.col("__a")).otherwise(F.col("__b"))).drop("__a", "__b")


def matched(a: DataFrame, b: DataFrame, key: str, least: int = 0) -> tuple[DataFrame, DataFrame]:
    """Both sides restricted to shared keys; refuses under ``least`` of them."""
    ids = a.select(key).intersect(b.select(key))
    if least and ids.limit(least).count() < least:
        raise Refused(f"fewer than {least} shared {key}")
    return a.join(ids, key, "left_semi"), b.join(ids, key, "left_semi")


def shared_keys(sides: list[DataFrame], key: str) -> DataFrame:
    return reduce(lambda x, y: x.intersect(y), (s.select(key) for s in sides))


def exact_pairs(rows: DataFrame, key: str, group: str, groups: list[str], values: list[str]) -> DataFrame:
    """One row a key with each group's values; refuses keys that a group lacks or has twice, and other groups."""
    one = lambda g, v: F.max(F.when(F.col(group) == g, F.col(v))).alias(f"{g}_{v}")
    count = lambda g: F.count_if(F.col(group) == g).alias(f"__{g}")
    wide = rows.groupBy(key).agg(*(one(g, v) for g in groups for v in values), *(count(g) for g in groups), F.count(F.lit(1)).alias("__all"))
    fine = reduce(lambda x, y: x & y, (F.col(f"__{g}") == 1 for g in groups)) & (F.col("__all") == len(groups))
    bad = wide.filter(~fine).select(key).limit(5).collect()
    if bad:
        raise Refused(f"keys not exactly once in each of {groups}: {[r[0] for r in bad]}")
    return wide.drop("__all", *(f"__{g}" for g in groups))


def pair_counts(rows: DataFrame, key: str, group: str, groups: list[str]) -> DataFrame:
    """How often each group has each key, and whether all have it exactly once."""
    wide = rows.groupBy(key).agg(*(F.count_if(F.col(group) == g).cast("long").alias(f"n_{g}") for g in groups))
    return wide.withColumn("exact", reduce(lambda x, y: x & y, (F.col(f"n_{g}") == 1 for g in groups)))


#: Widths of the bins that intervals are laid out in: BIN characters, and GROW times as many from level to level.
BIN, GROW, LEVELS = 64, 8, 16


def _levelled(rows: DataFrame, s: Column, e: Column) -> DataFrame:
    """``rows`` with __lvl: the first level whose bins are as wide as the interval [s, e), so that it touches two of them at most."""
    level = F.lit(0)
    for k in range(LEVELS - 1):
        level = level + (e - s > BIN * GROW**k).cast("int")
    return rows.withColumn("__lvl", level)


def _binned(rows: DataFrame, s: Column, e: Column, top: int) -> DataFrame:
    """A row for each bin that an interval touches on its own level and on all above up to ``top``."""
    rows = rows.withColumn("__at", F.explode(F.sequence(F.col("__lvl"), F.greatest(F.col("__lvl"), F.lit(top)))))
    width = F.pow(F.lit(float(GROW)), F.col("__at")).cast("long") * BIN
    return rows.withColumn("__bin", F.explode(F.sequence(F.floor(s / width), F.floor(F.greatest(s, e - 1) / width))))


def _meeting(t: DataFrame, s: DataFrame, key: str, start: str, end: Column | None = None) -> DataFrame:
    """Pairs of alias t and alias s, of one key, whose intervals meet; each pair is found in one bin, on the wider one's level.

    Both sides are laid out in bins as wide as themselves and wider ones, so a pair is looked for only among intervals near by.
    """
    te = F.col("e") if end is None else end
    t, s = _levelled(t, F.col(start), te), _levelled(s, F.col("s"), F.col("e"))
    tops = [d.agg(F.max("__lvl")).first()[0] or 0 for d in (t, s)]
    t, s = _binned(t, F.col(start), te, tops[1]).alias("t"), _binned(s, F.col("s"), F.col("e"), tops[0]).alias("s")
    ts, t_end = F.col(f"t.{start}"), F.col("t.e") if end is None else F.col(f"t.{start}") + 1
    width = F.pow(F.lit(float(GROW)), F.col("t.__at")).cast("long") * BIN
    once = (F.col("t.__at") == F.greatest("t.__lvl", "s.__lvl")) & (F.floor(F.greatest(ts, F.col("s.s")) / width) == F.col("t.__bin"))
    return t.join(s, (F.col(f"t.{key}") == F.col(f"s.{key}")) & (F.col("t.__at") == F.col("s.__at")) & (F.col("t.__bin") == F.col("s.__bin")) & once & (ts < F.col("s.e")) & (F.col("s.s") < t_end))


def overlapping(tokens: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Token x span of one key with token.s < span.e and span.s < token.e, as aliases t and s; null offsets meet nothing."""
    return _meeting(tokens, spans, key, "s")


def innermost(points: DataFrame, scopes: DataFrame, key: str, pos: str, point_id: str) -> DataFrame:
    """The narrowest scope (scope, s, e) that holds each point; points outside of all keep null."""
    found = _meeting(points, scopes, key, pos, F.col(pos) + 1)
    best = found.groupBy(F.col(f"t.{key}").alias("__k"), F.col(f"t.{point_id}").alias("__p")).agg(F.min_by("s.scope", F.struct(F.col("s.e") - F.col("s.s"), F.col("s.scope"))).alias("scope"))
    each = points.select(key, point_id).distinct()
    return each.join(best, each[key].eqNullSafe(best["__k"]) & each[point_id].eqNullSafe(best["__p"]), "left").select(each[key], each[point_id], "scope")


def shift_spans(s: Column, e: Column, edits: Column) -> Column:
    """A span moved by edits (array of struct s, e, repl): the edit's own span is renamed, others move by the growth of the edits before, partial overlap gives null."""
    before = F.aggregate(edits, F.lit(0).cast("long"), lambda a, x: a + F.when(x["e"] <= s, (F.length(x["repl"]) - (x["e"] - x["s"])).cast("long")).otherwise(F.lit(0).cast("long")))
    own = F.filter(edits, lambda x: (x["s"] == s) & (x["e"] == e))
    clash = F.exists(edits, lambda x: (x["s"] < e) & (s < x["e"]) & ~((x["s"] == s) & (x["e"] == e)))
    width = F.when(F.size(own) > 0, F.length(F.element_at(own, 1)["repl"])).otherwise(e - s)
    return F.when(~clash, F.struct((s + before).alias("s"), (s + before + width).alias("e")))


def drop_groups_with_misses(rows: DataFrame, expected: DataFrame, group: str, key: list[str]) -> DataFrame:
    """``rows`` of the groups of which ``expected`` has every key."""
    bad = rows.join(expected, [group, *key], "left_anti").select(group).distinct()
    return rows.join(bad, group, "left_anti")


def completeness(expected: DataFrame, present: DataFrame, key: list[str], finite: list[str]) -> DataFrame:
    """Counts of expected, present, missing, extra, duplicate and non-finite rows."""
    have = present.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), *(F.max((F.isnan(c) | F.col(c).isNull() | (F.abs(c) == float("inf"))).cast("int")).alias(f"__{c}") for c in finite))
    both = expected.select(*key).distinct().withColumn("__want", F.lit(1)).join(have, key, "full_outer")
    bad = reduce(lambda x, y: x | y, (F.coalesce(F.col(f"__{c}") == 1, F.lit(False)) for c in finite), F.lit(False))
    count = lambda c, name: F.count_if(c).cast("long").alias(name)
    return both.agg(
        count(F.col("__want") == 1, "expected"), count(F.col("__n").isNotNull(), "present"), count(F.col("__n").isNull(), "missing"),
        count(F.col("__want").isNull(), "extra"), count(F.col("__n") > 1, "duplicates"), count(bad, "non_finite"),
    )


def coverage(a: DataFrame, b: DataFrame, key: list[str], by: str) -> DataFrame:
    """Per ``by``: shared keys over the smaller side's."""
    n = lambda d, name: d.select(by, *key).distinct().groupBy(by).agg(F.count(F.lit(1)).alias(name))
    shared = a.select(by, *key).intersect(b.select(by, *key)).groupBy(by).agg(F.count(F.lit(1)).alias("n_shared"))
    both = n(a, "n_a").join(n(b, "n_b"), by).join(shared, by, "left").na.fill(0, ["n_shared"])
    return both.withColumn("coverage", F.col("n_shared") / F.least("n_a", "n_b"))


def paired_predictions(a: DataFrame, b: DataFrame, key: str, by: str = "seed", least: float = 0.9, partial: bool = False) -> DataFrame:
    """key, ``by``, y_true, cluster (of ``b``), pred_a and pred_b of what both sides have, by key and ``by``; rows without a key are left out.

    Refused where a side has a key twice, where the sides share fewer than ``least`` of the smaller one's keys (unless
    ``partial``), and where they disagree on y_true: then they are not two predictions of one data set.
    """
    left = a.filter(F.col(key).isNotNull()).select(key, by, "y_true", F.col("y_pred").alias("pred_a"))
    right = b.filter(F.col(key).isNotNull()).select(key, by, F.col("y_true").alias("__y"), "cluster", F.col("y_pred").alias("pred_b"))
    for side in (left, right):
        twice = side.groupBy(key, by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(3).collect()
        if twice:
            raise Refused(f"predicted twice: {[tuple(r)[:2] for r in twice]}")
    both = left.join(right, [key, by])
    sizes = left.groupBy(by).agg(F.count(F.lit(1)).alias("na")).join(right.groupBy(by).agg(F.count(F.lit(1)).alias("nb")), by)
    shared = both.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("y_true").eqNullSafe(F.col("__y"))).alias("differ"))
    found = sizes.join(shared, by, "left").na.fill(0, ["n", "differ"]).orderBy(by).collect()  # one row a seed
    for r in found:
        if r["differ"]:
            raise Refused(f"{by} {r[by]}: y_true differs for {r['differ']} of {r['n']} shared keys")
        if r["n"] < least * min(r["na"], r["nb"]) and not partial:
            raise Refused(f"{by} {r[by]}: {r['n']} keys are shared of {min(r['na'], r['nb'])}")
    if not found and not partial:
        raise Refused(f"no {by} is on both sides")
    return both.drop("__y")


def require(rows: DataFrame, condition: Column, message: str) -> DataFrame:
    """``rows``, failing at the first one where ``condition`` does not hold."""
    return rows.filter(F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def small_side(side: DataFrame, most: int = 10_000) -> DataFrame:
    """``side`` marked for broadcast if it has at most ``most`` rows; beyond, it is left to a shuffle join. No row is dropped."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side
