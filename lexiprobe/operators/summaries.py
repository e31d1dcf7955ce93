"""Tables of results: statistics by seed, layer and scope, contrasts on shared draws, pairings, deltas and links."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiprobe.operators import bootstrap as B
from lexiprobe.operators.joins import Refused, small_side
from lexiprobe.operators.metrics import macro_f1_binary, spearman

SUMS = ["tn", "fp", "fn", "tp"]


def _f1() -> Column:
    return macro_f1_binary(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))


def finite(x: Column) -> Column:
    """The value, or null where it is null, NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


# --- statistics ----------------------------------------------------------------------------------


def seed_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, mean, std (of the population), n."""
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def median_int(value: Column) -> Column:
    """The median without its fraction, as an aggregate."""
    return F.percentile(value, F.lit(0.5)).cast("int")


def distribution(rows: DataFrame, by: list[str], value: str, floor: float) -> DataFrame:
    """by, n, quartiles, share under ``floor`` and share under 0."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    share = lambda c: F.avg(c.cast("double"))
    out = rows.groupBy(*by).agg(F.count(value).alias("n"), q.alias("q"), share(F.col(value) < floor).alias("frac_below_floor"), share(F.col(value) < 0).alias("frac_negative"))
    return out.select(*by, "n", *(F.col("q")[i].alias(c) for i, c in enumerate(("q25", "median", "q75"))), "frac_below_floor", "frac_negative")


def above_floor(rows: DataFrame, by: list[str], value: str, floor: float) -> DataFrame:
    """by, kept, below: rows whose value reaches ``floor``, and those that are left out."""
    return rows.groupBy(*by).agg(F.count_if(F.col(value) >= floor).alias("kept"), F.count_if(~F.coalesce(F.col(value) >= floor, F.lit(False))).alias("below"))


def layer_effects(rows: DataFrame, layer: str, clean: str, changed: str, controls: list[str], floor: float = 1e-6) -> DataFrame:
    """By layer: n, means of both sides, effect (share of the clean value that is lost) and loss, and by control its mean,
    number, loss and the ratio of the losses. Nulls and what is not finite take no part where they stand."""
    lost = F.col(clean) - F.col(changed)
    effect = finite(F.when(F.abs(clean) >= floor, lost / F.col(clean)))
    cols = [F.count(F.lit(1)).alias("n"), F.avg(finite(F.col(clean))).alias("clean_mean"), F.avg(finite(F.col(changed))).alias("changed_mean")]
    for name, x in (("effect", effect), ("lost", finite(lost))):
        cols += [F.avg(x).alias(f"{name}_mean"), F.percentile(x, F.lit(0.5)).alias(f"{name}_median")]
    for c in controls:
        cols += [F.avg(finite(F.col(c))).alias(f"{c}_mean"), F.count(F.col(c)).alias(f"{c}_n"), F.avg(finite(F.col(clean) - F.col(c))).alias(f"{c}_lost")]
    out = rows.groupBy(layer).agg(*cols)
    for c in controls:
        out = out.withColumn(f"{c}_ratio", F.when(F.abs(f"{c}_lost") > 1e-9, F.col("lost_mean") / F.col(f"{c}_lost")))
    return out


def best_of(*columns: Column) -> Column:
    """The largest of a row's values; what is not finite does not count, null where none is."""
    return F.greatest(*(finite(c) for c in columns))


def unique_counts(rows: DataFrame, columns: list[str], unique: str | None = None) -> dict[str, int]:
    """How many different values each column has; refused where ``unique`` has fewer than there are rows."""
    found = rows.agg(F.count(F.lit(1)).alias("rows"), *(F.count_distinct(c).alias(c) for c in dict.fromkeys([*columns, *([unique] if unique else [])]))).first().asDict()
    if unique and found[unique] != found["rows"]:
        raise Refused(f"{found['rows'] - found[unique]} rows repeat a {unique}")
    return found


def frequency(*within: str) -> Column:
    """How many rows share the columns' values."""
    return F.count(F.lit(1)).over(W.partitionBy(*within))


def weighted_agreement(rows: DataFrame, a: str, b: str, weight: str, by: list[str] | None = None) -> DataFrame:
    """by, agreement (weighted correlation; null without spread), sign_disagreement (share of the weight whose signs differ), compared."""
    w, x, y = F.col(weight), F.col(a), F.col(b)
    s = rows.groupBy(*(by or [])).agg(
        F.sum(w).alias("w"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"), F.sum(w * x * x).alias("xx"), F.sum(w * y * y).alias("yy"), F.sum(w * x * y).alias("xy"),
        F.sum(F.when(F.signum(x) != F.signum(y), w).otherwise(0.0)).alias("flip"), F.count_if(w > 0).alias("compared"),
    )
    centred = lambda xy, a, b: F.col(xy) - F.try_divide(F.col(a) * F.col(b), F.col("w"))
    spread = centred("xx", "x", "x") * centred("yy", "y", "y")
    agreement = F.try_divide(centred("xy", "x", "y"), F.sqrt(F.when(spread > 0, spread)))
    return s.select(*(by or []), agreement.alias("agreement"), F.try_divide(F.col("flip"), F.col("w")).alias("sign_disagreement"), "compared")


def surviving_mass(features: DataFrame, coef: str, source: str, target: str) -> DataFrame:
    """One row: the share of the source's mass (|coefficient| times mean weight) that the target realises, features, those it lacks."""
    mass = lambda c: F.sum(F.abs(coef) * F.col(c))
    return features.agg(F.when(mass(source) > 0, mass(target) / mass(source)).otherwise(0.0).alias("surviving_mass"), F.count(F.lit(1)).alias("features"), F.count_if(F.col(target) == 0).alias("absent"))


def mass_by_class(features: DataFrame, kind: Column, coef: str, source: str, target: str, top: int = 4000) -> DataFrame:
    """class, n, mass_source, mass_target, retained, share_of_lost of the ``top`` features by mass in the source."""
    rows = features.select(kind.alias("class"), (F.abs(coef) * F.col(source)).alias("ms"), (F.abs(coef) * F.col(target)).alias("mt")).orderBy(F.desc("ms")).limit(top)
    out = rows.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("mass_source"), F.sum("mt").alias("mass_target"))
    lost = F.col("mass_source") - F.col("mass_target")
    # a row a class
    all_lost = F.sum(lost).over(W.partitionBy())
    return out.select("*", F.when(F.col("mass_source") > 0, F.col("mass_target") / F.col("mass_source")).otherwise(0.0).alias("retained"), (lost / F.when(all_lost == 0, 1.0).otherwise(all_lost)).alias("share_of_lost"))


# --- intervals on shared draws -----------------------------------------------------------------------


def seed_averaged(cells: DataFrame, drawn: DataFrame, cluster: str, seed: str, by: list[str]) -> DataFrame:
    """by, macro_f1, lo, hi, n_seeds: the mean over seeds of macro F1, averaged within each replicate. ``cells`` are confusion counts by (by, seed, cluster)."""
    boot = B.replicates(cells, drawn, cluster, SUMS, [*by, seed]).withColumn("f", _f1())
    ci = B.percentile_interval(boot.groupBy(*by, "replicate").agg(F.avg("f").alias("f")).withColumn("one", F.lit(1)), [*by, "one"], F.col("f")).drop("one")
    seen = cells.groupBy(*by, seed).agg(*(F.sum(x).alias(x) for x in SUMS)).withColumn("f", _f1()).groupBy(*by).agg(F.avg("f").alias("macro_f1"), F.count(F.lit(1)).alias("n_seeds"))
    return seen.join(ci, by) if by else seen.crossJoin(F.broadcast(ci))


#: The estimands on (condition, group) means, as signed terms; conditions are trained on spans, trained and untrained on contexts.
CONTRASTS = {
    "span_trained_boundary": (("span_trained", "far", 1), ("span_trained", "near", -1)),
    "context_trained_boundary": (("context_trained", "far", 1), ("context_trained", "near", -1)),
    "context_untrained_boundary": (("context_untrained", "far", 1), ("context_untrained", "near", -1)),
    "context_boundary_difference_in_differences": (("context_trained", "far", 1), ("context_trained", "near", -1), ("context_untrained", "far", -1), ("context_untrained", "near", 1)),
    "context_trained_minus_untrained_close": (("context_trained", "near", 1), ("context_untrained", "near", -1)),
    "context_trained_minus_untrained_python": (("context_trained", "far", 1), ("context_untrained", "far", -1)),
    "boundary_shift_after_excluding_occurrence": (("context_trained", "far", 1), ("context_trained", "near", -1), ("span_trained", "far", -1), ("span_trained", "near", 1)),
}


def contrasts(cells: DataFrame, drawn: DataFrame, cluster: str, condition: str, group: str, cell: list[str], estimands: dict = CONTRASTS, absent_is_zero: bool = True) -> DataFrame:
    """estimand, estimate, lo, hi, n_boot: signed sums of group means of the cells' macro F1, all cells on the same draws.

    A cell of which a replicate has drawn nothing has a macro F1 of 0 there; or, with ``absent_is_zero`` off, no part in
    the mean, and replicates that lack a whole group are left out.
    """
    keys = [condition, group, *cell]
    boot = B.replicates(cells, drawn, cluster, SUMS, keys)
    all_ = cells.groupBy(*keys).agg(*(F.sum(x).alias(x) for x in SUMS)).withColumn("replicate", F.lit(-1).cast("long"))
    each = boot.unionByName(all_).withColumn("f", _f1()).groupBy("replicate", condition, group)
    if absent_is_zero:
        # a row a condition and group
        many = all_.groupBy(F.col(condition).alias("__c"), F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("__n"))
        each = each.agg(F.sum("f").alias("f")).join(small_side(many), (F.col(condition) == F.col("__c")) & (F.col(group) == F.col("__g"))).withColumn("f", F.col("f") / F.col("__n"))
    else:
        each = each.agg(F.avg("f").alias("f"))
    need = sorted({(c, g) for terms in estimands.values() for c, g, _ in terms})
    wide = each.groupBy("replicate").agg(*(F.coalesce(F.max(F.when((F.col(condition) == c) & (F.col(group) == g), F.col("f"))), F.lit(0.0 if absent_is_zero else None).cast("double")).alias(f"{c}/{g}") for c, g in need))
    value = {name: reduce(lambda a, b: a + b, (F.col(f"`{c}/{g}`") * float(sign) for c, g, sign in terms)) for name, terms in estimands.items()}
    long = wide.select("replicate", F.explode(F.array(*(F.struct(F.lit(n).alias("estimand"), v.alias("v")) for n, v in value.items()))).alias("e")).select("replicate", "e.*")
    resampled = F.when(F.col("replicate") >= 0, F.col("v"))
    out = long.groupBy("estimand").agg(F.max(F.when(F.col("replicate") < 0, F.col("v"))).alias("estimate"), F.percentile(resampled, F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count(resampled).alias("n_boot"))
    return out.select("estimand", "estimate", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "n_boot")


def ratio_interval(rows: DataFrame, effect: str, gap: str, cluster: str, n_boot: int) -> DataFrame:
    """One row: the ratio of means, its percentile bounds over whole clusters, and whether the denominator's draws reach both sides of 0."""
    cells = rows.groupBy(cluster).agg(F.sum(effect).alias("e"), F.sum(gap).alias("g"), F.count(F.lit(1)).alias("k"))
    boot = B.replicates(cells, B.draws(cells, cluster, n_boot), cluster, ["e", "g", "k"], [])
    ci = boot.agg(F.percentile(F.try_divide(F.col("e"), F.col("g")), F.array(F.lit(0.025), F.lit(0.975))).alias("q"), ((F.min(F.col("g") / F.col("k")) <= 0) & (F.max(F.col("g") / F.col("k")) >= 0)).alias("denominator_crosses_zero"))
    seen = cells.agg(F.try_divide(F.sum("e"), F.sum("g")).alias("point"), F.count(F.lit(1)).alias("n_clusters"))
    return seen.crossJoin(F.broadcast(ci)).select("point", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "n_clusters", (F.col("n_clusters") < 30).alias("few_clusters"), "denominator_crosses_zero")


#: Cells of a rank correlation that every task may hold (24 bytes each); beyond, replicates are ranked by a shuffle.
CELLS = 2_000_000


def weighted_rho(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Rank correlation of cells (codes of sorted distinct values) that stand ``w`` times each: ranks come from cumulated multiplicities."""
    ranks = []
    for codes in (x, y):
        n = np.bincount(codes, w)
        ranks.append((np.cumsum(n) - n + (n + 1) / 2)[codes])
    total = w.sum()
    if total < 2:
        return float("nan")
    a, b = (r - (w * r).sum() / total for r in ranks)
    spread = (w * a * a).sum() * (w * b * b).sum()
    return float((w * a * b).sum() / np.sqrt(spread)) if spread > 0 else float("nan")


def _resampled_rhos(cells: DataFrame, drawn: DataFrame) -> DataFrame:
    """replicate, rho from at most CELLS cells (__own, x, y, __c), which go to every task; a replicate is one row of its clusters."""
    table = cells.toPandas()
    number = {k: i for i, k in enumerate(dict.fromkeys(table["__own"]))}
    own = table["__own"].map(number).to_numpy(np.int64)
    codes = [np.unique(table[c].to_numpy(), return_inverse=True)[1] for c in ("x", "y")]
    held = cells.sparkSession.sparkContext.broadcast((number, own, *codes, table["__c"].to_numpy(np.float64)))

    def run(batches):
        number, own, x, y, c = held.value
        for batch in batches:
            out = []
            for taken in batch["drawn"]:
                times = np.zeros(max(1, len(number)))
                for d in taken:
                    if d["__own"] in number:
                        times[number[d["__own"]]] = d["times"]
                out.append(weighted_rho(x, y, times[own] * c) if len(own) else float("nan"))
            yield pd.DataFrame({"replicate": batch["replicate"], "rho": out})

    rows = drawn.groupBy("replicate").agg(F.collect_list(F.struct("__own", "times")).alias("drawn"))
    return rows.mapInPandas(run, "replicate long, rho double")


def spearman_interval(rows: DataFrame, x: str, y: str, cluster: str, n_boot: int) -> DataFrame:
    """One row: rank correlation and its percentile bounds; each replicate ranks its own rows anew.

    Equal rows of a cluster are one cell, and a replicate's ranks follow from how often it takes each cell: no row is
    copied. More than CELLS cells are ranked through a shuffle of the replicates' cells instead.
    """
    rows = rows.select(F.col(cluster).alias("__own"), F.col(x).alias("x"), F.col(y).alias("y"))
    drawn = B.draws(rows, "__own", n_boot)
    cells = rows.filter("x IS NOT NULL AND y IS NOT NULL AND __own IS NOT NULL").groupBy("__own", "x", "y").agg(F.count(F.lit(1)).alias("__c"))
    if cells.limit(CELLS + 1).count() <= CELLS:
        rho = _resampled_rhos(cells, drawn)
    else:
        taken = rows.join(drawn, "__own").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("replicate", "x", "y")
        rho = spearman(taken, ["replicate"], "x", "y")
    rho = rho.unionByName(spearman(rows.withColumn("replicate", F.lit(-1).cast("long")), ["replicate"], "x", "y"))
    resampled = F.when(F.col("replicate") >= 0, finite(F.col("rho")))
    out = rho.agg(F.max(F.when(F.col("replicate") < 0, F.col("rho"))).alias("point"), F.percentile(resampled, F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count(resampled).alias("n_boot"))
    return out.select("point", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "n_boot")


# --- scopes, links, deltas -----------------------------------------------------------------------------


def scope_summaries(rows: DataFrame, scope: list[str], cell: list[str], effect: str, cluster: str, gap: str | None = None, name: str | None = None) -> DataFrame:
    """Per scope and cell: n, clusters, mean effect, recovery (ratio of means, with ``gap``), a warning under 30 clusters, and
    with ``name`` the smallest and largest mean that leaving one name out gives."""
    by = [*scope, *cell]
    parts = rows.groupBy(*by, *([name] if name else [])).agg(F.sum(effect).alias("e"), F.count(F.lit(1)).alias("k"))
    cols = [F.count(F.lit(1)).alias("n"), F.count_distinct(cluster).alias("n_clusters"), F.avg(effect).alias("mean_effect")]
    out = rows.groupBy(*by).agg(*cols, *([F.try_divide(F.avg(effect), F.avg(gap)).alias("recovery")] if gap else []))
    out = out.withColumn("few_clusters", F.col("n_clusters") < 30)
    if name:
        # a row for each name of a cell
        all_ = W.partitionBy(*by)
        rest = F.sum("k").over(all_) - F.col("k")
        mean = F.when(rest > 0, (F.sum("e").over(all_) - F.col("e")) / rest)
        sensitivity = parts.withColumn("m", mean).groupBy(*by).agg(F.min("m").alias("lowest_without_one"), F.max("m").alias("highest_without_one"))
        out = out.join(sensitivity, by)
    return out


def minus_control(rows: DataFrame, pair: str, cell: list[str], control: str, effect: str, of: str, other: str) -> DataFrame:
    """cell, n, minus: the mean of what pairs' effects under ``of`` exceed those under ``other``, over pairs that have exactly one of each."""
    one = lambda c: F.max(F.when(F.col(control) == c, F.col(effect)))
    n = lambda c: F.count_if(F.col(control) == c)
    pairs = rows.groupBy(*cell, pair).agg(one(of).alias("a"), one(other).alias("b"), n(of).alias("na"), n(other).alias("nb"))
    return pairs.filter("na = 1 AND nb = 1").groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("a") - F.col("b")).alias("minus"))


def probe_link(denoise: DataFrame, noise: DataFrame, pair: str) -> DataFrame:
    """Per pair, from its denoising and its noising row (source, destination, patched margin; signed_effect): the probe's gap, both
    movements, and the symmetric movement and behaviour. Pairs without exactly one row on either side are refused."""
    both = denoise.select(pair, F.lit("denoise").alias("side")).unionByName(noise.select(pair, F.lit("noise").alias("side")))
    bad = both.groupBy(pair).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("side").alias("s")).filter("n <> 2 OR s <> 2").limit(3).collect()
    if bad:
        raise Refused(f"pairs without one row a side: {[r[0] for r in bad]}")
    side = lambda d, p: d.select(pair, *(F.col(c).alias(f"{p}_{c}") for c in ("source", "destination", "patched", "signed_effect")))
    rows = side(denoise, "denoise").join(side(noise, "noise"), pair).filter("denoise_source IS NOT NULL")
    rows = rows.withColumn("probe_gap", F.col("denoise_source") - F.col("denoise_destination"))
    rows = rows.withColumn("denoise_movement", F.col("denoise_patched") - F.col("denoise_destination")).withColumn("noise_movement", F.col("noise_destination") - F.col("noise_patched"))
    return rows.withColumn("symmetric_movement", (F.col("denoise_movement") + F.col("noise_movement")) / 2).withColumn("symmetric_behavior", (F.col("denoise_signed_effect") + F.col("noise_signed_effect")) / 2)


def matches_prior(got: dict[str, float], prior: dict[str, float], tolerance: float = 0.002) -> dict:
    """Whether each figure is within ``tolerance`` of the one expected."""
    checks = {k: abs(got[k] - v) <= tolerance for k, v in prior.items()}
    return {"pass": all(checks.values()), "checks": checks}


def paired_seed(a: DataFrame, b: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Predictions of both sides for one seed, by occurrence: key, y_true, cluster (of ``b``), pred_a, pred_b."""
    left = a.filter((F.col("seed") == seed) & F.col(key).isNotNull()).select(key, "y_true", F.col("y_pred").alias("pred_a"))
    return left.join(b.filter((F.col("seed") == seed) & F.col(key).isNotNull()).select(key, "cluster", F.col("y_pred").alias("pred_b")), key)


def with_baselines(cells: DataFrame, baselines: DataFrame, key: list[str], condition: str = "condition", original: str = "original") -> DataFrame:
    """Cells with their baseline's values; only rows of the original condition have any."""
    own = baselines.withColumn("__original", F.lit(original))
    return cells.join(own, [*(cells[k] == own[k] for k in key), cells[condition] == own["__original"]], "left").select(cells["*"], *(own[c] for c in baselines.columns if c not in key))


def delta_to_baseline(rows: DataFrame, by: list[str], condition: str, value: str, baseline: str = "baseline") -> DataFrame:
    """Adds delta: a row's value less that of the baseline of its group; null for the baseline itself."""
    base = rows.filter(F.col(condition) == baseline).groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(F.max(value).alias("__base"))
    if by:  # sums first, so that no group fills a task
        both = rows.join(base, [rows[c].eqNullSafe(base[f"__{c}"]) for c in by], "left")
    else:
        both = rows.crossJoin(F.broadcast(base))  # one row
    return both.withColumn("delta", F.when(F.col(condition) != baseline, F.col(value) - F.col("__base"))).select(*rows.columns, "delta")


def strongest(rows: DataFrame, by: list[str], key: str, score: str) -> DataFrame:
    """by, key, score of the highest score; ties to the greatest key."""
    best = F.max_by(F.struct(key, score), F.struct(F.col(score), F.col(key)))
    return rows.filter(finite(F.col(score)).isNotNull()).groupBy(*by).agg(best.alias("b")).select(*by, f"b.{key}", f"b.{score}")


def ordered_pairs(rows: DataFrame, value: str) -> DataFrame:
    """source, target: every pair of two different values."""
    one = rows.select(value).distinct()
    a, b = one.select(F.col(value).alias("source")), one.select(F.col(value).alias("target"))
    return a.join(b, F.col("source") != F.col("target"))


def require_disjoint(a: DataFrame, b: DataFrame, columns: list[str]) -> None:
    """Refuses two tables that share a value of any of the columns."""
    for c in columns:
        shared = a.select(c).intersect(b.select(c)).limit(3).collect()
        if shared:
            raise Refused(f"both hold {c} {[r[0] for r in shared]}")


def blocks_of(rows: DataFrame, order: list[str], size: int = 64) -> DataFrame:
    """Adds block: rows in order, ``size`` to a block."""
    from lexiprobe.operators.splits import global_rank

    return global_rank(rows, [F.col(c) for c in order], "__n").withColumn("block", F.floor((F.col("__n") - 1) / size).cast("long")).drop("__n")


def program_runs(rows: DataFrame, program: str, order: str) -> DataFrame:
    """One row: rows, programs, and runs of consecutive rows of one program (how often its states must be worked out, row by row)."""
    from lexiprobe.operators.splits import global_rank

    placed = global_rank(rows.select(program, order), [F.col(order)], "n")
    before = placed.select((F.col("n") + 1).alias("n"), F.col(program).alias("before"))
    both = placed.join(before, "n", "left")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(program).alias("programs"), F.count_if(~F.col(program).eqNullSafe(F.col("before")) | (F.col("n") == 1)).alias("runs"))


def usable_seeds(rows: DataFrame, group: str, label: str, seeds: list[int]) -> DataFrame:
    """seed, train, val, test, classes (in train), usable: no fold is empty and train has two classes or more."""
    from lexiprobe.operators.splits import hash_split

    each = rows.select(F.col(group).alias("g"), F.col(label).alias("y"), F.explode(F.array(*(F.lit(s) for s in seeds))).alias("seed"))
    each = each.withColumn("fold", hash_split(F.col("g"), F.col("seed")))
    n = lambda f: F.count_if(F.col("fold") == f).alias(f)
    out = each.groupBy("seed").agg(n("train"), n("val"), n("test"), F.count_distinct(F.when(F.col("fold") == "train", F.col("y"))).alias("classes"))
    return out.withColumn("usable", (F.least("train", "val", "test") > 0) & (F.col("classes") >= 2))


def split_group(policy: str, function: str = "function", repo: str = "repo") -> Column | None:
    """What keeps together when rows are split: functions, repositories, or nothing (random)."""
    if policy not in ("random", "function", "repo"):
        raise ValueError(f"no split policy {policy}")
    return {"function": F.col(function), "repo": F.col(repo)}.get(policy)


def restricted(rows: DataFrame, ids: DataFrame, key: str, share: float = 0.9) -> DataFrame:
    """``rows`` of the sampled ids; refused where fewer than ``share`` of them are there."""
    wanted, found = ids.select(key).distinct().count(), rows.select(key).join(ids.select(key).distinct(), key, "left_semi").distinct().count()
    if found < share * wanted:
        raise Refused(f"{found} of {wanted} sampled {key} are there, fewer than {share:.0%}")
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def relevant(rows: DataFrame, role: str, strategy: str = "strategy") -> DataFrame:
    """Rows of strategies that mislead about no role, or about this one."""
    return rows.filter(~F.col(strategy).startswith("misleading_") | (F.col(strategy) == f"misleading_{role}"))


def binary_target(label: Column, role: str) -> Column:
    return F.when(label == role, "target").otherwise("other")


#: Characters of a piece of text in which a place is looked up.
STEP = 256


def offset_cuts(source: Column, spans: Column, use: Callable[[Column, Column], Column]) -> Column:
    """``use(span, text)`` of each of ``spans`` (structs with s and e) and what it cuts out of the text ``source``.

    The text is cut once into pieces of STEP characters; a span looks only into those that it touches, so that
    the work grows with the text and its spans and not with their product.
    """
    pieces = F.regexp_extract_all(source, F.lit(f"(?s).{{1,{STEP}}}"), F.lit(0))

    def cut(text: Column, x: Column) -> Column:
        s, e = x["s"].cast("int"), x["e"].cast("int")
        first = F.floor(s / STEP).cast("int")
        inside = F.substring(F.array_join(F.slice(text, first + 1, F.floor((e - 1) / STEP).cast("int") - first + 1), ""), s - first * STEP + 1, e - s)
        return F.when((s >= 0) & (e > s), inside).otherwise(F.substring(source, s + 1, e - s))

    # the pieces are bound to a name, so that they are not cut again for each span
    return F.transform(F.array(pieces), lambda text: F.transform(spans, lambda x: use(x, cut(text, x))))[0]


def offset_gate(rows: DataFrame, by: list[str], source: str, tokens: str) -> DataFrame:
    """by, bad, total, ok: whether the offsets of each of a row's tokens (an array of structs s, e, piece) cut its piece out of the source."""
    wrong = offset_cuts(F.col(source), F.col(tokens), lambda x, found: ~F.coalesce(found == x["piece"], F.lit(False)))
    per = rows.select(*by, wrong.alias("wrong"))
    size = lambda c: F.coalesce(F.sum(F.greatest(F.lit(0), F.size(c))), F.lit(0)).cast("long")
    out = per.groupBy(*by).agg(size(F.filter("wrong", lambda x: x)).alias("bad"), size(F.col("wrong")).alias("total")).filter("total > 0")
    return out.withColumn("ok", F.col("bad") == 0)


def misplaced(rows: DataFrame, order: list[str], expected: Column) -> DataFrame:
    """Rows that do not stand at their place (from 0) in the order."""
    from lexiprobe.operators.splits import global_rank

    return global_rank(rows, [F.col(c) for c in order], "__n").filter((F.col("__n") - 1) != expected).drop("__n")
