"""Pass/fail gates over paired cells: named checks on means and cluster intervals, run in a cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiprobe.operators.bootstrap import draws
from lexiprobe.operators.joins import Refused, exact_pairs

# The protocol's thresholds.
TAU_FLOOR = {"float16": 0.05, "float32": 1e-4}
MIN_AUC, MIN_ACCURACY, CHANCE, MIN_RECOVERY = 0.70, 0.60, 0.50, 0.05


def identity_tolerance(max_drift: float, dtype: str = "float16") -> float:
    return max(TAU_FLOOR[dtype], 10 * max_drift)


def clustered_interval(rows: DataFrame, value: Column, cluster: str, n_boot: int = 2000, over: Column | None = None, drawn: DataFrame | None = None) -> dict:
    """Point, BCa bounds and clusters of a mean (or of a ratio of means with ``over``), whole clusters resampled.

    Clusters are drawn and summed by Spark; the ``n_boot`` values of the replicates come to the driver. Intervals on the
    same ``drawn`` table are paired. Under two clusters the bounds are NaN.
    """
    from lexiprobe.operators import bootstrap as B

    den = F.lit(1.0) if over is None else over
    cells = rows.groupBy(cluster).agg(F.sum(value.cast("double")).alias("a"), F.sum(den).alias("b"))
    all_ = cells.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("n")).first()
    point = all_["a"] / all_["b"] if all_["b"] else float("nan")
    if all_["n"] < 2:
        return {"point": point, "ci_low": float("nan"), "ci_high": float("nan"), "n_clusters": all_["n"]}
    drawn = B.draws(cells, cluster, n_boot) if drawn is None else drawn
    stat = F.when(F.col("b") != 0, F.col("a") / F.col("b"))
    boot = [r[0] for r in B.replicates(cells, drawn, cluster, ["a", "b"], []).select(stat).collect() if r[0] is not None]
    accel = B.accelerations(B.jackknife(cells, cluster, ["a", "b"]).select(stat.alias("stat")), []).first()["accel"]
    lo, hi = B.bca_bounds(point, boot, accel)
    return {"point": point, "ci_low": lo, "ci_high": hi, "n_clusters": all_["n"]}


def verdict(checks: dict[str, bool], **more) -> dict:
    return {"pass": all(checks.values()), "checks": checks, **more}


def _cell(layer: int, span: str, direction: str, control: str) -> Column:
    return (F.col("layer") == layer) & (F.col("span") == span) & (F.col("direction") == direction) & (F.col("control") == control)


def smoke_gate(rows: DataFrame, probe: int, tau: float | None = None, pairs: int = 8) -> dict:
    """Twelve checks over the smoke pairs' cells; the tolerance is that of the rows' dtype (float16 where they do not say one)."""
    kinds = F.collect_set(F.lower("dtype")) if "dtype" in rows.columns else F.array().cast("array<string>")
    drift, kinds = rows.agg(F.coalesce(F.max(F.abs("baseline_drift")), F.lit(0.0)), kinds).first()
    dtype = "float32" if len(kinds) == 1 and kinds[0] not in ("float16", "fp16") else "float16"
    tau = identity_tolerance(drift, dtype) if tau is None else tau
    groups = {"class": _cell(-1, "baseline_class", "none", "unpatched"), "function": _cell(-1, "baseline_function", "none", "unpatched")}
    for d in ("denoise", "noise"):
        groups |= {f"{d}_target": _cell(probe, "query_name", d, "target"), f"{d}_placebo": _cell(probe, "placebo", d, "target"), f"{d}_random": _cell(probe, "query_name", d, "random"), f"{d}_same": _cell(probe, "query_name", d, "same_source"), f"{d}_layer0": _cell(0, "query_name", d, "target")}
    label = F.lit(None).cast("string")
    for g, where in groups.items():
        label = F.when(where, g).otherwise(label)
    cells = rows.withColumn("__g", label).filter("__g IS NOT NULL").withColumn("__v", F.when(F.col("layer") == -1, F.col("source_D")).otherwise(F.col("signed_effect")))
    n = cells.select("pair_id").distinct().limit(pairs + 1).count()
    if n != pairs:
        return verdict({"exact_pair_ids": False}, error=f"{n} pairs, not {pairs}")
    try:
        wide = exact_pairs(cells, "pair_id", "__g", list(groups), ["__v"])
    except Refused as e:
        return verdict({"exact_row_cube": False}, error=str(e))
    v = lambda g: F.col(f"{g}___v")
    s = wide.agg(
        F.count_if(v("class") > 0).alias("class_up"), F.count_if(v("class") > v("function")).alias("above"), F.avg(v("class") - v("function")).alias("gap"), F.count_if(v("function") < 0).alias("function_down"),
        *(F.avg(v(f"{d}_{c}")).alias(f"{d}_{c}") for d in ("denoise", "noise") for c in ("target", "placebo", "random")),
        *(F.max(F.greatest(F.abs(v(f"denoise_{c}")), F.abs(v(f"noise_{c}")))).alias(c) for c in ("same", "layer0")),
    ).first()
    checks = {
        "exact_pair_ids": True, "exact_row_cube": True, "class_positive": s["class_up"] >= 6, "function_below_class": s["above"] >= 6, "mean_gap_positive": s["gap"] > 0,
        "mean_denoise_positive": s["denoise_target"] > 0, "mean_noise_positive": s["noise_target"] > 0,
        **{f"target_gt_{c}": s["denoise_target"] > s[f"denoise_{c}"] and s["noise_target"] > s[f"noise_{c}"] for c in ("placebo", "random")},
        "max_drift": drift <= 0.01, "same_source_within_tau": s["same"] <= tau, "layer0_within_tau": s["layer0"] <= tau,
    }
    return verdict(checks, tau=tau, max_drift=drift, diagnostics={"function_negative": s["function_down"] >= 6})


def behavior_gate(rows: DataFrame, cluster: str = "cluster_id") -> dict:
    """Six checks on (d_class, d_function): signs, gap and their cluster intervals."""
    drawn = draws(rows, cluster, 2000)
    ci = lambda c: clustered_interval(rows, c.cast("double"), cluster, drawn=drawn)
    acc, value, above, gap = ci(F.col("d_class") > 0), ci(F.col("d_class")), ci(F.col("d_class") > F.col("d_function")), ci(F.col("d_class") - F.col("d_function"))
    checks = {
        "class_accuracy": acc["point"] >= MIN_ACCURACY, "class_accuracy_ci": acc["ci_low"] > CHANCE, "class_D_ci": value["ci_low"] > 0,
        "pair_gap_accuracy": above["point"] >= MIN_ACCURACY, "pair_gap_accuracy_ci": above["ci_low"] > CHANCE, "gap_ci": gap["ci_low"] > 0,
    }
    return verdict(checks, class_acc=acc, class_D=value, pair_gap_acc=above, gap=gap)


def causal_gate(rows: DataFrame, tau: float, cluster: str = "cluster_id") -> dict:
    """Ten checks on paired effects: denoise, noise and their placebo and random controls, and gap."""
    least = max(0.10, 5 * tau)
    ci, checks = {}, {}
    drawn = draws(rows, cluster, 2000)
    for d in ("denoise", "noise"):
        ci[d] = clustered_interval(rows, F.col(d), cluster, drawn=drawn)
        checks |= {f"{d}_threshold": ci[d]["point"] >= least, f"{d}_ci": ci[d]["ci_low"] > 0}
        for c in ("placebo", "random"):
            ci[f"{d}_minus_{c}"] = clustered_interval(rows, F.col(d) - F.col(f"{d}_{c}"), cluster, drawn=drawn)
            checks[f"{d}_{c}_ci"] = ci[f"{d}_minus_{c}"]["ci_low"] > 0
        share = rows.agg(F.avg(d) / F.avg("gap")).first()[0]
        ci[f"recovery_{d}"] = share
        checks[f"recovery_{d}"] = share is not None and share >= MIN_RECOVERY
    return verdict(checks, ci=ci, threshold=least)


def probe_gate(rows: DataFrame, declaration_auc: float, query_auc: float, cluster: str = "cluster_id") -> dict:
    """Three checks: the margins' gap and two AUCs."""
    gap = clustered_interval(rows, F.col("class_margin") - F.col("function_margin"), cluster)
    return verdict({"margin_gap_ci": gap["ci_low"] > 0, "declaration_auc": declaration_auc >= MIN_AUC, "query_auc": query_auc >= MIN_AUC}, margin_gap=gap)


def cascade(steps: list) -> dict[str, dict]:
    """Runs (name, function, needs) in turn; a step whose needs did not pass is skipped with the reason."""
    out: dict[str, dict] = {}
    for name, run, needs in steps:
        failed = [n for n in needs if not out.get(n, {}).get("pass")]
        out[name] = {"pass": False, "skipped": f"needs {', '.join(failed)}"} if failed else run()
    return out
