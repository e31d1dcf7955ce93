"""Logistic probes of many layers and seeds at once: every step of all fits is one job.

A task takes its rows in batches, and for each fit that a batch belongs to sums the loss, the gradient and
the Hessian at the fit's present weights; sums of a fit are added by key. The driver holds the weights, solves one
system of the vectors' width for each fit and sends the new weights with the next job. Fits that are done take no
further part.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Wider vectors would make a fit's Hessian too large for a task that holds several.
MAX_WIDTH = 1024


@dataclass
class Fit:
    """One probe on its way: scaled weights with the bias last, and the last point whose loss is known."""

    mean: np.ndarray
    deviation: np.ndarray
    class_weights: tuple[float, float]
    now: np.ndarray
    best: np.ndarray | None = None
    loss: float = np.inf
    step: np.ndarray | None = None
    done: bool = False
    halved: int = 0
    path: list[float] = field(default_factory=list)

    def unscaled(self) -> tuple[list[float], float]:
        w = self.best[:-1] / self.deviation
        return w.tolist(), float(self.best[-1] - w @ self.mean)


def _by_key(sums: dict[tuple[int, int], np.ndarray]):
    """Rows of each fit's sums, cut so that a row stays small."""
    for (layer, seed), v in sums.items():
        for at in range(0, len(v), 1 << 16):
            part = v[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([layer], pa.int32()), pa.array([seed], pa.int32()), pa.array([at // (1 << 16)], pa.int32()), pa.array([part], pa.list_(pa.float64()))], ["layer", "seed", "part", "v"])


def _summed(rows: DataFrame, of) -> dict[tuple[int, int], np.ndarray]:
    """What ``of(layer, x, y, use)`` yields as (seed number, vector), added by fit over all rows; one job.

    ``rows``: layer, vec, y and use (whether the row belongs to each seed's train fold).
    """

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            layers = batch.column(0).to_numpy(zero_copy_only=False)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x, y = flat.reshape(batch.num_rows, -1), batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            use = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(bool).reshape(batch.num_rows, -1)
            for layer in np.unique(layers).tolist():
                own = layers == layer
                for seed, v in of(layer, x[own], y[own], use[own]):
                    key = (layer, seed)
                    sums[key] = sums[key] + v if key in sums else v
        yield from _by_key(sums)

    parts = rows.select("layer", "vec", "y", "use").mapInArrow(run, "layer int, seed int, part int, v array<double>")
    cells = parts.select("layer", "seed", "part", F.posexplode("v").alias("i", "x")).groupBy("layer", "seed", "part", "i").agg(F.sum("x").alias("x"))
    whole = cells.groupBy("layer", "seed", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("v"))
    out: dict[tuple[int, int], dict[int, list]] = {}
    for r in whole.collect():  # one vector of sums a fit
        out.setdefault((r["layer"], r["seed"]), {})[r["part"]] = r["v"]
    return {k: np.concatenate([p[i] for i in sorted(p)]) for k, p in out.items()}


def _start(rows: DataFrame, balanced: bool) -> dict[tuple[int, int], Fit]:
    """Fits with the scales of their train folds (population deviation, 1 where there is none); those with one class are left out."""

    def of(layer, x, y, use):
        for seed in range(use.shape[1]):
            own, ones = x[use[:, seed]], y[use[:, seed]]
            yield seed, np.concatenate([[len(own), ones.sum()], own.sum(axis=0), (own * own).sum(axis=0)])

    out = {}
    for key, v in sorted(_summed(rows, of).items()):
        n, ones = v[0], v[1]
        if not 0 < ones < n:
            continue
        d = (len(v) - 2) // 2
        mean = v[2 : 2 + d] / n
        deviation = np.sqrt(np.maximum(v[2 + d :] / n - mean * mean, 0.0))
        deviation[deviation <= 1e-9 * np.abs(mean)] = 1.0
        weights = (n / (2 * (n - ones)), n / (2 * ones)) if balanced else (1.0, 1.0)
        out[key] = Fit(mean, np.where(deviation > 0, deviation, 1.0), weights, np.zeros(d + 1))
    return out


def fit_probes(rows: DataFrame, c: float = 1.0, balanced: bool = True, tolerance: float = 1e-7, max_iter: int = 60) -> dict[tuple[int, int], tuple[list[float], float]]:
    """{(layer, seed number): (weights, bias)} for unscaled vectors, from ``rows`` (layer, vec, y of 0 or 1, use): as many jobs as the slowest fit takes steps.

    Each minimises the summed weighted logistic loss of its train fold, scaled, plus the squared weights over 2 ``c``.
    Newton steps are halved when they do not lower the loss. Fits whose train fold has one class are left out.
    """
    fits = _start(rows, balanced)
    for _ in range(max_iter):
        going = {k: (f.mean, f.deviation, f.class_weights, f.now) for k, f in fits.items() if not f.done}
        if not going:
            break
        width = max(len(g[3]) for g in going.values())
        if width > MAX_WIDTH + 1:
            raise ValueError(f"vectors of {width - 1} entries are too wide for fits in one job")
        sent = rows.sparkSession.sparkContext.broadcast(going)

        def of(layer, x, y, use, sent=sent):
            for seed in range(use.shape[1]):
                if (layer, seed) not in sent.value or not use[:, seed].any():
                    continue
                mean, deviation, weights, w = sent.value[layer, seed]
                own, t = (x[use[:, seed]] - mean) / deviation, y[use[:, seed]]
                z = own @ w[:-1] + w[-1]
                k = np.where(t > 0, weights[1], weights[0])
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                own = np.column_stack([own, np.ones(len(own))])
                loss = (k * (np.logaddexp(0, z) - t * z)).sum()
                yield seed, np.concatenate([[loss], own.T @ (k * (p - t)), ((own * (k * p * (1 - p))[:, None]).T @ own).ravel()])

        for key, v in _summed(rows, of).items():
            _advance(fits[key], v, c, tolerance)
        sent.destroy()
    return {k: f.unscaled() for k, f in fits.items()}


def _advance(fit: Fit, sums: np.ndarray, c: float, tolerance: float) -> None:
    """One Newton step of a fit from its sums, or half of the last one where the loss has not fallen."""
    d = len(fit.now)
    flat = np.append(np.full(d - 1, 1 / c), 0.0)
    loss = sums[0] + 0.5 * (flat * fit.now * fit.now).sum()
    fit.path.append(float(loss))
    if fit.best is not None and not loss <= fit.loss + 1e-12 * abs(fit.loss) and fit.halved < 30:
        fit.halved += 1
        fit.step = fit.step / 2
        fit.now = fit.best + fit.step
        return
    gradient = sums[1 : d + 1] + flat * fit.now
    hessian = sums[d + 1 :].reshape(d, d) + np.diag(flat)
    fit.best, fit.loss, fit.halved = fit.now, loss, 0
    fit.step = -np.linalg.lstsq(hessian, gradient, rcond=None)[0]
    fit.now = fit.best + fit.step
    fit.done = bool(np.abs(fit.step).max() < tolerance)
