"""Levenberg-Marquardt fits: thousands of small ones in a batch, or one over all rows by distributed sums.

A model is a function of parameters and sample columns that returns values and their derivatives. Both drivers step alike:
the normal equations with the diagonal raised by lambda; a step that lowers the RMS is taken and lambda shrinks, any
other isn't and lambda grows; a fit ends when a step lowers the RMS by less than a share, when lambda passes its limit, or
after a number of steps. It has succeeded if it ended on a small step, or is better than it began.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import small_batches


@dataclass(frozen=True)
class Steps:
    """First lambda, its factors after a good and a bad step, its limit; least share by which RMS must fall; most steps."""

    damping: float = 0.1
    good: float = 0.5
    bad: float = 8.0
    most: float = 100.0
    share: float = 0.001
    rounds: int = 20


def _solved(jtj: np.ndarray, jtr: np.ndarray, damping: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of many problems, and which of them have one (their equations aren't singular)."""
    p = jtj.shape[-1]
    raised = jtj + damping[:, None, None] * jtj * np.eye(p)
    scale = np.sqrt(np.maximum(np.einsum("nii->ni", raised), 1e-300))
    even = raised / scale[:, :, None] / scale[:, None, :]
    sound = np.isfinite(even).all((1, 2)) & np.isfinite(jtr).all(1)
    sound[sound] = np.linalg.cond(even[sound]) < 1e13 if sound.any() else sound[sound]
    step = np.zeros_like(jtr)
    step[sound] = np.linalg.solve(even[sound], (jtr / scale)[sound][:, :, None])[:, :, 0] / scale[sound]
    return step, sound


# many small fits

#: Samples, with padding, that are fitted at once; each takes some 500 bytes on the way.
PADDED = 1 << 16


def fitted(model: Callable, start: np.ndarray, samples: dict[str, np.ndarray], value: np.ndarray, weight: np.ndarray, steps: Steps = Steps(), pull: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Fit every problem of a batch. start (n, p); samples, value and weight (n, m), weight 0 where there is no sample; pull (p)
    weighs parameters drawn to 0 (each as a sample of value 0, whose weight it is).

    model(parameters (k, p), samples (k, m)) -> values (k, m), derivatives (k, m, p). Returns parameters, rms,
    first_rms, steps and success of each; a problem without samples keeps its start and fails.
    """
    n, p = start.shape
    pull = np.zeros(p) if pull is None else pull
    total = weight.sum(1) + pull.sum()
    known = total > 0

    def measured(rows, at):
        w = weight[rows]
        f, j = model(at, {k: v[rows] for k, v in samples.items()})
        off = np.where(w > 0, value[rows] - f, 0.0)
        j = np.where((w > 0)[:, :, None], j, 0.0)
        jtj = np.einsum("nmp,nm,nmq->npq", j, w, j, optimize=True) + np.diag(pull)
        jtr = np.einsum("nmp,nm,nm->np", j, w, off, optimize=True) - pull * at
        return np.sqrt(((w * off * off).sum(1) + (pull * at * at).sum(1)) / np.where(total[rows] > 0, total[rows], 1.0)), jtj, jtr

    at = start.astype(float).copy()
    rms, jtj, jtr = measured(np.arange(n), at)
    first, damping, taken, success = rms.copy(), np.full(n, steps.damping), np.zeros(n, np.int64), np.zeros(n, bool)
    active = np.flatnonzero(known & np.isfinite(rms))
    for _ in range(steps.rounds):
        if not len(active):
            break
        step, sound = _solved(jtj[active], jtr[active], damping[active])
        trial = at[active] + step
        new, new_jtj, new_jtr = measured(active, trial)
        better = sound & (new < rms[active])
        done = ~sound | (better & (new >= rms[active] * (1 - steps.share)))
        taken[active] += 1
        rows = active[better]
        at[rows], rms[rows], jtj[rows], jtr[rows] = trial[better], new[better], new_jtj[better], new_jtr[better]
        success[active] = better
        damping[active] *= np.where(better, steps.good, steps.bad)
        active = active[~done & (better | (damping[active] <= steps.most))]
    success |= rms < first
    return {"parameters": at, "rms": np.where(known, rms, np.nan), "first_rms": np.where(known, first, np.nan), "steps": taken, "success": success & known}


def fit_groups(samples: DataFrame, key: list[str], model: Callable, columns: list[str], start: Column, steps: Steps = Steps(), pull: list[float] | None = None) -> DataFrame:
    """(key..., parameters, rms, first_rms, steps, success): a fit for each group of samples (key..., columns..., value, weight).

    start is a column of the group's aggregates that gives its first parameters as an array. A group is what one tile or
    series has, so it is held whole; groups of a batch are fitted together. Null values or weights count as no sample.
    """
    given = F.struct(*(F.col(c).cast("double").alias(c) for c in (*columns, "value", "weight")))
    sound = samples.where("value is not null and weight is not null")
    groups = sound.groupBy(*key).agg(F.sort_array(F.collect_list(given)).alias("samples"), start.cast("array<double>").alias("start"))
    pulls = None if pull is None else np.array(pull)

    small_batches(samples.sparkSession)

    def fit(batches):
        for batch in batches:
            most = pc.max(batch["samples"].value_lengths()).as_py() if batch.num_rows else 0
            at_once = max(PADDED // max(most, 1), 1)
            for start in range(0, batch.num_rows, at_once):
                yield fit_some(batch.slice(start, at_once))

    def fit_some(batch):
        n = batch.num_rows
        sizes = batch["samples"].value_lengths().to_numpy(zero_copy_only=False)
        row, flat = np.repeat(np.arange(n), sizes), batch["samples"].flatten()
        at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        padded = {}
        for c in (*columns, "value", "weight"):
            padded[c] = np.zeros((n, int(sizes.max())))
            padded[c][row, at] = flat.field(c).to_numpy(zero_copy_only=False)
        value, weight = padded.pop("value"), padded.pop("weight")
        first = batch["start"].flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        got = fitted(model, first, padded, value, weight, steps, pulls)
        ends = pa.array(np.arange(n + 1, dtype=np.int32) * first.shape[1])
        return pa.RecordBatch.from_arrays(
            [*(batch[k] for k in key), pa.ListArray.from_arrays(ends, pa.array(got["parameters"].ravel())), *(pa.array(got[c]) for c in ("rms", "first_rms", "steps", "success"))],
            [*key, "parameters", "rms", "first_rms", "steps", "success"])

    kinds = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in key)
    return groups.mapInArrow(fit, f"{kinds}, parameters array<double>, rms double, first_rms double, steps long, success boolean")


def peak_model(groups: int) -> Callable:
    """A common peak seen by several pairs of sensors: a (1 - (dx / wx)^2 - (dy / wy)^2), dx from the common centre x0 and dy from 0.

    Parameters: x0, w, wxy and an amplitude for each pair; wy is w times the sample's scale and wx is wy + wxy. Samples: x, y,
    scale, pair (from 0) and diagonal, where distances are root 2 longer.
    """

    def model(at: np.ndarray, s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        x0, w, wxy = (at[:, k, None] for k in range(3))
        long = np.where(s["diagonal"] > 0, 2**0.5, 1.0)
        wy = np.where(s["scale"] > 0, w * s["scale"], 1.0)
        wx = wy + wxy
        pair = s["pair"].astype(np.int64)
        a = np.take_along_axis(at[:, 3:], pair, 1)
        dx, dy = long * (s["x"] - x0) / wx, long * s["y"] / wy
        d = 1 - dx**2 - dy**2
        j = np.zeros((*d.shape, 3 + groups))
        by_x, by_y = 2 * a * dx**2 / wx, 2 * a * dy**2 / wy
        j[:, :, 0], j[:, :, 1], j[:, :, 2] = 2 * long * a * dx / wx, s["scale"] * (by_x + by_y), by_x
        np.put_along_axis(j, 3 + pair[:, :, None], d[:, :, None], 2)
        return a * d, j

    return model


# one fit over all rows


def _sums(rows: DataFrame, columns: list[str], model: Callable, at: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(weight, squares, J'WJ, J'Wr) of all rows at some parameters. A task adds its batches up and gives one row of p (p + 1) + 2
    numbers; these are added by place, so the driver gets that many whatever the rows."""
    p = len(at)

    def partial(batches):
        total = np.zeros(2 + p + p * p)
        for batch in batches:
            s = {c: batch[c].to_numpy(zero_copy_only=False).astype(float) for c in columns}
            value, weight = (batch[c].to_numpy(zero_copy_only=False).astype(float) for c in ("value", "weight"))
            f, j = model(at[None, :], {k: v[None, :] for k, v in s.items()})
            off, j = value - f[0], j[0]
            total[0] += weight.sum()
            total[1] += (weight * off * off).sum()
            total[2 : 2 + p] += j.T @ (weight * off)
            total[2 + p :] += (j.T @ (weight[:, None] * j)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

    parts = rows.mapInArrow(partial, "sums array<double>")
    found = parts.select(F.posexplode("sums").alias("place", "v")).groupBy("place").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(2 + p + p * p)
    for r in found:
        total[r["place"]] = r["v"]
    return total[0], total[1], total[2 + p :].reshape(p, p), total[2 : 2 + p]


@dataclass(frozen=True)
class Fit:
    parameters: list[float]
    rms: float
    first_rms: float
    steps: int
    success: bool
    spread: list[float]


def fit_all(rows: DataFrame, columns: list[str], model: Callable, start: list[float], steps: Steps = Steps(), free: list[bool] | None = None) -> Fit:
    """One fit over rows (columns..., value, weight), which every step scans once: give a written table. Parameters that aren't
    free stay as they start. spread is each parameter's standard deviation, 0 of fixed ones. Rows with a null count not."""
    rows = rows.select(*columns, "value", "weight").dropna()
    at, moves = np.array(start, float), np.flatnonzero(np.ones(len(start), bool) if free is None else np.array(free))
    weight, squares, jtj, jtr = _sums(rows, columns, model, at)
    rms = first = float(np.sqrt(squares / weight)) if weight > 0 else float("nan")
    damping, taken, success = steps.damping, 0, False
    while weight > 0 and len(moves) and taken < steps.rounds:
        cut = np.ix_(moves, moves)
        step, sound = _solved(jtj[cut][None], jtr[moves][None], np.array([damping]))
        taken += 1
        if not sound[0]:
            success = False
            break
        trial = at.copy()
        trial[moves] += step[0]
        _, new, new_jtj, new_jtr = _sums(rows, columns, model, trial)
        new = float(np.sqrt(new / weight))
        success = new < rms
        if success:
            done = new >= rms * (1 - steps.share)
            at, rms, jtj, jtr, damping = trial, new, new_jtj, new_jtr, damping * steps.good
            if done:
                break
        else:
            damping *= steps.bad
            if damping > steps.most:
                break
    spread = np.zeros(len(at))
    if weight > 0 and len(moves):
        spread[moves] = np.sqrt(np.maximum(np.diag(np.linalg.pinv(jtj[np.ix_(moves, moves)])) * rms**2, 0))
    return Fit(at.tolist(), rms, first, taken, bool(success or rms < first), spread.tolist())


def linear_model(columns: list[str]) -> Callable:
    """A constant and a slope for each column."""

    def model(at, s):
        j = np.stack([np.ones_like(next(iter(s.values()))), *(s[c] for c in columns)], -1)
        return (j * at[:, None, :]).sum(-1), j

    return model


def solved(rows: DataFrame, columns: list[str], free: list[bool] | None = None) -> list[float]:
    """Weighted least squares of value by a constant and columns in one scan; of a singular system the smallest solution.
    Coefficients that aren't free are 0."""
    rows = rows.select(*columns, "value", "weight").dropna()
    p = len(columns) + 1
    _, _, jtj, jtr = _sums(rows, columns, linear_model(columns), np.zeros(p))
    moves = np.flatnonzero(np.ones(p, bool) if free is None else np.array(free))
    out = np.zeros(p)
    out[moves] = np.linalg.lstsq(jtj[np.ix_(moves, moves)], jtr[moves], rcond=1e-13)[0]
    return out.tolist()


def focus_model(channels: int) -> Callable:
    """Blur over a field by focus position: sqrt((k_c (z - z0 - c_c - tx x - ty y))^2 + r_c^2) for channel c, whose c_0 is 0.

    Parameters: z0, tx, ty, then k, r and c of each channel. Samples: z, x, y, channel (from 0)."""

    def model(at: np.ndarray, s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        c = s["channel"].astype(np.int64)
        k, r, shift = (np.take_along_axis(at[:, 3 + n :: 3], c, 1) for n in range(3))
        shift = np.where(c > 0, shift, 0.0)
        z0, tx, ty = (at[:, n, None] for n in range(3))
        away = s["z"] - z0 - shift - tx * s["x"] - ty * s["y"]
        f = np.sqrt((k * away) ** 2 + r**2)
        j = np.zeros((*f.shape, 3 + 3 * channels))
        slope = -(k**2) * away / f
        j[:, :, 0], j[:, :, 1], j[:, :, 2] = slope, slope * s["x"], slope * s["y"]
        for n, d in enumerate((k * away**2 / f, r / f, np.where(c > 0, slope, 0.0))):
            np.put_along_axis(j, (3 + n + 3 * c)[:, :, None], d[:, :, None], 2)
        return f, j

    return model
