"""Periods of disparity: a repetitive object gives a tile several maxima at equal distances, over many passes.

Measurements of a tile and its eight neighbours are gathered in blocks of tiles with a margin of one, so a row goes to
1.3 blocks on average, not to nine tiles. Equal measurements are counted first: a tile with endless repeats of few values
stays small. All tiles of a block are worked on together; there is no loop over tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 16
#: Weights of neighbours: the tile itself, beside it, at its corners.
OWN, BESIDE, CORNER = 1.0, 0.5, 0.25
#: Limits on means hold up to this, so that they don't fall by the order of sums.
ROUNDING = 1e-9
PERIODS = "x long, y long, base double, period double, strength double, n_peaks long, n_layers long"


def _around(pdf: pd.DataFrame, bx: int, by: int) -> tuple[np.ndarray, ...]:
    """Measurements as each tile of the block sees them: (tile in the block, disparity, weighted strength, count, own)."""
    x, y = pdf["x"].to_numpy() - bx * BLOCK, pdf["y"].to_numpy() - by * BLOCK
    d, w, n = (pdf[c].to_numpy() for c in ("disparity", "w", "n"))
    parts = []
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            tx, ty = x + dx, y + dy
            inside = (tx >= 0) & (tx < BLOCK) & (ty >= 0) & (ty < BLOCK)
            share = (OWN, BESIDE, CORNER)[abs(dx) + abs(dy)]
            parts.append((ty[inside] * BLOCK + tx[inside], d[inside], w[inside] * share, n[inside], np.full(inside.sum(), dx == 0 == dy)))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _maxima(t: np.ndarray, d: np.ndarray, w: np.ndarray, n: np.ndarray, least: float, join: float, apart: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Strongest first, a maximum of every tile a round: what lies within `join` of the strongest is merged into it, what
    lies within `apart` can't start another. Yields disparity and strength by tile, NaN where a tile has no more.
    Of equal strengths the lower disparity goes first."""
    size = BLOCK * BLOCK
    free, start = np.ones(len(t), bool), w >= least
    while (rows := np.flatnonzero(free & start)).size:
        rows = rows[np.lexsort((d[rows], -w[rows], t[rows]))]
        rows = rows[np.r_[True, t[rows][1:] != t[rows][:-1]]]
        at = np.full(size, np.nan)
        at[t[rows]] = d[rows]
        off = np.abs(d - at[t])
        member = free & (off <= join)
        mass = np.bincount(t[member], (w * n)[member], size)
        strength = np.full(size, np.nan)
        strength[t[rows]] = w[rows]
        np.fmax.at(strength, t[member], w[member])
        with np.errstate(invalid="ignore", divide="ignore"):
            yield np.bincount(t[member], (w * n * d)[member], size) / mass, strength
        free &= ~member
        start &= ~(off < apart)


def periods(measured: DataFrame, trusted: float, floor: float, over: float, join: float, apart: float, repeats: int, tolerance: float, scale: float = 0.85) -> DataFrame:
    """Tiles whose maxima lie at equal distances: (x, y, base, period, strength, n_peaks, n_layers).

    measured: (x, y, target, resid, strength), any number of passes. A measurement counts if its residual is at most
    `trusted` and its strength above `floor`; its disparity is target + resid / scale, its weight strength - floor, halved
    beside and quartered at corners. A tile is periodic if it has more than `repeats` maxima of weight `over` or more, the
    first `repeats` + 1 in order of disparity lie within `tolerance` of equal distances, and its own measurements reach
    some maximum within `tolerance`. base: the lowest maximum; period: mean distance; strength: mean over these maxima;
    n_layers: maxima that own measurements reach (the strongest within reach takes one).

    Windows lie around the strongest measurement as it was, not around the mean that moves while others join.
    Rows with null, NaN or infinite values in any of the five columns count for nothing; an empty table gives none.
    """
    found = measured.select("x", "y", (F.col("target") + F.col("resid") / scale).alias("disparity"), (F.col("strength") - floor).alias("w"), "resid")
    finite = (F.abs("disparity") < float("inf")) & (F.col("w") > 0) & (F.col("w") < float("inf"))
    found = found.where((F.abs("resid") <= trusted) & finite).where("x is not null and y is not null")
    found = found.groupBy("x", "y", "disparity", "w").agg(F.count("*").alias("n"))
    for axis, block in (("x", "bx"), ("y", "by")):
        c = F.col(axis)
        found = found.withColumn(block, F.explode(F.sequence(F.floor((c - 1) / BLOCK), F.floor((c + 1) / BLOCK))))

    def of_block(pdf: pd.DataFrame) -> pd.DataFrame:
        bx, by = int(pdf["bx"].iloc[0]), int(pdf["by"].iloc[0])
        t, d, w, n, own = _around(pdf, bx, by)
        found = list(_maxima(t, d, w, n, over, join, apart))
        layers, reached = np.zeros(BLOCK * BLOCK, int), ~own
        for at, _ in found:
            hit = ~reached & (np.abs(d - at[t]) <= tolerance + ROUNDING)
            layers[np.unique(t[hit])] += 1
            reached |= hit
        if len(found) <= repeats:
            return pd.DataFrame({c.split()[0]: [] for c in PERIODS.split(", ")})
        at, strength = (np.array(p) for p in zip(*found))
        order = np.argsort(at, axis=0, kind="stable")
        at, strength = np.take_along_axis(at, order, 0), np.take_along_axis(strength, order, 0)
        period = (at[repeats] - at[0]) / repeats
        even = np.abs(at[0] + np.arange(repeats + 1)[:, None] * period - at[: repeats + 1]) <= tolerance + ROUNDING
        good = np.flatnonzero(even[1:repeats].all(0) & ~np.isnan(at[repeats]) & (layers > 0))
        return pd.DataFrame({
            "x": bx * BLOCK + good % BLOCK, "y": by * BLOCK + good // BLOCK, "base": at[0, good], "period": period[good],
            "strength": strength[: repeats + 1, good].mean(0), "n_peaks": (~np.isnan(at[:, good])).sum(0), "n_layers": layers[good],
        })

    return found.groupBy("bx", "by").applyInPandas(of_block, PERIODS)
