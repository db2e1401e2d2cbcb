"""Fits and relaxation over tiles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import checkpointed
from . import grid


def plane_moments(w: Column, x: Column, y: Column, v: Column) -> dict[str, Column]:
    """The sums that a weighted plane fit needs; each is partial-aggregated like any sum."""
    return {"n": F.count(v), "w": F.sum(w), "wx": F.sum(w * x), "wy": F.sum(w * y), "wv": F.sum(w * v), "wxx": F.sum(w * x * x), "wxy": F.sum(w * x * y), "wyy": F.sum(w * y * y), "wxv": F.sum(w * x * v), "wyv": F.sum(w * y * v)}


def plane_of(damping: float = 0.0) -> tuple[Column, Column, Column]:
    """(value at the centre of weight, tilt in x, tilt in y) from columns of plane_moments; tilts are null
    where the samples lie on a line and nothing damps them."""
    c = F.col
    mx, my, mv = c("wx") / c("w"), c("wy") / c("w"), c("wv") / c("w")
    sxx, syy = c("wxx") / c("w") - mx * mx + damping, c("wyy") / c("w") - my * my + damping
    sxy, sxv, syv = c("wxy") / c("w") - mx * my, c("wxv") / c("w") - mx * mv, c("wyv") / c("w") - my * mv
    det = sxx * syy - sxy * sxy
    sound = F.abs(det) > 1e-9
    return mv, F.when(sound, (sxv * syy - syv * sxy) / det), F.when(sound, (syv * sxx - sxv * sxy) / det)


def fill_and_smooth(tiles: DataFrame, pull: float = 0.5, rounds: int = 4) -> DataFrame:
    """(x, y, value) after rounds of relaxation: each tile takes the mean of its known neighbours
    (diagonal ones at 0.7) and is pulled back to its own measured value by `pull`, if it has one.

    tiles: (x, y, value), value null where unknown. A tile with no known neighbour keeps what it has.
    """
    known = tiles.select("x", "y", F.col("value").alias("own"), "value")
    for k in range(rounds):
        near = grid.pairs(known, ["value"]).where("n_value is not null")
        weight = F.when((F.col("dx") != 0) & (F.col("dy") != 0), 0.7).otherwise(1.0)
        mean = near.groupBy("x", "y").agg((F.sum(weight * F.col("n_value")) / F.sum(weight)).alias("mean"))
        pulled = F.when(F.col("own").isNull(), F.col("mean")).otherwise(F.col("own") * pull + F.col("mean") * (1 - pull))
        known = known.join(mean, ["x", "y"], "left").select("x", "y", "own", F.coalesce(pulled, "value").alias("value"))
        if k % 4 == 3:
            known = checkpointed(known)
    return known.select("x", "y", "value")


def trimmed_means(samples: DataFrame, key: list[str], keep: int, most_rms: float) -> DataFrame:
    """(key..., n, mean, rms): of each group drop the sample farthest from the weighted mean until `keep`
    are left; groups with fewer samples, or whose RMS is over the limit, aren't returned.

    samples: (key..., value, weight). A group is a window of the grid, so its size is bounded.
    """

    def trim(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["value", "weight"])
        v, w = rows["value"].to_numpy(float), rows["weight"].to_numpy(float)
        while True:
            mean = (v * w).sum() / w.sum()
            if len(v) <= keep:
                break
            far = abs(v - mean).argmax()
            v, w = [*v[:far], *v[far + 1 :]], [*w[:far], *w[far + 1 :]]
            v, w = pd.Series(v).to_numpy(float), pd.Series(w).to_numpy(float)
        rms = float((((v - mean) ** 2 * w).sum() / w.sum()) ** 0.5)
        out = {**{k: rows[k].iloc[0] for k in key}, "n": len(v), "mean": float(mean), "rms": rms}
        return pd.DataFrame([out] if len(v) == keep and rms <= most_rms else [], columns=list(out))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in samples.schema if f.name in key)
    return samples.where("weight > 0 and value is not null").groupBy(*key).applyInPandas(trim, f"{kinds}, n int, mean double, rms double")


def blurred(lines: DataFrame, sigma: float, key: list[str]) -> DataFrame:
    """(key..., at, value) with each line blurred by a Gaussian; beyond its ends a line holds its end
    values. lines: (key..., at, value), a row for each place."""
    import numpy as np

    radius = max(1, int(4 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    kernel /= kernel.sum()

    def blur(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        padded = np.pad(rows["value"].to_numpy(float), radius, mode="edge")
        return rows.assign(value=np.convolve(padded, kernel, "valid"))

    return lines.groupBy(*key).applyInPandas(blur, lines.schema)


def principal_planes(samples: DataFrame, key: list[str]) -> DataFrame:
    """(key..., n, cx, cy, cz, nx, ny, nz, flatness): centre, normal and the share of the least variance of
    each group of weighted points (x, y, z). Sums are aggregated by Spark; only 3 x 3 matrices reach
    Python, a batch at a time."""
    import numpy as np

    w, x, y, z = (F.col(c) for c in ("weight", "x", "y", "z"))
    sums = {"w": w, "x": w * x, "y": w * y, "z": w * z, "xx": w * x * x, "xy": w * x * y, "xz": w * x * z, "yy": w * y * y, "yz": w * y * z, "zz": w * z * z}
    m = samples.where("weight > 0").groupBy(*key).agg(F.count("*").alias("n"), *(F.sum(v.cast("double")).alias(f"s_{k}") for k, v in sums.items()))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            total = b["s_w"].to_numpy()
            c = np.stack([b[f"s_{k}"] / total for k in "xyz"], 1)
            cov = np.empty((len(b), 3, 3))
            for i, p in enumerate("xyz"):
                for j, q in enumerate("xyz"):
                    cov[:, i, j] = b[f"s_{min(p, q)}{max(p, q)}"] / total - c[:, i] * c[:, j]
            values, vectors = np.linalg.eigh(cov)
            normal = vectors[:, :, 0] * np.where(vectors[:, 2:3, 0] < 0, -1, 1)
            flat = np.maximum(values[:, 0], 0) / np.maximum(values.sum(1), 1e-12)
            yield pd.DataFrame({**{k: b[k] for k in key}, "n": b["n"], **{f"c{a}": c[:, i] for i, a in enumerate("xyz")}, **{f"n{a}": normal[:, i] for i, a in enumerate("xyz")}, "flatness": flat})

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in m.schema if f.name in key)
    return m.mapInPandas(solve, f"{kinds}, n long, cx double, cy double, cz double, nx double, ny double, nz double, flatness double")


def focus_curves(samples: DataFrame, key: list[str], rounds: int = 60) -> DataFrame:
    """(key..., n, z0, least, slope, rms) of the curve width(z)^2 = least^2 + (slope (z - z0))^2 through each
    series of (key..., z, width), by Levenberg-Marquardt: a step that helps divides the damping, one that
    doesn't multiplies it. Series of under four samples are left out; a series is one sensor's scan."""
    import numpy as np

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=["z", "width"])
        z, v = rows["z"].to_numpy(float), rows["width"].to_numpy(float)
        names = [*key, "n", "z0", "least", "slope", "rms"]
        if len(z) < 4:
            return pd.DataFrame([], columns=names)
        p = np.array([z[v.argmin()], max(v.min(), 1e-6), (v.max() - v.min()) / max(np.ptp(z), 1e-6) * 2 + 1e-6])
        curve = lambda p: np.hypot(p[1], p[2] * (z - p[0]))
        damping, error = 1e-2, ((curve(p) - v) ** 2).sum()
        for _ in range(rounds):
            f = np.maximum(curve(p), 1e-12)
            j = np.stack([-p[2] ** 2 * (z - p[0]) / f, p[1] / f, p[2] * (z - p[0]) ** 2 / f], 1)
            a = j.T @ j
            step = np.linalg.lstsq(a + damping * np.diag(np.maximum(np.diag(a), 1e-9)), j.T @ (v - f), rcond=None)[0]
            now = ((curve(p + step) - v) ** 2).sum()
            if now < error:
                done = error - now < 1e-12 * max(error, 1e-12)
                p, error, damping = p + step, now, damping / 5
                if done:
                    break
            else:
                damping *= 5
                if damping > 1e9:
                    break
        out = [*(rows[k].iloc[0] for k in key), len(z), float(p[0]), float(abs(p[1])), float(abs(p[2])), float(np.sqrt(error / len(z)))]
        return pd.DataFrame([out], columns=names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in samples.schema if f.name in key)
    return samples.groupBy(*key).applyInPandas(fit, f"{kinds}, n int, z0 double, least double, slope double, rms double")
