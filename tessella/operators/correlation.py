"""Correlation, convolution and shifts of square tiles in the frequency domain, a batch of tiles at a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _stack(tiles: pd.Series):
    """Tiles as one array (tile, row, column), and where there is one."""
    import numpy as np

    known = tiles.notna().to_numpy()
    side = int(len(next(iter(tiles[known]), [0.0])) ** 0.5)
    out = np.zeros((len(tiles), side, side))
    if known.any():
        out[known] = np.stack([np.asarray(t, float) for t in tiles[known]]).reshape(-1, side, side)
    return out, known


def _lists(values, known) -> pd.Series:
    return pd.Series([v.ravel() if k else None for v, k in zip(values, known, strict=True)], dtype=object)


def correlated(a: Column, b: Column, phase: float = 0.0, fat_zero: float = 0.0) -> Column:
    """Circular cross-correlation of two tiles: value (dy, dx) is the sum of a(y, x) b(y + dy, x + dx).

    phase 1 leaves the spectra's phases alone (phase correlation), 0 takes them whole, between is a
    compromise; fat_zero keeps weak frequencies from being blown up. Null where either tile is.
    """
    import numpy as np

    @F.pandas_udf("array<double>")
    def correlate(x: pd.Series, y: pd.Series) -> pd.Series:
        (p, has_p), (q, has_q) = _stack(x), _stack(y)
        known = has_p & has_q
        if not known.any():
            return _lists(p, known)
        product = np.conj(np.fft.fft2(p)) * np.fft.fft2(q)
        if phase:
            size = np.abs(product)
            product = product / (np.maximum(size, 1e-300) ** phase + fat_zero * size.mean(axis=(1, 2), keepdims=True))
        return _lists(np.fft.ifft2(product).real, known)

    return correlate(a, b)


def convolved(tile: Column, kernel: Column) -> Column:
    """Circular convolution of a tile with a kernel of the same size, centred at the first element."""
    import numpy as np

    @F.pandas_udf("array<double>")
    def convolve(x: pd.Series, y: pd.Series) -> pd.Series:
        (p, has_p), (q, has_q) = _stack(x), _stack(y)
        known = has_p & has_q
        return _lists(np.fft.ifft2(np.fft.fft2(p) * np.fft.fft2(q)).real if known.any() else p, known)

    return convolve(tile, kernel)


def shifted(tile: Column, dx: Column, dy: Column) -> Column:
    """A tile moved right and down by a fraction of a pixel or more, around its edges, by phase rotation."""
    import numpy as np

    @F.pandas_udf("array<double>")
    def shift(x: pd.Series, right: pd.Series, down: pd.Series) -> pd.Series:
        p, known = _stack(x)
        f = np.fft.fftfreq(p.shape[1])
        turn = np.exp(-2j * np.pi * (f[None, None, :] * right.to_numpy(float)[:, None, None] + f[None, :, None] * down.to_numpy(float)[:, None, None]))
        return _lists(np.fft.ifft2(np.fft.fft2(p) * turn).real if known.any() else p, known)

    return shift(tile, dx, dy)


def low_passed(tile: Column, sigma: float) -> Column:
    """A tile without its high frequencies: they are weighed down by a Gaussian of `sigma` cycles a pixel."""
    import numpy as np

    @F.pandas_udf("array<double>")
    def low_pass(x: pd.Series) -> pd.Series:
        p, known = _stack(x)
        f = np.fft.fftfreq(p.shape[1])
        weight = np.exp(-0.5 * (f[None, :] ** 2 + f[:, None] ** 2) / sigma**2)
        return _lists(np.fft.ifft2(np.fft.fft2(p) * weight).real if known.any() else p, known)

    return low_pass(tile)
