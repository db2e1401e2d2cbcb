"""Lapped transforms of images in overlapping tiles, their inverse, and correlation in the transformed domain.

A tile is 16 x 16 pixels every 8 pixels, windowed and transformed into four quadrants of 8 x 8: cosine or sine (kind 4) down
the columns, cosine or sine along the rows. A transformed tile is an array of 256: quadrants CC, CS, SC, SS (the
first letter is down), each row by row. The four together act like one number with two commuting imaginary units, so
shifts turn it and products correlate it.

Pixels go to blocks of 64 x 64 with a margin of 8 that the next block has too: each is shipped 1.3 times, and a batch of
blocks is transformed by a few matrix products. Pixels (key..., x, y) are distinct; missing and null ones count as 0.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import sliced, small_batches

SIZE, BLOCK = 8, 8
#: Blocks that are transformed at once, some 1 MB each on the way.
AT_ONCE = 64
#: Pixels of a block's side, and with its margin.
SPAN, SIDE = SIZE * BLOCK, SIZE * (BLOCK + 1)


def window(kind: str = "sine") -> np.ndarray:
    """16 weights whose squares add up to 1 where tiles overlap: flat, sine or steeper."""
    turn = np.sin(np.pi / (2 * SIZE) * (np.arange(2 * SIZE) + 0.5))
    return {"flat": np.full(2 * SIZE, 0.5**0.5), "sine": turn, "steep": np.sin(np.pi / 2 * turn**2)}[kind]


@cache
def analysis(kind: str = "sine") -> np.ndarray:
    """(2, 8, 16): windowed cosine and sine bases of a line of 16 pixels."""
    angle = np.pi / SIZE * (np.arange(2 * SIZE) + 0.5 + SIZE / 2)[None, :] * (np.arange(SIZE) + 0.5)[:, None]
    return np.sqrt(2 / SIZE) * np.stack([np.cos(angle), np.sin(angle)]) * window(kind)


def _values(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, width) of the lists that have so many values, and which ones do."""
    whole = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == width
    found = lists.take(pa.array(np.flatnonzero(whole))).flatten().to_numpy(zero_copy_only=False)
    return found.reshape(-1, width), whole


def _lists(values: np.ndarray, there: np.ndarray) -> pa.Array:
    """Rows of values as lists, null where nothing is there."""
    width = values.shape[1] if values.ndim > 1 else 0
    ends = np.concatenate(([0], np.cumsum(there * width))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()), mask=pa.array(~there))


def _blocked(at: Column, last: int) -> Column:
    """Blocks whose pixels or margin hold a place, among blocks 0..last."""
    block = F.floor(at / SPAN)
    mine = F.when((at % SPAN < SIZE) & (block > 0), F.array(block - 1, block)).otherwise(F.array(block))
    return F.filter(mine, lambda b: b <= last)


def transformed(pixels: DataFrame, key: str, width: int, height: int, kind: str = "sine") -> DataFrame:
    """(key, ty, tx, clt): every whole tile of images of a size, none of images that hold no tile of 16 x 16; pixels
    are (key, x, y, v)."""
    across, down = max(width // SIZE - 1, 0), max(height // SIZE - 1, 0)
    base = analysis(kind)
    inside = pixels.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    placed = inside.withColumn("bx", F.explode(_blocked(F.col("x"), -(-across // BLOCK) - 1))).withColumn("by", F.explode(_blocked(F.col("y"), -(-down // BLOCK) - 1)))
    place = ((F.col("y") - F.col("by") * SPAN) * SIDE + F.col("x") - F.col("bx") * SPAN).cast("int")
    value = F.coalesce(F.col("v").cast("double"), F.lit(0.0))
    blocks = placed.groupBy(key, "by", "bx").agg(F.collect_list(F.struct(place.alias("at"), value.alias("v"))).alias("pixels"))

    small_batches(pixels.sparkSession)

    def transform(batches):
        for batch in sliced(batches, AT_ONCE):
            n = batch.num_rows
            pixels = batch["pixels"]
            row = np.repeat(np.arange(n), pixels.value_lengths().to_numpy(zero_copy_only=False))
            flat = pixels.flatten()
            image = np.zeros((n, SIDE * SIDE))
            image[row, flat.field("at").to_numpy()] = flat.field("v").to_numpy()
            tiles = np.lib.stride_tricks.sliding_window_view(image.reshape(n, SIDE, SIDE), (2 * SIZE, 2 * SIZE), axis=(1, 2))[:, ::SIZE, ::SIZE]
            half = base[:, None, None, None] @ tiles  # (down, block, row, column, 8, 16)
            done = half[:, None] @ base.transpose(0, 2, 1)[None, :, None, None, None]  # (down, across, block, row, column, 8, 8)
            done = done.transpose(2, 3, 4, 0, 1, 5, 6).reshape(n * BLOCK * BLOCK, 4 * SIZE * SIZE)
            ty = (batch["by"].to_numpy()[:, None, None] * BLOCK + np.arange(BLOCK)[:, None] + np.zeros(BLOCK, np.int64)).ravel()
            tx = (batch["bx"].to_numpy()[:, None, None] * BLOCK + np.zeros((BLOCK, 1), np.int64) + np.arange(BLOCK)).ravel()
            keep = np.flatnonzero((ty < down) & (tx < across))
            yield pa.RecordBatch.from_arrays([batch[key].take(pa.array(keep // (BLOCK * BLOCK))), pa.array(ty[keep]), pa.array(tx[keep]), _lists(done[keep], np.ones(len(keep), bool))], [key, "ty", "tx", "clt"])

    kind_of = pixels.schema[key].dataType.simpleString()
    return blocks.select(key, F.col("by").cast("long").alias("by"), F.col("bx").cast("long").alias("bx"), "pixels").mapInArrow(transform, f"{key} {kind_of}, ty long, tx long, clt array<double>")


def restored(tiles: DataFrame, key: str, width: int, height: int, kind: str = "sine") -> DataFrame:
    """(key, x, y, v): pixels that all four of their tiles cover, by adding the tiles up where they overlap; the mean of what the four
    quadrants restore each. A tile without clt counts as one of zeros."""
    base = analysis(kind)
    across, down = width // SIZE - 1, height // SIZE - 1
    number = ((F.col("ty") % BLOCK) * BLOCK + F.col("tx") % BLOCK).cast("int")
    blocks = tiles.where("clt is not null").groupBy(key, F.floor(F.col("ty") / BLOCK).alias("by"), F.floor(F.col("tx") / BLOCK).alias("bx"))
    blocks = blocks.agg(F.collect_list(F.struct(number.alias("at"), F.col("clt").cast("array<double>").alias("clt"))).alias("tiles"))

    small_batches(tiles.sparkSession)

    def restore(batches):
        for batch in sliced(batches, AT_ONCE):
            n = batch.num_rows
            row = np.repeat(np.arange(n), batch["tiles"].value_lengths().to_numpy(zero_copy_only=False))
            flat = batch["tiles"].flatten()
            values = flat.field("clt").flatten().to_numpy().reshape(-1, 2, 2, SIZE, SIZE)
            back = np.einsum("vki,nvhkl,hlj->nij", base, values, base, optimize=True) / 4
            at = flat.field("at").to_numpy()
            image = np.zeros((n, SIDE, SIDE))
            for dy in range(2 * SIZE):  # tiles that overlap are added one line after the other
                for half in range(2):
                    y, x = (at // BLOCK) * SIZE + dy, (at % BLOCK + half) * SIZE
                    np.add.at(image, (row[:, None], y[:, None], x[:, None] + np.arange(SIZE)), back[:, dy, half * SIZE : (half + 1) * SIZE])
            y = (batch["by"].to_numpy()[:, None, None] * SPAN + np.arange(SIDE)[:, None] + np.zeros(SIDE, np.int64)).ravel()
            x = (batch["bx"].to_numpy()[:, None, None] * SPAN + np.zeros((SIDE, 1), np.int64) + np.arange(SIDE)).ravel()
            keep = np.flatnonzero((y >= SIZE) & (x >= SIZE) & (y < SIZE * down) & (x < SIZE * across))
            yield pa.RecordBatch.from_arrays([batch[key].take(pa.array(keep // (SIDE * SIDE))), pa.array(x[keep]), pa.array(y[keep]), pa.array(image.ravel()[keep])], [key, "x", "y", "v"])

    kind_of = tiles.schema[key].dataType.simpleString()
    parts = blocks.select(key, F.col("by").cast("long").alias("by"), F.col("bx").cast("long").alias("bx"), "tiles").mapInArrow(restore, f"{key} {kind_of}, x long, y long, v double")
    return parts.groupBy(key, "x", "y").agg(F.sum("v").alias("v"))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The conjugate of a times b; both (rows, 4, 64). Quadrant bits are imaginary units (bit 1 down, bit 0 across): units
    that meet cancel, and one that only a has takes its conjugate's sign."""
    out = np.zeros_like(a)
    for p in range(4):
        for q in range(4):
            out[:, p ^ q] += (-1) ** (p & ~q).bit_count() * a[:, p] * b[:, q]
    return out


def correlated(a: Column, b: Column, fat_zero: float) -> Column:
    """Phase correlation of two transformed tiles, still transformed: the product over its amplitude, to the mean of
    which over the tile fat_zero squared adds a share. Null where either tile isn't whole; zero where both are."""

    @F.arrow_udf("array<double>")
    def correlate(x: pa.Array, y: pa.Array) -> pa.Array:
        there = np.flatnonzero(_values(x, 256)[1] & _values(y, 256)[1])
        p, q = (_values(v.take(pa.array(there)), 256)[0].reshape(-1, 4, 64) for v in (x, y))
        size = np.sqrt((p**2).sum(1) * (q**2).sum(1))
        size = size + size.mean(1, keepdims=True) * fat_zero**2
        out = product(p, q) / np.where(size > 0, size, 1.0)[:, None]
        mask = np.zeros(len(x), bool)
        mask[there] = True
        return _lists(out.reshape(-1, 256), mask)

    return correlate(a.cast("array<double>"), b.cast("array<double>"))


@cache
def _shifts() -> np.ndarray:
    """(2, 15, 8): cosines and sines of shifts from -7 to 7."""
    angle = np.pi / SIZE * np.arange(1 - SIZE, SIZE)[:, None] * (np.arange(SIZE) + 0.5)[None, :]
    return np.stack([np.cos(angle), np.sin(angle)]) / SIZE


def by_shift(correlation: Column) -> Column:
    """A transformed correlation as 15 x 15 values by shift: place (sy + 7) * 15 + sx + 7 tells how well the second tile
    fits the first when its content lies sx to the right and sy below; 1 at no shift for equal tiles and no fat zero."""
    base = _shifts()

    @F.arrow_udf("array<double>")
    def unfold(c: pa.Array) -> pa.Array:
        values, there = _values(c, 256)
        out = np.einsum("vsk,nvhkl,htl->nst", base, values.reshape(-1, 2, 2, SIZE, SIZE), base, optimize=True)
        return _lists(out.reshape(-1, 225), there)

    return unfold(correlation.cast("array<double>"))


def shifted(tile: Column, dx: Column, dy: Column) -> Column:
    """A transformed tile whose content moves by parts of a pixel to the right and down: each coefficient turns by its
    frequency times the shift."""

    @F.arrow_udf("array<double>")
    def shift(t: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        values, there = _values(t, 256)
        there &= x.is_valid().to_numpy(zero_copy_only=False) & y.is_valid().to_numpy(zero_copy_only=False)
        rows = pa.array(np.flatnonzero(there))
        values = _values(t.take(rows), 256)[0].reshape(-1, 2, 2, SIZE, SIZE)
        turn = np.pi / SIZE * (np.arange(SIZE) + 0.5)
        for axis, by in ((2, x), (1, y)):  # across, then down
            angle = by.take(rows).to_numpy()[:, None] * turn
            angle = angle[:, None, None, :] if axis == 2 else angle[:, None, :, None]
            c, s = np.take(values, 0, axis), np.take(values, 1, axis)
            values = np.stack([c * np.cos(angle) - s * np.sin(angle), s * np.cos(angle) + c * np.sin(angle)], axis)
        return _lists(values.reshape(-1, 256), there)

    return shift(tile.cast("array<double>"), dx.cast("double"), dy.cast("double"))
