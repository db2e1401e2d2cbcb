"""Transforms of fixed-length tiles (8 x 8 values in an array, row by row), as column functions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SIZE = 8


def dct_basis(kind: int) -> list[list[float]]:
    """Orthonormal cosine basis of kind 2 or 4: row k holds the k-th function."""
    out = []
    for k in range(SIZE):
        scale = math.sqrt(2 / SIZE) * (math.sqrt(0.5) if kind == 2 and k == 0 else 1)
        out.append([scale * math.cos(math.pi * (2 * i + 1) * (k if kind == 2 else k + 0.5) / (2 * SIZE)) for i in range(SIZE)])
    return out


def dst_basis() -> list[list[float]]:
    """Orthonormal sine basis of kind 4."""
    return [[math.sqrt(2 / SIZE) * math.sin(math.pi * (2 * i + 1) * (k + 0.5) / (2 * SIZE)) for i in range(SIZE)] for k in range(SIZE)]


def applied(tile: Column, rows: list[list[float]], cols: list[list[float]]) -> Column:
    """rows x tile x transposed(cols): a separable transform of the tile, as an array of 64. Two matrix
    products for each Arrow batch of tiles; a tile that is null, or hasn't 64 values, gives null."""
    left, right = np.array(rows), np.array(cols).T

    @F.arrow_udf("array<double>")
    def product(tiles: pa.Array) -> pa.Array:
        whole = np.flatnonzero(tiles.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == SIZE * SIZE)
        values = tiles.take(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE, SIZE)
        done = (left @ values @ right).ravel()
        there = np.zeros(len(tiles), bool)
        there[whole] = True
        ends = np.concatenate(([0], np.cumsum(there * SIZE * SIZE))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(done), mask=pa.array(~there))

    return product(tile.cast("array<double>"))


def position_of_max(tile: Column, least: float) -> Column:
    """struct<x, y, value> of the first maximum, or null below the least value."""
    top = F.array_max(tile)
    at = (F.array_position(tile, top) - 1).cast("int")
    return F.when(top >= least, F.struct((at % SIZE).alias("x"), F.floor(at / SIZE).cast("int").alias("y"), top.alias("value")))


def centroid(tile: Column) -> Column:
    """struct<x, y, sum> of the positive part's centre of mass; null where nothing is positive."""
    each = F.transform(tile, lambda v, i: F.struct(F.greatest(v, F.lit(0.0)).alias("w"), (i % SIZE).alias("x"), F.floor(i / SIZE).alias("y")))
    total = lambda f: F.aggregate(each, F.lit(0.0), lambda s, e: s + f(e))
    w = total(lambda e: e["w"])
    return F.when(w > 0, F.struct((total(lambda e: e["w"] * e["x"]) / w).alias("x"), (total(lambda e: e["w"] * e["y"]) / w).alias("y"), w.alias("sum")))


def transposed(tile: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(SIZE * SIZE - 1)), lambda i: F.element_at(tile, ((i % SIZE) * SIZE + F.floor(i / SIZE) + 1).cast("int")))


def centre(tile: Column, since: int, to: int) -> Column:
    """The square of rows and columns since..to (inclusive)."""
    return F.flatten(F.transform(F.sequence(F.lit(since), F.lit(to)), lambda i: F.slice(tile, i * SIZE + since + 1, to - since + 1)))


def unpacked_mosaic(block: Column) -> Column:
    """A macroblock of 16 x 16 values stored as four 8 x 8 blocks (bit 0 of the block's number is the
    column parity, bit 1 the row parity), back in mosaic order."""
    def at(i: Column) -> Column:
        x, y = i % 16, F.floor(i / 16)
        number = (y % 2) * 2 + x % 2
        return F.element_at(block, (number * 64 + F.floor(y / 2) * 8 + F.floor(x / 2) + 1).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(255)), at)
