"""Clusters of pole seeds: first fit in raster order, greedy merging, layers, and splits at gaps of a profile.

The first three mind order, so they walk; what is walked together is cut down first. A mean lies between its members and
a merged box within the hull of its parts, so rows on both sides of a gap wider than the limit never meet: `shards`
numbers the parts between such gaps, axis by axis, and each is walked by itself with the result of one walk over all.
A dense scene is one shard: Spark sorts it, and the walk streams through it, looking up only what lies in neighbouring
cells, so its time goes with the rows. First fit forgets rows of cells that no later seed reaches, merging what later
disparities leave behind; layers keep every box.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import product
from math import floor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

#: Added to gaps, since sums of doubles may pass their hull by a rounding.
SLACK = 1e-6
#: Limits hold up to this, so that means that lie on one don't fall by the order of sums.
ROUNDING = 1e-9
CLUSTER = "scene long, cluster long, disparity double, x double, y double, strength double, n_tiles long, left long, right long, top long, bottom long"


def shards(df: DataFrame, axes: list[tuple[str, str, float | None]]) -> tuple[DataFrame, list[str]]:
    """df with shard numbers, and the columns to group by. axes: (low, high, gap) columns and the limit, None for no limit
    on this axis. Windows go over occupied bins of the gap's width, not over rows."""
    keys = ["scene"]
    for k, (low, high, gap) in enumerate(axes):
        if gap is None:
            continue
        df = df.withColumn("_bin", F.floor(F.col(low) / max(gap, 1.0)))
        bins = df.groupBy(*keys, "_bin").agg(F.min(low).alias("_low"), F.max(high).alias("_high"))
        w = Window.partitionBy(*keys).orderBy("_bin")
        reach = F.max("_high").over(w.rowsBetween(Window.unboundedPreceding, -1))
        bins = bins.withColumn("_new", F.when(F.col("_low") - reach > gap + SLACK, 1).otherwise(0))
        bins = bins.select(*keys, "_bin", F.sum("_new").over(w).alias(f"_shard{k}"))
        df = df.join(bins, [*keys, "_bin"]).drop("_bin")
        keys.append(f"_shard{k}")
    return df, keys


def _walked(df: DataFrame, axes: list, columns: list[str], order: list, walk: Callable[[], tuple[Callable, Callable]], schema: str, ahead: Column | None = None) -> DataFrame:
    """Shards of df, each in order, through a walk: walk() starts one and gives a function of a row (scene, columns...) and one
    for the end; both yield rows of the schema. ahead, the least value that is still to come, is given as a last column."""
    df, keys = shards(df, axes)
    # a number of partitions keeps small shards from being put together in a few tasks
    df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    if ahead is not None:
        df, columns = df.withColumn("_ahead", F.min(ahead).over(Window.partitionBy(*keys).orderBy(F.col(order[0]).desc()))), [*columns, "_ahead"]
    dealt = df.sortWithinPartitions(*keys, *order).select(*keys, *columns)
    names, kinds = [c.split()[0] for c in schema.split(", ")], [pa.int64() if c.endswith("long") else pa.float64() for c in schema.split(", ")]

    def walked(batches):
        now, step, end = None, None, None
        for batch in batches:
            out = []
            for key, row in zip(zip(*(batch[k].to_pylist() for k in keys)), zip(*(batch[c].to_pylist() for c in columns))):
                if key != now:
                    out.extend(end() if end else ())
                    now, (step, end) = key, walk()
                out.extend(step(now[0], *row))
            yield _batch(out, names, kinds)
        yield _batch(list(end()) if end else [], names, kinds)

    return dealt.mapInArrow(walked, schema)


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    values = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)


def first_fit(seeds: DataFrame, max_dx: float | None, max_dy: float | None, max_dd: float | None) -> DataFrame:
    """(scene, tile, cluster) of seeds (scene, tile, x, y, disparity, strength): in order of tile, each joins the earliest
    cluster whose weighted mean lies within the limits (None: no limit), or starts one, named by its first tile.
    Seeds with null or NaN, or without positive strength, belong nowhere; of a repeated tile the strongest row,
    then the one of least disparity, counts."""
    inf = float("inf")
    near_x, near_y, near_d = (inf if m is None else m + ROUNDING for m in (max_dx, max_dy, max_dd))
    # cells are wider than the limit, so what fits lies in a cell or next to it
    wide_x, wide_y, wide_d = (inf if m is None else max(m + 2 * ROUNDING, 1e-3) for m in (max_dx, max_dy, max_dd))
    around = list(product(*((0,) if m is None else (-1, 0, 1) for m in (max_dx, max_dd))))
    rows_around = (0,) if max_dy is None else (-1, 0, 1)

    def cell(v: float, wide: float) -> int:
        return 0 if wide == inf else floor(v / wide)

    def walk():
        lines: dict[int, dict] = defaultdict(lambda: defaultdict(list))
        count = 0

        def step(scene, tile, x, y, d, w, ahead) -> Iterator[tuple]:
            nonlocal count
            line, cx, cd = cell(y, wide_y), cell(x, wide_x), cell(d, wide_d)
            best = None
            for k in rows_around:
                cells = lines.get(line + k)
                if cells is None:
                    continue
                for dx, dd in around:
                    for c in cells.get((cx + dx, cd + dd), ()):
                        if abs(c[2] - x) <= near_x and abs(c[3] - y) <= near_y and abs(c[4] - d) <= near_d and (best is None or c[0] < best[0]):
                            best = c
            if best is None:
                best = [count, tile, x, y, d, w]
                count += 1
                lines[line][cx, cd].append(best)
            else:
                old = cell(best[3], wide_y), (cell(best[2], wide_x), cell(best[4], wide_d))
                best[5] += w
                share = w / best[5]
                best[2] += (x - best[2]) * share
                best[3] += (y - best[3]) * share
                best[4] += (d - best[4]) * share
                new = cell(best[3], wide_y), (cell(best[2], wide_x), cell(best[4], wide_d))
                if new != old:
                    lines[old[0]][old[1]].remove(best)
                    lines[new[0]][new[1]].append(best)
            if wide_y != inf and len(lines) > 8:
                least = cell(ahead, wide_y) - 1
                for k in [k for k in lines if k < least]:
                    del lines[k]
            yield scene, tile, best[1]

        return step, lambda: ()

    good = seeds.select("scene", "tile", "x", "y", "disparity", "strength").dropna().where("strength > 0 and not isnan(strength) and not isnan(disparity)")
    best = F.max_by(F.struct("x", "y", "disparity", "strength"), F.struct("strength", -F.col("disparity"))).alias("s")
    good = written(good.groupBy("scene", "tile").agg(best).select("scene", "tile", "s.*"))
    axes = [("x", "x", max_dx), ("y", "y", max_dy), ("disparity", "disparity", max_dd)]
    return _walked(good, axes, ["tile", "x", "y", "disparity", "strength"], ["tile"], walk, "scene long, tile long, cluster long", F.col("y"))


def boxes(seeds: DataFrame, members: DataFrame, side: int = 0, up: int = 0, down: int = 0) -> DataFrame:
    """Clusters with weighted means, number of tiles and the box around them, extended (ends inclusive)."""
    w = F.col("strength")
    mean = lambda c: (F.sum(F.col(c) * w) / F.sum(w)).alias(c)
    return seeds.join(members, ["scene", "tile"]).groupBy("scene", "cluster").agg(
        mean("disparity"), mean("x"), mean("y"), F.sum(w).alias("strength"), F.count("*").alias("n_tiles"),
        (F.min("x") - side).alias("left"), (F.max("x") + side).alias("right"), (F.min("y") - up).alias("top"), (F.max("y") + down).alias("bottom"),
    )


#: Columns and rows of a cell of boxes.
CELL = 8, 16
BOX = ["left", "right", "top", "bottom"]


class _Boxes:
    """Numbered boxes by the cells that they cover."""

    def __init__(self):
        self.cells: dict[tuple[int, int], list[int]] = defaultdict(list)

    @staticmethod
    def _range(box) -> tuple[int, int, int, int]:
        return floor(box[0] / CELL[0]), floor(box[1] / CELL[0]), floor(box[2] / CELL[1]), floor(box[3] / CELL[1])

    def add(self, number: int, box, before=None) -> None:
        """Number a box; of one that grew, give the box before."""
        l, r, t, b = self._range(box)
        old = self._range(before) if before else None
        for y in range(t, b + 1):
            inner = old and old[2] <= y <= old[3]
            for x in (*range(l, old[0]), *range(old[1] + 1, r + 1)) if inner else range(l, r + 1):
                self.cells[x, y].append(number)

    def near(self, box) -> Iterator[int]:
        """Numbers, some more than once, of boxes that share a cell."""
        l, r, t, b = self._range(box)
        for y in range(t, b + 1):
            for x in range(l, r + 1):
                yield from self.cells.get((x, y), ())


def _crossing(a, b) -> bool:
    return a[0] <= b[1] and b[0] <= a[1] and a[2] <= b[3] and b[2] <= a[3]


def merged(clusters: DataFrame, tolerance: float) -> DataFrame:
    """Clusters after merging, with n_merged: in order of disparity, then name, each goes into the earliest one before it
    whose box crosses its own and whose disparity differs by less than `tolerance`; means and boxes follow at once."""

    def walk():
        kept: dict[int, list] = {}
        index, count, since = _Boxes(), 0, 0

        def step(scene, cluster, d, x, y, w, tiles, left, right, top, bottom) -> Iterator[tuple]:
            nonlocal index, count, since
            box, into = (left, right, top, bottom), None
            for k in index.near(box):
                c = kept[k]
                if (into is None or k < into) and abs(c[2] - d) < tolerance - ROUNDING and _crossing(c[7:11], box):
                    into = k
            since += 1
            if into is None:
                kept[count] = [scene, cluster, d, x, y, w, tiles, *box, 1]
                index.add(count, box)
                count += 1
            else:
                c = kept[into]
                whole = c[5] + w
                for k, v in ((2, d), (3, x), (4, y)):
                    c[k] = (c[k] * c[5] + v * w) / whole
                c[5], c[6], c[11], old = whole, c[6] + tiles, c[11] + 1, c[7:11]
                c[7:11] = min(old[0], left), max(old[1], right), min(old[2], top), max(old[3], bottom)
                if c[7:11] != old:
                    index.add(into, c[7:11], old)
            if since > max(4096, len(kept)):  # those left behind by disparity take no more; rows come within 1e-9 of its order
                since, over = 0, [k for k, c in kept.items() if c[2] < d - tolerance - SLACK]
                for k in over:
                    yield tuple(kept.pop(k))
                if over:
                    index = _Boxes()
                    for k, c in kept.items():
                        index.add(k, c[7:11])

        return step, lambda: [tuple(c) for c in kept.values()]

    clusters = written(clusters.withColumn("_near", F.round("disparity", 9)))
    columns = ["cluster", "disparity", "x", "y", "strength", "n_tiles", *BOX]
    axes = [("left", "right", 0.0), ("top", "bottom", 0.0), ("disparity", "disparity", tolerance)]
    return _walked(clusters, axes, columns, ["_near", "cluster"], walk, CLUSTER + ", n_merged long")


def layered(clusters: DataFrame) -> DataFrame:
    """(scene, cluster, layer): in order of disparity, then name, each takes the lowest layer none of whose boxes crosses its own."""

    def walk():
        boxes, layers, index = [], [], _Boxes()

        def step(scene, cluster, *box) -> Iterator[tuple]:
            taken = {layers[k] for k in index.near(box) if _crossing(boxes[k], box)}
            layer = 0
            while layer in taken:
                layer += 1
            index.add(len(boxes), box)
            boxes.append(box)
            layers.append(layer)
            yield scene, cluster, layer

        return step, lambda: ()

    clusters = written(clusters.withColumn("_near", F.round("disparity", 9)))
    return _walked(clusters, [("left", "right", 0.0), ("top", "bottom", 0.0)], ["cluster", *BOX], ["_near", "cluster"], walk, "scene long, cluster long, layer long")


def cuts(clusters: DataFrame, measured: DataFrame, apart: int, through_zero: bool) -> DataFrame:
    """(scene, cluster, cut): where to split clusters whose profile across has two maxima; columns from `cut` on (counted
    from the box's left) go to the second half. Clusters without such a place have no row.

    measured: (scene, x, y, strength). The profile sums the strengths in the box by column. A gap is a run of columns
    between maxima that are none themselves; of those at least `apart` long, and with an empty column if through_zero, the
    first one counts, cut in the middle of its lowest run. Boxes meet measurements by column and stretch of 8 rows."""
    columns = clusters.select("scene", "cluster", "left", "top", "bottom", F.explode(F.sequence("left", "right")).alias("x"))
    stretch = lambda y: F.floor(F.col(y) / 8)
    reached = columns.where("top <= bottom").withColumn("part", F.explode(F.sequence(stretch("top"), stretch("bottom"))))
    inside = measured.withColumn("part", stretch("y")).join(reached, ["scene", "x", "part"]).where("y between top and bottom").groupBy("scene", "cluster", "x").agg(F.sum("strength").alias("h"))
    profile = columns.join(inside, ["scene", "cluster", "x"], "left").select("scene", "cluster", (F.col("x") - F.col("left")).alias("at"), F.coalesce("h", F.lit(0.0)).alias("h"))
    w = Window.partitionBy("scene", "cluster").orderBy("at")
    h = F.round("h", 9)
    peak = (h > 0) & (h >= F.coalesce(F.lag(h).over(w), h)) & (h >= F.coalesce(F.lead(h).over(w), h))
    profile = profile.select("scene", "cluster", "at", h.alias("h"), F.when(peak, F.col("at")).alias("peak"))
    profile = profile.withColumn("before", F.last("peak", True).over(w)).withColumn("after", F.first("peak", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    gaps = profile.where("peak is null and before is not null and after is not null")
    lowest = gaps.withColumn("low", F.min("h").over(Window.partitionBy("scene", "cluster", "before")))
    lowest = lowest.withColumn("start", F.min(F.when(F.col("h") == F.col("low"), F.col("at"))).over(Window.partitionBy("scene", "cluster", "before")))
    gap = lowest.groupBy("scene", "cluster", "before").agg(
        F.count("*").alias("n"), F.min("low").alias("low"), F.min("start").alias("start"), F.max("after").alias("after"),
        F.min(F.expr("case when at > start and h > low then at end")).alias("rise"),
    )
    good = gap.where((F.col("n") >= apart) & ((F.col("low") == 0) | F.lit(not through_zero)))
    cut = F.expr("(start + coalesce(rise, after) + 1) div 2")
    return good.groupBy("scene", "cluster").agg(F.min_by(cut, "before").alias("cut"))


def split(seeds: DataFrame, members: DataFrame, clusters: DataFrame, cut: DataFrame) -> DataFrame:
    """members after one split: tiles of the second half are named by their first tile, as are those of the first."""
    where = clusters.select("scene", "cluster", "left").join(cut, ["scene", "cluster"])
    tiles = members.join(seeds.select("scene", "tile", "x"), ["scene", "tile"]).join(where, ["scene", "cluster"], "left")
    second = F.coalesce(F.col("x") - F.col("left") >= F.col("cut"), F.lit(False))
    return tiles.select("scene", "tile", F.min("tile").over(Window.partitionBy("scene", "cluster", second)).alias("cluster"))
