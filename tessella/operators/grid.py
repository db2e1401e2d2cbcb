"""Operators over the tile grid: neighbours, morphology, clusters.

A selection is a set of (x, y) rows. Neighbour joins explode a tile's offsets and equi-join on the
coordinates, so they hash-partition like any join, whatever the grid's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import checkpointed, written

RING4 = ((0, -1), (1, 0), (0, 1), (-1, 0))
RING8 = ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))


def offsets(steps) -> F.Column:
    """Array of struct<dx, dy>; small, a literal in the plan."""
    return F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps))


def pairs(tiles: DataFrame, values: list[str], steps=RING8) -> DataFrame:
    """A row for each tile (x, y) and neighbour that exists; the neighbour's values as n_<value>, and
    dx, dy."""
    spread = tiles.select("x", "y", F.explode(offsets(steps)).alias("o")).select("x", "y", "o.dx", "o.dy", (F.col("x") + F.col("o.dx")).alias("nx"), (F.col("y") + F.col("o.dy")).alias("ny"))
    others = tiles.select(F.col("x").alias("nx"), F.col("y").alias("ny"), *(F.col(v).alias(f"n_{v}") for v in values))
    return spread.join(others, ["nx", "ny"]).drop("nx", "ny")


def window_pairs(tiles: DataFrame, values: list[str], radius: int) -> DataFrame:
    """As pairs, for all tiles at most `radius` columns and rows away, the tile itself left out."""
    steps = [(dx, dy) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if (dx, dy) != (0, 0)]
    return pairs(tiles, values, steps)


def grow(selection: DataFrame, steps: int, allowed: DataFrame) -> DataFrame:
    """Dilation within the allowed tiles: each odd step along rows, each even one along columns, so two
    steps reach all eight neighbours; a last odd step does both."""
    grown = selection.select("x", "y").distinct()
    for k in range(steps):
        ways = RING4 if k == steps - 1 and k % 2 == 0 else [(-1, 0), (1, 0)] if k % 2 == 0 else [(0, -1), (0, 1)]
        reached = grown.select(F.explode(offsets([(0, 0), *ways])).alias("o"), "x", "y").select((F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))
        grown = reached.distinct().join(allowed.select("x", "y"), ["x", "y"], "left_semi")
    return grown


def shrink(selection: DataFrame, steps: int, grid: DataFrame) -> DataFrame:
    """Erosion: what the grown complement leaves. The grid's outside doesn't erode."""
    rest = grid.select("x", "y").join(selection.select("x", "y"), ["x", "y"], "left_anti")
    return selection.select("x", "y").join(grow(rest, steps, grid), ["x", "y"], "left_anti")


def prune_few_neighbours(selection: DataFrame, least: int, rounds: int | None = None) -> DataFrame:
    """Drop tiles of under `least` selected neighbours again and again (to the fixpoint, or for so many
    rounds): the least-core of the 8-neighbour graph."""
    left = selection.select("x", "y").distinct()
    n = None
    done = 0
    while rounds is None or done < rounds:
        counts = pairs(left, []).groupBy("x", "y").agg(F.count("*").alias("n"))
        left = counts.where(F.col("n") >= least).select("x", "y")
        if rounds is None:
            left = checkpointed(left)
            now = left.count()
            if now == n:
                break
            n = now
        done += 1
    return left


def _shuffled(df: DataFrame) -> DataFrame:
    """df for a join that never broadcasts it: written tables are small on disk and, round for round, pass the driver otherwise."""
    return df.hint("merge")


def clusters(selection: DataFrame, steps=RING4) -> DataFrame:
    """(x, y, cluster) with cluster the smallest (y, x) code of the connected tiles. Where neighbours of a
    row are steps, its runs are contracted to their first tiles at once, so that only links between rows
    are left. Labels then spread over links and jump twice to their own label's label, so rounds grow with
    the logarithm of the diameter."""
    code = F.col("y") * F.lit(1 << 32) + F.col("x")
    row = Window.partitionBy("y").orderBy("x")
    nodes = selection.select("x", "y").distinct()
    if (1, 0) in steps:
        begins = F.when(F.lag("x").over(row).eqNullSafe(F.col("x") - 1), F.lit(None)).otherwise(code)
        nodes = nodes.withColumn("begins", begins).withColumn("r", F.last("begins", True).over(row)).drop("begins")
        steps = [s for s in steps if s[1]]
    else:
        nodes = nodes.withColumn("r", code)
    nodes = written(nodes)
    edges = pairs(_shuffled(nodes), ["r"], steps).join(_shuffled(nodes), ["x", "y"]).select(F.col("r").alias("a"), F.col("n_r").alias("b")).where("a <> b")
    edges = written(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = edges.groupBy("a").agg(F.least("a", F.min("b")).alias("l"))
    before = None
    while True:
        for _ in range(2):
            hop = label.select(F.col("a").alias("l"), F.col("l").alias("j"))
            label = label.join(_shuffled(hop), "l").select("a", F.col("j").alias("l"))
        label = written(label)
        now = label.agg(F.sum(F.col("l").cast("decimal(38,0)"))).first()[0]
        if now == before:
            break
        before = now
        near = edges.join(_shuffled(label.select(F.col("a").alias("b"), F.col("l").alias("m"))), "b").groupBy("a").agg(F.min("m").alias("m"))
        label = label.join(_shuffled(near), "a").select("a", F.least("l", "m").alias("l"))
    label = nodes.join(_shuffled(label.withColumnRenamed("a", "r")), "r", "left").select(code.alias("a"), F.coalesce("l", "r").alias("l"))
    above = F.col("a") + F.lit(1 << 31)  # x may be negative, from -2^31 on
    return label.select((above.bitwiseAND(F.lit((1 << 32) - 1)) - F.lit(1 << 31)).alias("x"), F.shiftright(above, 32).alias("y"), F.col("l").alias("cluster"))


def closed(selection: DataFrame, steps: int, grid: DataFrame, poison: DataFrame | None = None) -> DataFrame:
    """Morphological closing: gaps that growing by `steps` bridges. Gaps that hold a poisoned tile stay
    open, and so does what lies within `steps` of it in the gap."""
    filled = shrink(grow(selection, steps, grid), steps, grid).union(selection.select("x", "y")).distinct()
    if poison is None:
        return filled
    gaps = filled.join(selection.select("x", "y"), ["x", "y"], "left_anti")
    spoilt = grow(poison.select("x", "y").join(gaps, ["x", "y"], "left_semi"), steps, gaps)
    return filled.join(spoilt, ["x", "y"], "left_anti")


def without_small_clusters(tiles: DataFrame, least: int, least_sum: float = 0.0, least_max: float = 0.0, steps=RING4) -> DataFrame:
    """Tiles (x, y, weight) of clusters of enough tiles, weight in all and largest weight."""
    labelled = written(tiles.join(_shuffled(clusters(tiles, steps)), ["x", "y"]))
    good = labelled.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("weight").alias("s"), F.max("weight").alias("m"))
    good = good.where((F.col("n") >= least) & (F.col("s") >= least_sum) & (F.col("m") >= least_max))
    return labelled.join(_shuffled(good.select("cluster")), "cluster", "left_semi").select("x", "y", "weight")


def spread(seeds: DataFrame, tiles: DataFrame, absolute: float, relative: float, steps=RING8) -> DataFrame:
    """Hysteresis: (x, y) of the seeds and of all tiles (x, y, value) reached from them over neighbours
    whose values differ by at most absolute + relative times the reached value. Seeds are among the
    tiles. Rounds go to the fixpoint, each from what the last one reached."""
    edges = pairs(tiles, ["value"], steps).join(tiles.select("x", "y", "value"), ["x", "y"])
    edges = edges.where(F.abs(F.col("value") - F.col("n_value")) <= absolute + relative * F.col("value"))
    edges = checkpointed(edges.select("x", "y", (F.col("x") + F.col("dx")).alias("tx"), (F.col("y") + F.col("dy")).alias("ty")))
    reached = checkpointed(seeds.select("x", "y").distinct())
    front = reached
    while not front.isEmpty():
        step = front.join(edges, ["x", "y"]).select(F.col("tx").alias("x"), F.col("ty").alias("y")).distinct()
        front = checkpointed(step.join(reached, ["x", "y"], "left_anti"))
        reached = checkpointed(reached.union(front))
    return reached


def background(tiles: DataFrame, near: float, sure: float, maybe: float, most: float, least_seed: int = 1, least_block: int = 1) -> DataFrame:
    """(x, y) of background tiles, of tiles (x, y, disparity, strength, differences).

    Seeds have an absolute disparity below near and a strength of at least sure. Tiles of a positive disparity from near on and a
    strength above maybe are foreground. A tile whose second largest of its channels' differences exceeds `most`
    blocks: one channel may be wrong alone, two aren't. Clusters (eight ways) of fewer than least_seed seeds or of fewer than
    least_block foreground tiles don't count. Seeds spread up, down and sideways through what neither is foreground nor blocks, as
    far as it reaches: all of a cluster that holds a seed, so rounds don't follow its length. Tiles of null disparity or
    strength are neither seeds nor foreground; fewer than two differences don't block.
    """
    close, positive = F.abs("disparity") < near, F.col("disparity") > 0
    flags = {
        "seed": close & (F.col("strength") >= sure),
        "front": ~close & positive & (F.col("strength") > maybe),
        "block": F.get(F.sort_array("differences", asc=False), F.lit(1)) > most,
    }
    marked = written(tiles.select("x", "y", *(F.coalesce(v, F.lit(False)).alias(k) for k, v in flags.items())))

    def large(flag: str, least: int) -> DataFrame:
        found = marked.where(flag).select("x", "y", F.lit(0.0).alias("weight"))
        return (without_small_clusters(found, least, steps=RING8) if least > 1 else found).select("x", "y", F.lit(True).alias(f"large_{flag}"))

    kept = marked.join(_shuffled(written(large("seed", least_seed))), ["x", "y"], "left").join(_shuffled(written(large("front", least_block))), ["x", "y"], "left")
    kept = kept.select("x", "y", "block", *(F.coalesce(f"large_{k}", F.lit(False)).alias(k) for k in ("seed", "front")))
    room = written(kept.where("seed or not (front or block)").select("x", "y", "seed"))
    labelled = written(room.join(_shuffled(clusters(room.select("x", "y"), RING4)), ["x", "y"]))
    sown = labelled.where("seed").select("cluster").distinct()
    return labelled.join(_shuffled(sown), "cluster", "left_semi").select("x", "y")
