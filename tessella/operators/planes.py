"""Planes of neighbouring tiles: missing links found by small shapes of links, and coupled smoothing.

planes: (node, d, tx, ty, weight), disparity at the tile's middle, its rise by one tile right and down, and weight.
links: (a, b, dir) both ways, dir 0 up, then clockwise to 7; a plane has at most one link in a direction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written

#: Steps to the right and down by direction.
RIGHT, DOWN = (0, 1, 1, 1, 0, -1, -1, -1), (-1, -1, 0, 1, 1, 1, 0, -1)
_NUMBER = {(x, y): d for d, (x, y) in enumerate(zip(RIGHT, DOWN, strict=True))}


def _of(values, at: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), at.cast("int"))


def _direction(right: Column, down: Column) -> Column:
    """The direction of a step, null where it isn't to a neighbour."""
    numbers = [_NUMBER.get((x, y)) for y in (-1, 0, 1) for x in (-1, 0, 1)]
    near = (F.abs(right) <= 1) & (F.abs(down) <= 1)
    return F.when(near, _of(numbers, (down + 1) * 3 + right + 1))


def _ends(pairs: DataFrame, planes: DataFrame) -> DataFrame:
    """pairs (a, b, dir, ...) with the planes at both ends."""
    side = lambda end: planes.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("d", "tx", "ty", "weight")))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def cost(turn: float) -> Column:
    """How badly two planes continue each other: the square of the gap where both are carried on to the middle between them, and
    the square of the turn between their slopes times `turn`."""
    x, y = _of(RIGHT, F.col("dir")) / 2, _of(DOWN, F.col("dir")) / 2
    gap = F.col("d_a") + F.col("tx_a") * x + F.col("ty_a") * y - (F.col("d_b") - F.col("tx_b") * x - F.col("ty_b") * y)
    return gap * gap + turn * (F.pow(F.col("tx_a") - F.col("tx_b"), 2) + F.pow(F.col("ty_a") - F.col("ty_b"), 2))


def _accepted(wanted: DataFrame, links: DataFrame, planes: DataFrame, most: float, turn: float) -> DataFrame:
    """New links both ways: of wanted (a, b, dir), those that cost no more than `most`, to nine decimals, whose both ends have no link in that
    direction, and that are the cheapest (then of the least numbers) for both ends."""
    back = lambda df: df.select(F.col("b").alias("a"), F.col("a").alias("b"), ((F.col("dir") + 4) % 8).alias("dir"))
    wanted = wanted.select("a", "b", "dir")
    both = wanted.unionByName(back(wanted)).distinct().join(links.select("a", "dir"), ["a", "dir"], "left_anti")
    priced = _ends(both, planes).select("a", "b", "dir", F.round(cost(turn), 9).alias("cost")).where(F.col("cost") <= most)
    # ends count alike: the price of a pair is that of its lesser number's side
    best = priced.groupBy("a", "dir").agg(F.min(F.struct("cost", F.least("a", "b"), F.greatest("a", "b"), "b"))["b"].alias("b"))
    return best.select("a", "b", "dir").join(back(best), ["a", "b", "dir"])


def fill_squares(links: DataFrame, planes: DataFrame, most: float, turn: float = 1.0) -> DataFrame:
    """links and the diagonals of squares: where right then down and down then right lead to the same plane, both diagonals, if free
    and cheap enough."""
    way = lambda d, a, b: links.where(F.col("dir") == d).select(F.col("a").alias(a), F.col("b").alias(b))
    square = way(2, "p", "q").join(way(4, "p", "r"), "p").join(way(4, "q", "s"), "q").join(way(2, "r", "s"), ["r", "s"])
    wanted = square.select(F.col("p").alias("a"), F.col("s").alias("b"), F.lit(3).alias("dir")).union(square.select(F.col("q").alias("a"), F.col("r").alias("b"), F.lit(5).alias("dir")))
    return links.select("a", "b", "dir").unionByName(_accepted(wanted, links, planes, most, turn))


def cut_corners(links: DataFrame, planes: DataFrame, most: float, turn: float = 1.0, rounds: int = 100) -> DataFrame:
    """links and those that close corners: two planes next to each other that a third links to, if free and cheap enough,
    again until there are no more. A round joins the last round's links with all, as only they make new corners."""
    links = written(links.select("a", "b", F.col("dir").cast("int").alias("dir")))
    new = links
    for _ in range(rounds):
        from_p = lambda df, end: df.select(F.col("a").alias("p"), F.col("b").alias(end), F.col("dir").alias(f"to_{end}"))
        corner = from_p(new, "a").join(from_p(links, "b"), "p").where("a <> b")
        step = [_of(v, F.col("to_b")) - _of(v, F.col("to_a")) for v in (RIGHT, DOWN)]
        wanted = corner.select("a", "b", _direction(*step).alias("dir")).where("dir is not null")
        new = written(_accepted(wanted, links, planes, most, turn).select("a", "b", F.col("dir").cast("int").alias("dir")))
        if new.isEmpty():
            break
        links = written(links.unionByName(new))
    return links


def smoothed(planes: DataFrame, links: DataFrame, pull: float, steps: int, keep: float = 0.5) -> tuple[DataFrame, list[float]]:
    """(node, d, tx, ty, weight) after steps in which each plane goes a share 1 - keep of the way to the weighted mean of its measured
    self (times pull) and of its linked planes, carried on to its tile; and the root mean square change of each step."""
    measured = planes.select("node", "d", "tx", "ty", "weight")
    now, changes = measured, []
    for _ in range(steps):
        side = _ends(links.select("a", "b", "dir"), now)
        x, y = _of(RIGHT, F.col("dir")), _of(DOWN, F.col("dir"))
        carried = F.col("d_b") - F.col("tx_b") * x - F.col("ty_b") * y
        w = F.col("weight_b")
        near = side.groupBy(F.col("a").alias("node")).agg(F.sum(w).alias("w"), *(F.sum(w * v).alias(f"n_{c}") for c, v in (("d", carried), ("tx", F.col("tx_b")), ("ty", F.col("ty_b")))))
        own = F.col("m.weight") * pull
        joined = now.alias("p").join(measured.alias("m"), "node").join(near, "node", "left")
        goal = lambda c: F.coalesce((own * F.col(f"m.{c}") + F.col(f"n_{c}")) / (own + F.col("w")), F.col(f"m.{c}"))
        moved = joined.select("node", *((keep * F.col(f"p.{c}") + (1 - keep) * goal(c)).alias(c) for c in ("d", "tx", "ty")), "p.weight", F.col("p.d").alias("before"))
        moved = written(moved)
        changes.append(float(moved.agg(F.sqrt(F.avg(F.pow(F.col("d") - F.col("before"), 2)))).first()[0] or 0.0))
        now = moved.drop("before")
    return now, changes
