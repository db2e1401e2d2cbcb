"""Clusters of surfaces over tiles: nodes are (tile, layer), links join layers of neighbouring tiles.

nodes: (node, tile), node a distinct number. links: (a, b) both ways, with direction dir (0 up, then clockwise to 7)
where a function says so. All results are defined by the tables alone: ties go by numbers, never by the order of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written

#: Directions of links across and along columns.
ACROSS, ALONG = (2, 6), (0, 4)


#: Nodes whose numbers share all but so many last bits are joined in one task first; a link between them is no round's work.
BLOCK_BITS = 16
#: Most touching pairs of a cluster that is merged in one task.
LOCAL_PAIRS = 100_000


def _least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links that have a lesser one in reach, and the least one."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        now = label.copy()
        np.minimum.at(now, a, label[b])
        np.minimum.at(now, b, label[a])
        np.minimum.at(now, label, now.copy())  # what a node learns, the node that names it learns too
        now = now[now]
        if (now == label).all():
            break
        label = now
    lower = label < np.arange(len(ids))
    return ids[lower], ids[label[lower]]


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, cluster): cluster is the least node that links reach. Links within a block of numbers are contracted first, a
    block a task; what is left are the links between blocks. There a round takes the least label among neighbours and
    then that label's own label, so rounds grow with the logarithm of a cluster's width in most shapes."""
    ends = written(links.select("a", "b").where("a <> b"))
    block = lambda c: F.shiftright(F.col(c).cast("long"), BLOCK_BITS)

    def contracted(pdf: pd.DataFrame) -> pd.DataFrame:
        node, root = _least(pdf["a"].to_numpy(), pdf["b"].to_numpy())
        return pd.DataFrame({"node": node, "root": root})

    inner = ends.where(block("a") == block("b")).select(block("a").alias("block"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    roots = written(inner.groupBy("block").applyInPandas(contracted, "node long, root long"))
    root_of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    outer = ends.where(block("a") != block("b")).join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
    outer = outer.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).where("a <> b").distinct()
    named = _spread_labels(written(outer)).select(F.col("node").alias("root"), F.col("cluster").alias("least"))
    found = nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    return written(found.join(named, "root", "left").select("node", F.coalesce("least", "root").alias("cluster")))


def _spread_labels(ends: DataFrame) -> DataFrame:
    """(node, cluster) of the nodes of links (a, b), which go both ways."""
    labels = written(ends.select(F.col("a").alias("node")).union(ends.select("b")).distinct().select("node", F.col("node").alias("cluster")))
    before = None
    while True:
        near = ends.join(labels.select(F.col("node").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("node")).agg(F.min("cluster").alias("near"))
        least = labels.join(near, "node", "left").select("node", F.least("cluster", F.coalesce("near", "cluster")).alias("cluster"))
        jumped = labels.select(F.col("node").alias("cluster"), F.col("cluster").alias("further"))
        labels = written(least.join(jumped, "cluster").select("node", F.least("cluster", "further").alias("cluster")))
        now = labels.agg(F.sum(F.col("cluster").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return labels
        before = now


def grown(selection: DataFrame, links: DataFrame, units: int) -> DataFrame:
    """(node): a selection grown along links (a, b, dir). Two units go across, then along columns (so corners are reached);
    a last odd unit goes both ways at once."""
    found = selection.select("node").distinct()
    for k in range(units // 2 + units % 2):
        for ways in ((*ACROSS, *ALONG),) if 2 * k + 1 == units else (ACROSS, ALONG):
            near = links.where(F.col("dir").isin(*ways)).join(found.withColumnRenamed("node", "a"), "a", "left_semi")
            found = found.union(near.select(F.col("b").alias("node"))).distinct()
        if k % 4 == 3:
            found = written(found)
    return found


def _edge_order(a: Column, b: Column) -> Column:
    """A number of a pair that scatters, so that of equal pairs many are chosen at once."""
    return (F.least(a, b) * 7919 + F.greatest(a, b) * 104729) % 1000003


def _pair(p: str, q: str) -> list[Column]:
    return [F.least(p, q).alias("p"), F.greatest(p, q).alias("q")]


def _clashing(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of parts that share a tile (and what else keys name)."""
    layers = parts.select(*keys, "part").distinct()
    return layers.withColumnRenamed("part", "p").join(layers.withColumnRenamed("part", "q"), keys).where("p < q").select(*keys[1:], "p", "q").distinct()


def merged(parts: DataFrame, links: DataFrame, by: str = "links") -> DataFrame:
    """(node, tile, part): parts of nodes (node, tile, part) merged while they touch and share no tile.

    In a round each part chooses among those it touches without conflict the one with the most links between them (by
    "links") or with the most nodes in both ("nodes"), then by _edge_order and numbers; two that choose each other become one,
    named by the lesser. Ends when no pair is left: so no part gets a second layer of a tile that it didn't have, and
    none could be merged further. A tile has few layers, so the pairs that share one are few.
    """
    parts = written(parts.select("node", "tile", "part"))
    touching = written(_touching(parts, links.select("a", "b").where("a < b").distinct()))
    size = parts.groupBy("part").agg(F.count("*").alias("n")) if by == "nodes" else None
    return _renamed(parts, _merge_rounds(touching, written(_clashing(parts, ["tile"])), size))


def _touching(parts: DataFrame, ends: DataFrame) -> DataFrame:
    part_of = lambda end: parts.select(F.col("node").alias(end), F.col("part").alias(f"part_{end}"))
    pairs = ends.join(part_of("a"), "a").join(part_of("b"), "b").where("part_a <> part_b")
    return pairs.groupBy(*_pair("part_a", "part_b")).agg(F.count("*").alias("links"))


def _renamed(parts: DataFrame, renames: DataFrame) -> DataFrame:
    """parts under the names that chains of (q, p), q becomes p, end with; each is the least of its chain."""
    both = written(renames.select(F.col("q").alias("a"), F.col("p").alias("b")))
    both = both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    last = components(both.select(F.col("a").alias("node")).distinct(), both).select(F.col("node").alias("part"), F.col("cluster").alias("into"))
    return parts.join(last, "part", "left").select("node", "tile", F.coalesce("into", "part").alias("part"))


def _merge_rounds(touching: DataFrame, clash: DataFrame, size: DataFrame | None) -> DataFrame:
    """(p, q) of all rounds, q became p. Rounds go over pairs of parts, not over nodes: when parts become one, links between pairs
    add up and a clash of either stays. A part that touches none without a clash never will, and leaves. Pairs get fewer from round to
    round, for many rounds: once LOCAL_PAIRS are left in all, links (without size) go on in one task."""
    renames = None
    while True:
        free = written(touching.join(clash, ["p", "q"], "left_anti"))
        if size is None and free.count() + clash.count() <= LOCAL_PAIRS:
            last = _merged_in_tasks(free.withColumn("block", F.lit(0)), clash.withColumn("block", F.lit(0)))
            return last if renames is None else renames.union(last)
        ranked = free
        if size is not None:
            of = lambda end: size.select(F.col("part").alias(end), F.col("n").alias(f"n{end}"))
            ranked = free.join(of("p"), "p").join(of("q"), "q").select("p", "q", (F.col("np") + F.col("nq")).alias("links"))
        both = ranked.union(ranked.select(F.col("q").alias("p"), F.col("p").alias("q"), "links"))
        choice = both.groupBy("p").agg(F.max(F.struct("links", -_edge_order(F.col("p"), F.col("q")), -F.least("p", "q"), -F.greatest("p", "q"), "q"))["q"].alias("q"))
        choice = written(choice)
        agreed = choice.join(choice.select(F.col("q").alias("p"), F.col("p").alias("q")), ["p", "q"]).where("p < q")
        agreed = written(agreed)
        renames = agreed if renames is None else renames.union(agreed)
        if agreed.isEmpty():
            return renames
        into = lambda end: agreed.select(F.col("q").alias(end), F.col("p").alias(f"into_{end}"))
        names = [F.coalesce("into_p", "p"), F.coalesce("into_q", "q")]
        rename = lambda df: df.join(into("p"), "p", "left").join(into("q"), "q", "left").where(names[0] != names[1])
        alive = choice.select(F.col("p").alias("alive"))
        clash = clash.join(alive, F.col("p") == F.col("alive"), "left_semi").join(alive, F.col("q") == F.col("alive"), "left_semi")
        clash = written(rename(clash).select(*_pair(*names)).distinct())
        touching = rename(free).groupBy(*_pair(*names)).agg(F.sum("links").alias("links"))
        if size is not None:
            size = written(size.join(into("p").withColumnRenamed("p", "part"), "part", "left").groupBy(F.coalesce("into_p", "part").alias("part")).agg(F.sum("n").alias("n")))


def _merge_pairs(p: np.ndarray, q: np.ndarray, links: np.ndarray, cp: np.ndarray, cq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounds of _merge_rounds on arrays: (p, q), all of which q ends as which p."""
    ids, at = np.unique(np.concatenate([p, q, cp, cq]), return_inverse=True)
    n, k = len(ids), np.cumsum([len(p), len(q), len(cp)])
    p, q, cp, cq = np.split(at, k)
    root, clash = np.arange(n), np.unique(cp * n + cq)
    while True:
        free = ~np.isin(p * n + q, clash)
        p, q, links = p[free], q[free], links[free]
        if not len(p):
            return ids[root[root < np.arange(n)]], ids[root < np.arange(n)]
        order = np.fmod(ids[p] * 7919 + ids[q] * 104729, 1000003)
        u, v, twice = np.concatenate([p, q]), np.concatenate([q, p]), lambda w: np.concatenate([w, w])
        ranked = np.lexsort((twice(q), twice(p), twice(order), -twice(links), u))
        first = ranked[np.flatnonzero(np.diff(u[ranked], prepend=-1))]
        choice = np.full(n, -1)
        choice[u[first]] = v[first]
        mine = np.flatnonzero(choice >= 0)
        mine = mine[(choice[choice[mine]] == mine) & (mine < choice[mine])]
        name = np.arange(n)
        name[choice[mine]] = mine
        root = name[root]
        p, q = np.minimum(name[p], name[q]), np.maximum(name[p], name[q])
        there = p < q
        key, at = np.unique(p[there] * n + q[there], return_inverse=True)
        links, p, q = np.bincount(at, links[there], len(key)).astype(np.int64), key // n, key % n
        cp, cq = name[clash // n], name[clash % n]
        clash = np.unique(np.minimum(cp, cq) * n + np.maximum(cp, cq))


def _merged_in_tasks(touching: DataFrame, clash: DataFrame) -> DataFrame:
    """(p, q) of _merge_pairs, a block of touching (block, p, q, links) and clash (block, p, q) a task."""

    def merge(touching: pd.DataFrame, clash: pd.DataFrame) -> pd.DataFrame:
        p, q = _merge_pairs(*(touching[c].to_numpy(np.int64) for c in ("p", "q", "links")), *(clash[c].to_numpy(np.int64) for c in ("p", "q")))
        return pd.DataFrame({"p": p, "q": q})

    return touching.groupBy("block").cogroup(clash.groupBy("block")).applyInPandas(merge, "p long, q long")


def split_conflicts(clusters: DataFrame, links: DataFrame) -> DataFrame:
    """(node, tile, part) of clusters (node, tile, cluster): those that hold two layers of a tile come apart into parts
    that hold but one, as large as merging by links makes them; others stay. part is the least node of each.

    Clusters don't mind each other: those of at most LOCAL_PAIRS pairs are merged in tasks that hold some of them, larger ones by
    rounds over all, until no more are left, to the same parts."""
    twice = clusters.groupBy("cluster", "tile").agg(F.count("*").alias("n")).where("n > 1").select("cluster").distinct()
    twice = written(twice)
    bad = written(clusters.join(twice, "cluster", "left_semi").select("node", "tile", "cluster", F.col("node").alias("part")))
    whole = clusters.join(twice, "cluster", "left_anti").select("node", "tile", F.col("cluster").alias("part"))
    of = lambda end: bad.select(F.col("node").alias(end), "cluster")
    inner = links.select("a", "b").where("a < b").distinct().join(of("a"), "a").join(of("b"), ["b", "cluster"])
    pairs = written(inner.select("cluster", F.col("a").alias("p"), F.col("b").alias("q"), F.lit(1).cast("long").alias("links")))
    clash = written(_clashing(bad, ["tile", "cluster"]))
    large = written(pairs.select("cluster").union(clash.select("cluster")).groupBy("cluster").count().where(F.col("count") > LOCAL_PAIRS).select("cluster"))
    small = lambda df: df.join(F.broadcast(large), "cluster", "left_anti").withColumn("block", F.shiftright("cluster", BLOCK_BITS)).drop("cluster")
    renames = _merged_in_tasks(small(pairs), small(clash))
    if not large.isEmpty():
        of_large = lambda df: df.join(F.broadcast(large), "cluster", "left_semi").drop("cluster")
        renames = renames.union(_merge_rounds(of_large(pairs), of_large(clash), None))
    return whole.union(_renamed(bad, renames))


def assigned(candidates: DataFrame, most_apart: float, least_gap: float, norm: float) -> DataFrame:
    """(tile, node, apart): the surface of each tile, among candidates (tile, node, surface, disparity): the nearest by
    disparity, if it is at most most_apart away and the next nearest at least least_gap further. Differences shrink in proportion
    where the mean of both disparities is above norm. Tiles of null disparity have none."""
    mean = (F.col("surface") + F.col("disparity")) / 2
    apart = (F.col("disparity") - F.col("surface")) * F.when(mean > norm, norm / mean).otherwise(1.0)
    ranked = candidates.where("disparity is not null and surface is not null").withColumn("apart", apart)
    best = ranked.groupBy("tile").agg(F.array_sort(F.collect_list(F.struct(F.abs("apart").alias("off"), "node", "apart"))).alias("near"))
    first, second = F.get("near", F.lit(0)), F.get("near", F.lit(1))
    sound = (first["off"] <= most_apart) & (second.isNull() | (second["off"] - first["off"] >= least_gap))
    return best.where(sound).select("tile", first["node"].alias("node"), first["apart"].alias("apart"))


def fronts(starts: DataFrame, nodes: DataFrame, links: DataFrame, weak: float, strong: float | None, far: float, near: float, norm: float, rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Surfaces grow from assigned tiles along links into tiles without one: ((tile, node, round), (tile, dirs)).

    starts: (tile, node), a tile once; a null node forbids the tile. nodes: (node, tile, surface, disparity,
    strength) with what was measured on the tile. links: (a, b, dir). From a weak tile (strength at most weak) a surface goes
    to weak tiles and to those whose disparity fits it, from -far to near of the scaled difference; from others, only
    where it fits and strength is at least strong (nowhere, if that is None). Of fronts that reach a tile in the same
    round the one that fits best takes it, at equal fits the least node. dirs are the directions (bits) in which a surface
    wanted a tile of another's. A round reads the last round's front only.
    """
    at = nodes.select("node", "tile", "surface", "disparity", "strength")
    taken = written(starts.select("tile", "node", F.lit(0).alias("round")))
    front, wanted = taken.where("node is not null"), None
    source = at.select(F.col("node").alias("a"), F.col("strength").alias("from_strength"))
    goal = at.select(F.col("node").alias("b"), F.col("tile").alias("to_tile"), "surface", "disparity", "strength")
    mean = (F.col("surface") + F.col("disparity")) / 2
    apart = (F.col("disparity") - F.col("surface")) * F.when(mean > norm, norm / mean).otherwise(1.0)
    edges = written(links.select("a", "b", "dir").join(source, "a").join(goal, "b").withColumn("apart", apart))
    fits = F.coalesce(F.col("apart").between(-far, near), F.lit(False))
    weak_source, weak_goal = F.col("from_strength") <= weak, F.col("strength") <= weak
    onward = (fits & (F.col("strength") >= strong)) if strong is not None else F.lit(False)
    edges = edges.where(F.when(weak_source, weak_goal | fits).otherwise(onward)).select("a", "b", "dir", "to_tile", F.abs("apart").alias("off"))
    for k in range(1, rounds + 1):
        step = front.select("tile", F.col("node").alias("a")).join(edges, "a")
        owned = step.join(taken.select(F.col("tile").alias("to_tile"), F.col("node").alias("owner"), F.lit(True).alias("owned")), "to_tile", "left")
        owned = written(owned)
        clash = owned.where("owned and owner is not null and owner <> b").groupBy("tile").agg(F.bit_or(F.expr("shiftleft(1, cast(dir AS int))")).alias("dirs"))
        fit = F.struct(F.coalesce("off", F.lit(float("inf"))).alias("off"), F.col("b").alias("node"))
        new = owned.where("owned is null").groupBy(F.col("to_tile").alias("tile")).agg(F.min(fit)["node"].alias("node"))
        new = written(new.select("tile", "node", F.lit(k).alias("round")))
        wanted = clash if wanted is None else wanted.union(clash)
        # who lost a tile in this very round wanted it too
        lost = owned.where("owned is null").join(new.select(F.col("tile").alias("to_tile"), F.col("node").alias("winner")), "to_tile").where("winner <> b")
        wanted = written(wanted.union(lost.groupBy("tile").agg(F.bit_or(F.expr("shiftleft(1, cast(dir AS int))")).alias("dirs"))))
        if new.isEmpty():
            break
        taken, front = written(taken.union(new)), new
    return taken.where("node is not null"), wanted.groupBy("tile").agg(F.bit_or("dirs").alias("dirs"))
