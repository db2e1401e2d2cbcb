"""Clusters of layers, their splitting and merging, competing fronts: against plain versions, at several partitionings."""

import os
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessella.operators import surfaces
from tessella.plans import layered

SF = "/root/testdata/sf0.001"

STEP = {0: (0, -1), 1: (1, -1), 2: (1, 0), 3: (1, 1), 4: (0, 1), 5: (-1, 1), 6: (-1, 0), 7: (-1, -1)}


def scene(seed, side=9, layers=3, chance=0.7):
    """Nodes of a grid with a random surface each, linked where surfaces of neighbouring tiles are near; both ways."""
    rng = np.random.default_rng(seed)
    nodes = {}
    for y in range(side):
        for x in range(side):
            for layer in range(layers):
                if rng.uniform() < chance:
                    nodes[(y * side + x) * 10 + layer] = (y * side + x, float(rng.integers(0, 8)), float(rng.integers(0, 8)), float(rng.integers(0, 10)) / 10)
    links = []
    for a, (tile, s, _, _) in nodes.items():
        y, x = divmod(tile, side)
        for d, (dx, dy) in STEP.items():
            if 0 <= x + dx < side and 0 <= y + dy < side:
                other = [b for b in range(((y + dy) * side + x + dx) * 10, ((y + dy) * side + x + dx) * 10 + layers) if b in nodes and abs(nodes[b][1] - s) <= 1]
                links += [(a, b, d) for b in other]
    return nodes, links


def frames(spark, nodes, links, parts=3):
    df = spark.createDataFrame([(k, t, s, d, float(w)) for k, (t, s, d, w) in nodes.items()], "node long, tile long, surface double, disparity double, strength double").repartition(parts)
    return df, spark.createDataFrame(links, "a long, b long, dir int").repartition(parts)


def plain_components(nodes, links):
    label = {k: k for k in nodes}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, b, _ in links:
        x, y = sorted((root(a), root(b)))
        label[y] = x
    return {k: root(k) for k in nodes}


def plain_merged(part, tile, links, by="links"):
    """The best free pair first, one at a time: the pair that is best of all is the choice of both, so the order is the same."""
    part = dict(part)
    order = lambda p, q: (p * 7919 + q * 104729) % 1000003
    ends = {(a, b) for a, b, *_ in links if a < b}
    while True:
        count = Counter(tuple(sorted((part[a], part[b]))) for a, b in ends if part[a] != part[b])
        tiles = defaultdict(set)
        for k, p in part.items():
            tiles[p].add(tile[k])
        size = Counter(part.values())
        free = {pq: n if by == "links" else size[pq[0]] + size[pq[1]] for pq, n in count.items() if not tiles[pq[0]] & tiles[pq[1]]}
        if not free:
            return part
        # all pairs that choose each other merge in a round
        best = {}
        for (p, q), n in free.items():
            for own, other in ((p, q), (q, p)):
                best[own] = max(best.get(own, ((-1,), None)), ((n, -order(p, q), -p, -q), other))
        into = {q: p for p in best for q in [best[p][1]] if p < q and best[q][1] == p}
        part = {k: into.get(p, p) for k, p in part.items()}


def test_components(spark):
    for seed in (1,):
        nodes, links = scene(seed, chance=0.4)
        df, edges = frames(spark, nodes, links)
        assert {r["node"]: r["cluster"] for r in surfaces.components(df, edges).collect()} == plain_components(nodes, links)
    line = {k: (k, 0.0, 0.0, 0.0) for k in range(60)}
    df, edges = frames(spark, line, [(k, k + 1, 2) for k in range(59)] + [(k + 1, k, 6) for k in range(59)])
    assert {r["cluster"] for r in surfaces.components(df, edges).collect()} == {0}


@pytest.mark.parametrize("units", [0, 1, 2, 3, 4])
def test_grown(spark, units):
    nodes, links = scene(3, side=7, layers=2)
    df, edges = frames(spark, nodes, links)
    want = set(sorted(nodes)[20:22])
    got = {r["node"] for r in surfaces.grown(df.where(f"node in {tuple(want)}"), edges, units).collect()}
    left = units
    while left > 0:
        for ways in ((0, 2, 4, 6),) if left == 1 else ((2, 6), (0, 4)):
            want = want | {b for a, b, d in links if a in want and d in ways}
        left -= 2
    assert got == want


@pytest.mark.parametrize("parts", [7])
def test_split_and_merged(spark, parts):
    nodes, links = scene(4, side=6)
    df, edges = frames(spark, nodes, links, parts)
    tile = {k: v[0] for k, v in nodes.items()}
    cluster = plain_components(nodes, links)
    bad = {c for (c, _), n in Counter((cluster[k], tile[k]) for k in nodes).items() if n > 1}
    assert bad
    inner = [(a, b) for a, b, _ in links if cluster[a] in bad]
    want = {k: c for k, c in cluster.items() if c not in bad} | plain_merged({k: k for k in nodes if cluster[k] in bad}, tile, inner)
    clusters = df.join(surfaces.components(df, edges), "node").select("node", "tile", "cluster")
    got = {r["node"]: r["part"] for r in surfaces.split_conflicts(clusters, edges).collect()}
    assert got == want
    assert max(Counter((p, tile[k]) for k, p in got.items()).values()) == 1
    # merging by size from given parts
    pairs = {k: min(k, next((b for a, b, d in links if a == k and d == 2), k)) for k in nodes}
    pairs = {k: k if any(tile[k] == tile[o] for o in nodes if o != k and pairs[o] == pairs[k]) else p for k, p in pairs.items()}
    given = spark.createDataFrame([(k, tile[k], p) for k, p in pairs.items()], "node long, tile long, part long").repartition(parts)
    assert {r["node"]: r["part"] for r in surfaces.merged(given, edges, "nodes").collect()} == plain_merged(pairs, tile, links, "nodes")


def test_assigned(spark):
    rows = [(1, 10, 5.0, 5.2), (1, 11, 8.0, 5.2), (2, 20, 5.0, 5.5), (2, 21, 6.0, 5.5), (3, 30, 5.0, 9.0), (4, 40, 100.0, 103.0), (5, 50, 1.0, None), (6, 61, 3.0, 3.0), (6, 60, 3.0, 3.0)]
    df = spark.createDataFrame(rows, "tile long, node long, surface double, disparity double")
    got = {r["tile"]: r["node"] for r in surfaces.assigned(df, 1.0, 0.5, 10.0).collect()}
    assert got == {1: 10, 4: 40}
    assert surfaces.assigned(df, 1.0, 0.0, 10.0).where("tile = 6").first()["node"] == 60


def plain_fronts(starts, nodes, links, weak, strong, far, near, norm):
    taken, dirs = {t: n for t, n in starts}, defaultdict(int)
    front = [(t, n) for t, n in starts if n is not None]
    out = defaultdict(list)
    for a, b, d in links:
        out[a].append((b, d))
    while front:
        want = []
        for t, a in front:
            for b, d in out[a]:
                tile, surface, disparity, strength = nodes[b]
                mean = (surface + disparity) / 2
                apart = (disparity - surface) * (norm / mean if mean > norm else 1)
                fits = -far <= apart <= near
                ok = (strength <= weak or fits) if nodes[a][3] <= weak else fits and strong is not None and strength >= strong
                if ok:
                    want.append((tile, abs(apart), b, t, d))
        new = {}
        for tile, off, b, _, _ in want:
            if tile not in taken:
                new[tile] = min(new.get(tile, (9e9, 0)), (off, b))
        for tile, _, b, t, d in want:
            owner = taken[tile] if tile in taken else new[tile][1]
            if owner is not None and owner != b:
                dirs[t] |= 1 << d
        front = [(t, b) for t, (_, b) in new.items()]
        taken |= dict(front)
    return {t: n for t, n in taken.items() if n is not None}, dict(dirs)


@pytest.mark.parametrize("parts, strong", [(1, 0.5), (7, 0.5), (40, 0.5), (7, None)])
def test_fronts(spark, parts, strong):
    nodes, links = scene(5, side=6)
    df, edges = frames(spark, nodes, links, parts)
    order = sorted(nodes)
    starts = [(nodes[k][0], k) for k in (order[5], order[40], order[-8])] + [(20, None), (31, None)]
    given = spark.createDataFrame(starts, "tile long, node long").repartition(parts)
    taken, wanted = surfaces.fronts(given, df, edges, 0.4, strong, 1.5, 0.5, 5.0)
    want = plain_fronts(starts, nodes, links, 0.4, strong, 1.5, 0.5, 5.0)
    assert {r["tile"]: r["node"] for r in taken.collect()} == want[0]
    assert {r["tile"]: r["dirs"] for r in wanted.collect()} == want[1]


@pytest.mark.parametrize("bits, most", [(3, 0)])
def test_blocks_and_large_clusters_give_the_same(spark, monkeypatch, bits, most):
    """Whatever is contracted or merged in one task, components and parts are those of the plain walks."""
    monkeypatch.setattr(surfaces, "BLOCK_BITS", bits)
    monkeypatch.setattr(surfaces, "LOCAL_PAIRS", most)
    nodes, links = scene(6, side=4)
    df, edges = frames(spark, nodes, links)
    tile, cluster = {k: v[0] for k, v in nodes.items()}, plain_components(nodes, links)
    found = surfaces.components(df, edges)
    assert {r["node"]: r["cluster"] for r in found.collect()} == cluster
    bad = {c for (c, _), n in Counter((cluster[k], tile[k]) for k in nodes).items() if n > 1}
    inner = [(a, b) for a, b, _ in links if cluster[a] in bad]
    want = {k: c for k, c in cluster.items() if c not in bad} | plain_merged({k: k for k in nodes if cluster[k] in bad}, tile, inner)
    assert bad and {r["node"]: r["part"] for r in surfaces.split_conflicts(df.join(found, "node").select("node", "tile", "cluster"), edges).collect()} == want


def test_pairs_merged_in_a_task_are_those_of_the_rounds():
    rng = np.random.default_rng(1)
    tile = {k: k // 3 for k in range(90)}
    links = {tuple(sorted(rng.choice(90, 2, replace=False).tolist())) for _ in range(150)}
    links = [(a, b) for a, b in links if tile[a] != tile[b]]
    p, q = np.array(links).T
    clash = np.array([(a, b) for a in tile for b in tile if a < b and tile[a] == tile[b]])
    into = dict(zip(*(v.tolist() for v in surfaces._merge_pairs(p, q, np.ones(len(p), np.int64), *clash.T)[::-1])))
    assert {k: into.get(k, k) for k in tile} == plain_merged({k: k for k in tile}, tile, links)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("most", [100_000, 500])
def test_split_layers_has_clusters_to_take_apart(spark, monkeypatch, most):
    """Of all links, not of those of equal surfaces, in whose clusters no tile has two layers; large clusters end in one task."""
    monkeypatch.setattr(surfaces, "LOCAL_PAIRS", most)
    tile = {r["node"]: r["tile"] for r in layered.layers(spark, SF).collect()}
    links = [tuple(r) for r in layered.layer_links(spark, SF).select("a", "b", "dir").collect()]
    cluster = plain_components(tile, links)
    bad = {c for (c, _), n in Counter((cluster[k], tile[k]) for k in tile).items() if n > 1}
    inner = [(a, b) for a, b, _ in links if cluster[a] in bad]
    want = {k: c for k, c in cluster.items() if c not in bad} | plain_merged({k: k for k in tile if cluster[k] in bad}, tile, inner)
    got = {r["node"]: r["part"] for r in layered.split_layers(spark, SF).collect()}
    assert bad and got == want and got != cluster
    assert max(Counter((p, tile[k]) for k, p in got.items()).values()) == 1
