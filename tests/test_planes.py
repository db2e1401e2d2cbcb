"""Links of planes by squares and corners to the end, and smoothing, against plain versions."""

import numpy as np
import pytest

from tessella.operators import planes as pl

SIDE = 6


def scene(seed, chance=0.75):
    rng = np.random.default_rng(seed)
    planes = {y * SIDE + x: (float(0.3 * x + 0.1 * rng.standard_normal()), float(0.3 + 0.1 * rng.standard_normal()), float(0.1 * rng.standard_normal()), float(rng.uniform(0.5, 1))) for y in range(SIDE) for x in range(SIDE)}
    links = {}
    for a in planes:
        y, x = divmod(a, SIDE)
        for d in (2, 4):
            if x + pl.RIGHT[d] < SIDE and y + pl.DOWN[d] < SIDE and rng.uniform() < chance:
                b = a + pl.RIGHT[d] + SIDE * pl.DOWN[d]
                links[a, d], links[b, d + 4 & 7] = b, a
    return planes, links


def frames(spark, planes, links):
    return (spark.createDataFrame([(k, *v) for k, v in planes.items()], "node long, d double, tx double, ty double, weight double"),
            spark.createDataFrame([(a, b, d) for (a, d), b in links.items()], "a long, b long, dir int").repartition(3))


def price(planes, a, b, d):
    x, y = pl.RIGHT[d] / 2, pl.DOWN[d] / 2
    p, q = planes[a], planes[b]
    return (p[0] + p[1] * x + p[2] * y - q[0] + q[1] * x + q[2] * y) ** 2 + (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2


def accepted(wanted, links, planes, most):
    wanted = wanted | {(b, a, (d + 4) % 8) for a, b, d in wanted}
    best = {}
    for a, b, d in wanted:
        if (a, d) not in links and price(planes, a, b, d) <= most:
            best[a, d] = min(best.get((a, d), (9e9,)), (round(price(planes, a, b, d), 9), min(a, b), max(a, b), b))
    return {k: v[-1] for k, v in best.items() if best.get((v[-1], (k[1] + 4) % 8), (0,))[-1] == k[0]}


def as_dict(df):
    rows = [((r["a"], r["dir"]), r["b"]) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


@pytest.mark.parametrize("most", [0.02, 0.08])
def test_squares_and_corners(spark, most):
    planes, links = scene(1)
    p, ends = frames(spark, planes, links)
    wanted = set()
    for a in planes:
        q, r = links.get((a, 2)), links.get((a, 4))
        s = links.get((q, 4))
        if s is not None and s == links.get((r, 2)):
            wanted |= {(a, s, 3), (q, r, 5)}
    new = accepted(wanted, links, planes, most)
    assert new and as_dict(pl.fill_squares(ends, p, most)) == links | new
    want = dict(links)
    while True:
        wanted = set()
        for (o, d), a in want.items():
            for e in range(8):
                b = want.get((o, e))
                step = (pl.RIGHT[e] - pl.RIGHT[d], pl.DOWN[e] - pl.DOWN[d])
                if b is not None and step in pl._NUMBER:
                    wanted.add((a, b, pl._NUMBER[step]))
        new = accepted(wanted, want, planes, most)
        if not new:
            break
        want |= new
    assert len(want) > len(links) and as_dict(pl.cut_corners(ends, p, most)) == want


def test_smoothing(spark):
    planes, links = scene(2, 0.9)
    del links[0, 2], links[1, 6]
    planes[99] = (5.0, 0.0, 0.0, 1.0)  # linked to nothing
    p, ends = frames(spark, planes, links)
    got, changes = pl.smoothed(p, ends, 0.5, 4)
    now = dict(planes)
    for _ in range(4):
        after = {}
        for k, v in now.items():
            w, total = planes[k][3] * 0.5, np.array(planes[k][:3]) * planes[k][3] * 0.5
            for d in range(8):
                if (k, d) in links:
                    n = now[links[k, d]]
                    total = total + n[3] * np.array([n[0] - n[1] * pl.RIGHT[d] - n[2] * pl.DOWN[d], n[1], n[2]])
                    w += n[3]
            after[k] = (*(0.5 * np.array(v[:3]) + 0.5 * total / w), v[3])
        now = after
    for r in got.collect():
        assert (r["d"], r["tx"], r["ty"]) == pytest.approx(now[r["node"]][:3])
    assert all(a > b for a, b in zip(changes, changes[1:], strict=False)) and changes[-1] > 0


def test_a_diagonal_that_costs_the_limit_is_taken_whatever_the_last_bit(spark):
    """The limit holds for the cost to nine decimals, as in the query's SQL."""
    found = ((a / 100, b / 100) for a in range(1, 80) for b in range(1, 80))
    d, ty = next((d, ty) for d, ty in found if (c := (d + ty * 0.5) ** 2 + ty**2) > 0.5 and round(c, 9) == 0.5)
    given = [(0, d, 0.0, ty, 1.0), (1, 9.0, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 0.0, 1.0), (3, 0.0, 0.0, 0.0, 1.0)]
    ways = [(0, 1, 2), (0, 2, 4), (1, 3, 4), (2, 3, 2)]
    links = spark.createDataFrame(ways + [(b, a, (w + 4) % 8) for a, b, w in ways], "a long, b long, dir int")
    got = pl.fill_squares(links, spark.createDataFrame(given, "node long, d double, tx double, ty double, weight double"), 0.5)
    assert {(r["a"], r["b"], r["dir"]) for r in got.where("dir % 2 = 1").collect()} == {(0, 3, 3), (3, 0, 7)}
