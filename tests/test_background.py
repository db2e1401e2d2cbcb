"""Background masks against plain growth; seeds, blockers and limits each decide something."""

import numpy as np
import pytest

from tessella.operators import grid


def large(flags, least):
    out, seen = set(), set()
    for start in flags:
        if start in seen:
            continue
        group, todo = {start}, [start]
        while todo:
            x, y = todo.pop()
            for n in ((x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)):
                if n in flags and n not in group:
                    group.add(n)
                    todo.append(n)
        seen |= group
        out |= group if len(group) >= least else set()
    return out


def plain(rows, near, sure, maybe, most, least_seed, least_block):
    seed = {(x, y) for x, y, d, s, _ in rows if d is not None and s is not None and abs(d) < near and s >= sure}
    front = {(x, y) for x, y, d, s, _ in rows if d is not None and s is not None and d >= near and d > 0 and s > maybe}
    block = {(x, y) for x, y, _, _, q in rows if q is not None and len(q) > 1 and sorted(q)[-2] > most}
    seed, front = large(seed, least_seed), large(front, least_block)
    reached, todo, free = set(seed), list(seed), {(r[0], r[1]) for r in rows} - front - block
    while todo:
        x, y = todo.pop()
        for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
            if n in free and n not in reached:
                reached.add(n)
                todo.append(n)
    return reached


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    out = [(x, y, float(rng.normal(1, 2)), float(rng.uniform(0, 1)), [float(v) for v in rng.uniform(0, 1, 4)]) for y in range(14) for x in range(16) if rng.uniform() < 0.95]
    out[5], out[40], out[70] = (*out[5][:2], None, 1.0, None), (*out[40][:2], 0.0, None, [0.9]), (*out[70][:2], -9.0, 1.0, [0.1] * 4)
    return out


CASES = [(1.0, 0.5, 0.5, 0.7, 2, 2), (1.0, 0.9, 0.5, 0.7, 1, 1), (1.0, 0.5, 0.5, 0.5, 2, 2), (1.0, 0.5, 0.1, 0.7, 2, 2), (1.0, 0.5, 0.5, 0.7, 5, 2), (1.0, 0.5, 0.5, 0.7, 2, 6), (0.3, 0.5, 0.5, 0.7, 2, 2)]


def test_each_limit_decides(rows):
    assert len({frozenset(plain(rows, *c)) for c in CASES}) == len(CASES)


@pytest.mark.parametrize("case", [CASES[0], CASES[4]])
def test_background(spark, rows, case):
    df = spark.createDataFrame(rows, "x long, y long, disparity double, strength double, differences array<double>").repartition(3)
    assert {(r["x"], r["y"]) for r in grid.background(df, *case).collect()} == plain(rows, *case)
