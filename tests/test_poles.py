"""Pole clusters and periods against plain walks over all rows."""

import numpy as np
import pytest

from tessella.operators import periods as per
from tessella.operators import poles
from tessella.plans import poles as plan
from tessella.plans.views import meas

SEED = "scene long, tile long, x long, y long, disparity double, strength double"
BOX = "scene long, cluster long, disparity double, x double, y double, strength double, n_tiles long, left long, right long, top long, bottom long"


def scattered(seed, n=120, width=40):
    rng = np.random.default_rng(seed)
    rows = {}
    for scene in (1, 2):
        for tile in rng.choice(width * 30, n, replace=False).tolist():
            rows[scene, tile] = (scene, tile, tile % width, tile // width, float(rng.choice([3.0, 3.5, 9.0, 20.0])), float(rng.uniform(0.1, 1)))
    return list(rows.values())


def walked(rows, dx, dy, dd):
    out, clusters = {}, {}
    for s, tile, x, y, d, w in sorted(rows):
        for c in clusters.setdefault(s, []):
            if all(m is None or abs(c[k] - v) <= m + 1e-9 for k, v, m in (("x", x, dx), ("y", y, dy), ("d", d, dd))):
                break
        else:
            c = {"x": 0.0, "y": 0.0, "d": 0.0, "w": 0.0, "name": tile}
            clusters[s].append(c)
        for k, v in (("x", x), ("y", y), ("d", d)):
            c[k] = (c[k] * c["w"] + v * w) / (c["w"] + w)
        c["w"] += w
        out[s, tile] = c["name"]
    return out


def as_dict(df, *values):
    rows = [((r[0], r[1]), tuple(r[v] for v in values)) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


@pytest.mark.parametrize("limits", [(1.2, 4.0, 1.0), (None, 3.0, 1.0), (2.0, None, None), (3.3, 3.3, 30.0)])
@pytest.mark.parametrize("parts", [1, 7])
def test_first_fit_is_the_walk_over_all(spark, limits, parts):
    rows = scattered(3)
    got = as_dict(poles.first_fit(spark.createDataFrame(rows, SEED).repartition(parts), *limits), "cluster")
    assert {k: v[0] for k, v in got.items()} == walked(rows, *limits)


def test_shards_part_what_cannot_meet(spark):
    rows = [(1, k, x, 0, 5.0, 1.0) for k, x in enumerate((0, 2, 4, 20, 21, 60))]
    df, keys = poles.shards(spark.createDataFrame(rows, SEED), [("x", "x", 3.0), ("y", "y", None)])
    assert keys == ["scene", "_shard0"]
    assert {r["tile"]: r["_shard0"] for r in df.collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 2}


def test_seeds_that_belong_nowhere(spark):
    nan = float("nan")
    rows = [(1, 0, 0, 0, 5.0, 0.0), (1, 1, 1, 0, None, 1.0), (1, 2, 2, 0, nan, 1.0), (1, 3, 3, 0, 5.0, nan), (1, 4, 4, 0, 5.0, 1.0), (1, 4, 4, 0, 6.0, 0.5), (None, 5, 5, 0, 5.0, 1.0)]
    df = spark.createDataFrame(rows, SEED)
    assert as_dict(poles.first_fit(df, 1.0, 1.0, 1.0), "cluster") == {(1, 4): (4,)}
    assert poles.first_fit(df.limit(0), 1.0, 1.0, 1.0).count() == 0


def crossing(a, b):
    return a[7] <= b[8] and b[7] <= a[8] and a[9] <= b[10] and b[9] <= a[10]


def clustered(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for scene in (1, 2):
        for c in range(60):
            x, y = int(rng.integers(0, 80)), int(rng.integers(0, 40))
            rows.append((scene, c, float(rng.choice([1.0, 1.4, 1.8, 6.0])), float(x), float(y), float(rng.uniform(0.1, 1)), 1, x - 1, x + 2, y - 1, y + 4))
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_merging_is_the_walk_over_all(spark, parts):
    rows, want = clustered(4), {}
    for scene in (1, 2):
        kept = []
        for r in sorted((r for r in rows if r[0] == scene), key=lambda r: (r[2], r[1])):
            r = [*r, 1]
            for k in kept:
                if crossing(k, r) and abs(k[2] - r[2]) < 0.5:
                    for i in (2, 3, 4):
                        k[i] = (k[i] * k[5] + r[i] * r[5]) / (k[5] + r[5])
                    k[5], k[6], k[11] = k[5] + r[5], k[6] + r[6], k[11] + 1
                    k[7:11] = min(k[7], r[7]), max(k[8], r[8]), min(k[9], r[9]), max(k[10], r[10])
                    break
            else:
                kept.append(r)
        want |= {(scene, k[1]): tuple(round(v, 9) for v in k[2:]) for k in kept}
    got = poles.merged(spark.createDataFrame(rows, BOX).repartition(parts), 0.5)
    assert {(r[0], r[1]): tuple(round(v, 9) for v in r[2:]) for r in got.collect()} == want
    assert any(v[-1] > 2 for v in want.values())


def test_layers_are_the_walk_over_all(spark):
    rows, want = clustered(5), {}
    for scene in (1, 2):
        layers = []
        for r in sorted((r for r in rows if r[0] == scene), key=lambda r: (r[2], r[1])):
            at = next((k for k, layer in enumerate(layers) if not any(crossing(r, o) for o in layer)), len(layers))
            if at == len(layers):
                layers.append([])
            layers[at].append(r)
            want[scene, r[1]] = (at,)
    assert as_dict(poles.layered(spark.createDataFrame(rows, BOX).repartition(5)), "layer") == want
    assert max(want.values()) > (1,)


@pytest.mark.parametrize(
    "profile, apart, zero, cut",
    [
        ([5, 1, 1, 5], 2, False, 2),  # the middle of the lowest run
        ([5, 1, 1, 5], 3, False, None),  # the gap is too short
        ([5, 1, 1, 5], 2, True, None),  # no empty column
        ([5, 1, 0, 5], 2, True, 3),
        ([5, 0, 0, 0, 0, 5], 2, True, 3),
        ([1, 2, 3, 2, 1], 1, False, None),  # one maximum
        ([5, 1, 5, 0, 0, 5], 2, False, 4),  # the first gap that is long enough
        ([5, 5, 5], 1, False, None),  # maxima side by side
        ([0, 0, 0], 1, False, None),
    ],
)
def test_cuts(spark, profile, apart, zero, cut):
    box = spark.createDataFrame([(1, 7, 10, 10 + len(profile) - 1, 0, 3)], "scene long, cluster long, left long, right long, top long, bottom long")
    measured = [(1, 10 + k, 1, h / 2) for k, h in enumerate(profile) if h for _ in (0, 1)] + [(1, 10, 4, 50.0), (2, 11, 1, 50.0), (1, 9, 1, 50.0)]
    got = poles.cuts(box, spark.createDataFrame(measured, "scene long, x long, y long, strength double"), apart, zero)
    assert as_dict(got, "cut") == ({} if cut is None else {(1, 7): (cut,)})


def test_split_names_halves_by_their_first_tile(spark):
    seeds = spark.createDataFrame([(1, 3, 3, 0, 5.0, 1.0), (1, 8, 8, 0, 5.0, 1.0), (1, 44, 4, 1, 5.0, 1.0), (1, 49, 9, 1, 5.0, 1.0), (1, 80, 0, 2, 5.0, 1.0)], SEED)
    members = spark.createDataFrame([(1, 3, 3), (1, 8, 3), (1, 44, 3), (1, 49, 3), (1, 80, 80)], "scene long, tile long, cluster long")
    cut = spark.createDataFrame([(1, 3, 4)], "scene long, cluster long, cut long")
    got = poles.split(seeds, members, poles.boxes(seeds, members), cut)
    assert {k: v[0] for k, v in as_dict(got, "cluster").items()} == {(1, 3): 3, (1, 44): 3, (1, 8): 8, (1, 49): 8, (1, 80): 80}


MEASURED = "x long, y long, target double, resid double, strength double"
SETTINGS = {"trusted": 0.1, "floor": 0.1, "over": 0.2, "join": 0.6, "apart": 3.0, "repeats": 2, "tolerance": 0.4}


def plain_periods(rows, trusted, floor, over, join, apart, repeats, tolerance, scale=0.85):
    rows = [(x, y, t + r / scale, s - floor) for x, y, t, r, s in rows if abs(r) <= trusted and s - floor > 0]
    out = {}
    for x, y in {r[:2] for r in rows}:
        seen = sorted((d, w / (1 << abs(a - x) + abs(b - y))) for a, b, d, w in rows if abs(a - x) <= 1 and abs(b - y) <= 1)
        starts, peaks = list(seen), []
        while any(w >= over for _, w in starts):
            at = max((w, -d) for d, w in starts if w >= over)
            at = -at[1]
            part = [m for m in seen if abs(m[0] - at) <= join]
            seen = [m for m in seen if abs(m[0] - at) > join]
            starts = [m for m in starts if abs(m[0] - at) > join and abs(m[0] - at) >= apart]
            peaks.append((sum(d * w for d, w in part) / sum(w for _, w in part), max(w for _, w in part)))
        layers = {next((k for k, p in enumerate(peaks) if abs(p[0] - d) <= tolerance + 1e-9), None) for a, b, d, _ in rows if (a, b) == (x, y)} - {None}
        peaks.sort()
        if layers and len(peaks) > repeats:
            step = (peaks[repeats][0] - peaks[0][0]) / repeats
            if all(abs(peaks[0][0] + k * step - peaks[k][0]) <= tolerance + 1e-9 for k in range(1, repeats)):
                strength = sum(p[1] for p in peaks[: repeats + 1]) / (repeats + 1)
                out[x, y] = (round(peaks[0][0], 6), round(step, 6), round(strength, 6), len(peaks), len(layers))
    return out


def found(df):
    rows = [((r["x"], r["y"]), (*(round(r[c], 6) for c in ("base", "period", "strength")), r["n_peaks"], r["n_layers"])) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


@pytest.mark.parametrize("seed, parts", [(1, 1), (1, 7), (2, 3)])
def test_periods_against_all_tiles_one_by_one(spark, seed, parts):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(1500):
        x, y = int(rng.integers(-3, 35)), int(rng.integers(0, 20))
        rows.append((x, y, float(rng.choice([4, 10, 16, 21])), float(rng.choice([-0.12, -0.05, 0.0, 0.05])), float(rng.choice([0.05, 0.3, 0.5, 0.8]))))
    want = plain_periods(rows, **SETTINGS)
    assert found(per.periods(spark.createDataFrame(rows, MEASURED).repartition(parts), **SETTINGS)) == want
    assert 20 < len(want) < len({r[:2] for r in rows})


def test_planted_periods_and_none_without(spark):
    rows = [(5, 5, d, 0.0, 0.9) for d in (2.0, 8.0, 14.0)] + [(15, 15, d, 0.0, 0.9) for d in (2.0, 8.0, 17.0)] + [(30, 5, 2.0, 0.0, 0.9)]
    got = found(per.periods(spark.createDataFrame(rows, MEASURED), **SETTINGS))
    assert got == {(5, 5): (2.0, 6.0, 0.8, 3, 3)}


def test_measurements_that_do_not_count(spark):
    nan = float("nan")
    good = [(5, 5, d, 0.0, 0.9) for d in (2.0, 8.0)]
    for bad in ((5, 5, 14.0, 0.2, 0.9), (5, 5, 14.0, 0.0, 0.1), (5, 5, None, 0.0, 0.9), (5, 5, float("inf"), 0.0, 0.9), (5, 5, nan, 0.0, 0.9), (5, 5, 14.0, None, 0.9), (5, 5, 14.0, 0.0, nan), (None, 5, 14.0, 0.0, 0.9), (7, 5, 14.0, 0.0, 0.9)):
        assert found(per.periods(spark.createDataFrame([*good, bad], MEASURED), **SETTINGS)) == {}
    assert found(per.periods(spark.createDataFrame([], MEASURED), **SETTINGS)) == {}


SF = "/root/testdata/sf0.001"


def test_queries_on_the_tables(spark):
    rows = [tuple(r) for r in plan.seeds(plan._tiles(spark, SF)).select("scene", "tile", "x", "y", "disparity", "strength").collect()]
    want = walked(rows, 1.5, 4.0, 3.0)
    got = plan.pole_clusters(spark, SF).collect()
    assert {(r["scene"], r["cluster"]): r["n_tiles"] for r in got} == {(s, c): sum(v == c for k, v in want.items() if k[0] == s) for (s, _), c in want.items()}
    rows = [tuple(r) for r in meas(spark, SF).select("x", "y", "target", "resid", "strength").collect()]
    want = plain_periods(rows, trusted=0.05, floor=0.1, over=0.3, join=1.0, apart=4.0, repeats=2, tolerance=1.0)
    assert found(plan.periodic_tiles(spark, SF)) == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def long_scene(n=2500, width=6):
    rng = np.random.default_rng(8)
    return [(1, t, t % width, t // width, float(rng.choice([3.0, 3.5, 9.0])), float(rng.uniform(0.1, 1))) for t in range(0, n) if rng.random() < 0.6]


def test_a_long_dense_scene_streams_through_its_walk(spark):
    rows = long_scene()
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "100")  # state goes on from one batch to the next
    try:
        seeds = spark.createDataFrame(rows, SEED)
        found = poles.first_fit(seeds, 1.5, 4.0, 1.0)
        assert {k: v[0] for k, v in as_dict(found, "cluster").items()} == walked(rows, 1.5, 4.0, 1.0)
        boxes = poles.boxes(seeds, found, 1, 1, 3).localCheckpoint()
        for df in (found, poles.merged(boxes, 0.5), poles.layered(boxes)):
            assert "FlatMapGroupsInPandas" not in plan_of(df) and "MapInArrow" in plan_of(df)
        given, layer = {r["cluster"]: r for r in boxes.collect()}, as_dict(poles.layered(boxes), "layer")
        by = {}
        for (_, c), (k,) in layer.items():
            by.setdefault(k, []).append(given[c])
        cross = lambda a, b: a["left"] <= b["right"] and b["left"] <= a["right"] and a["top"] <= b["bottom"] and b["top"] <= a["bottom"]
        assert not any(cross(a, b) for rows in by.values() for i, a in enumerate(rows) for b in rows[:i])
        assert poles.merged(boxes, 0.5).agg({"n_tiles": "sum"}).first()[0] == len(rows)
    finally:
        spark.conf.set(batch, before)


def test_boxes_meet_only_the_stretches_that_they_reach(spark):
    rows = [(1, x, y, (1.0, 0.3, 0.1, 0.3, 1.0)[x]) for x in range(5) for y in range(-20, 200)]
    boxes = spark.createDataFrame([(1, 7, 0, 4, -9, 30), (1, 8, 0, 4, 90, 91)], "scene long, cluster long, left long, right long, top long, bottom long")
    found = poles.cuts(boxes, spark.createDataFrame(rows, "scene long, x long, y long, strength double"), 2, False)
    assert {r["cluster"]: r["cut"] for r in found.collect()} == {7: 3, 8: 3}
    assert "part#" in plan_of(found)
