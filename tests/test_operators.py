"""Hand-made cases: holes, ties, unknown targets, empty input, files and round trips."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import scalars, signal
from tessella.operators import grid, passes, sequence
from tessella.sources import files, sinks


def cells(spark, picture):
    rows = [(x, y) for y, line in enumerate(picture) for x, c in enumerate(line) if c == "#"]
    return spark.createDataFrame(rows, "x long, y long")


def drawn(df):
    return {(r["x"], r["y"]) for r in df.collect()}


def test_grow_and_shrink(spark):
    everything = cells(spark, ["#####"] * 5)
    one = cells(spark, [".....", ".....", "..#.."])
    assert len(drawn(grid.grow(one, 2, everything))) == 9
    assert len(drawn(grid.grow(one, 1, everything))) == 5
    assert len(drawn(grid.grow(one, 0, everything))) == 1
    hole = cells(spark, ["#####", "#####", "##.##", "#####", "#####"])
    assert len(drawn(grid.shrink(hole, 2, everything))) == 16
    assert drawn(grid.shrink(everything, 2, everything)) == drawn(everything)  # the outside doesn't erode
    assert drawn(grid.grow(one.limit(0), 2, everything)) == set()


def test_clusters_by_connectivity(spark):
    diagonal = cells(spark, ["##..", "##..", "..##", "..##"])
    assert grid.clusters(diagonal).select("cluster").distinct().count() == 2
    assert grid.clusters(diagonal, grid.RING8).select("cluster").distinct().count() == 1
    snake = spark.createDataFrame([(k, 0) for k in range(70)], "x long, y long")
    assert {r["cluster"] for r in grid.clusters(snake).collect()} == {0}


def test_core(spark):
    shape = cells(spark, ["###.", "###.", "###.", "...#"])
    assert drawn(grid.prune_few_neighbours(shape, 3)) == drawn(cells(spark, ["###", "###", "###"]))
    line = cells(spark, ["######"])
    assert drawn(grid.prune_few_neighbours(line, 2)) == set()


def test_composite_ties_and_weak_tiles(spark):
    rows = [(1, 1, 10.0, 0.2, 0.9, 1), (1, 2, 20.0, -0.2, 0.9, 1), (2, 1, 5.0, 0.0, 0.1, 1), (2, 2, 6.0, 0.3, 0.2, 1), (3, 1, 7.0, None, 0.1, 1)]
    m = spark.createDataFrame(rows, "n_tile long, pass_id int, target double, resid double, strength double, src long")
    got = {r["n_tile"]: r for r in passes.composite(m, 0.5).collect()}
    assert (got[1]["pass_id"], got[1]["is_strong"]) == (1, True) and got[1]["disparity"] == pytest.approx(10 + 0.2 / 0.85)
    assert (got[2]["pass_id"], got[2]["is_strong"]) == (2, False) and got[3]["disparity"] is None


def test_unknown_target_closes_a_tile(spark):
    c = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 5.0), (4, -1.0)], "n_tile long, target double")
    m = spark.createDataFrame([(1, None), (2, 5.5), (3, 9.0)], "n_tile long, target double")
    assert {r["n_tile"] for r in passes.unique(c, m, 1, 50).collect()} == {3}


def test_as_of_takes_the_last_at_or_before(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 5, 2), (2, 1, 3)], "k int, t int, id int")
    b = spark.createDataFrame([(1, 5, 7, "x"), (1, 10, 8, "y"), (1, 11, 9, "z")], "k int, t int, id int, v string")
    got = {r["id"]: r["v"] for r in sequence.latest_before(a, b, ["k"], "t", ["v"], ["id"]).collect()}
    assert got == {1: "y", 2: "x", 3: None}


@pytest.mark.parametrize("basis", [signal.dct_basis(2), signal.dct_basis(4), signal.dst_basis()])
def test_transforms_are_orthonormal(spark, basis):
    b = np.array(basis)
    assert np.allclose(b @ b.T, np.eye(8))
    tile = [float(x) for x in np.random.default_rng(0).standard_normal(64)]
    df = spark.createDataFrame([(tile,)], "tile array<double>")
    once = signal.applied(F.col("tile"), basis, basis)
    back = signal.applied(once, b.T.tolist(), b.T.tolist())
    assert np.allclose(df.select(back.alias("b")).first()["b"], tile)


def test_mosaic_unpacking(spark):
    mosaic = [[y * 16 + x for x in range(16)] for y in range(16)]
    block = [float(mosaic[2 * r + (n >> 1)][2 * c + (n & 1)]) for n in range(4) for r in range(8) for c in range(8)]
    got = spark.createDataFrame([(block,)], "b array<double>").select(signal.unpacked_mosaic(F.col("b")).alias("m")).first()["m"]
    assert got == [float(v) for row in mosaic for v in row]


def test_scalars(spark):
    df = spark.createDataFrame([("a-12.tiff", "1, 2,3"), ("b_7.jp4", "4 5"), ("c.jp4", "6")], "n string, l string")
    got = df.select(scalars.channel_of(F.col("n")).alias("c"), scalars.numbers(F.col("l")).alias("v")).collect()
    assert [r["c"] for r in got] == [12, 7, None] and [r["v"] for r in got] == [[1.0, 2.0, 3.0], [4.0, 5.0], [6.0]]


def tiff(pixels, order):
    h, w = pixels.shape
    data = pixels.astype(order + "f4").tobytes()
    fields = [(256, 4, w), (257, 4, h), (258, 3, 32), (259, 3, 1), (273, 4, 8), (278, 4, h), (279, 4, len(data)), (339, 3, 3)]
    entries = b"".join(struct.pack(order + "HHI", t, k, 1) + (struct.pack(order + "HH", v, 0) if k == 3 else struct.pack(order + "I", v)) for t, k, v in fields)
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8 + len(data)) + data + struct.pack(order + "H", len(fields)) + entries + b"\0" * 4


def test_image_files(spark, tmp_path):
    p = np.arange(12, dtype="f4").reshape(3, 4)
    p[1, 1] = np.nan
    (tmp_path / "a.tiff").write_bytes(tiff(p, "<"))
    (tmp_path / "b.tiff").write_bytes(tiff(p, ">"))
    (tmp_path / "c.tiff").write_bytes(b"nonsense")
    got = {r["path"][-6]: r for r in files.read_tiff(spark, f"{tmp_path}/*.tiff").collect()}
    for k in "ab":
        assert (got[k]["width"], got[k]["height"]) == (4, 3) and np.array_equal(np.array(got[k]["pixels"], "f4"), p.ravel(), equal_nan=True)
    assert got["c"]["pixels"] is None and "not a TIFF" in got["c"]["error"]
    each = files.pixels_of(files.read_tiff(spark, f"{tmp_path}/a.tiff"))
    assert each.where("v is null").select("x", "y").collect() == [(1, 1)] and each.count() == 12
    (tmp_path / "r.raw").write_bytes(p.astype("<f4").tobytes())
    assert files.read_raw_float(spark, f"{tmp_path}/r.raw", 4).first()["height"] == 3
    assert files.read_raw_float(spark, f"{tmp_path}/r.raw", 5).first()["error"]


def test_calibration_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", 2.5)], "name string, timestamp double")
    sinks.write_calibration_xml(df, f"{tmp_path}/x", "file", "calibration")
    assert sorted(map(tuple, files.read_calibration_xml(spark, f"{tmp_path}/x", "file").select("name", "timestamp").collect())) == [("a", 1.5), ("b", 2.5)]


def test_camera_parameters(spark):
    p = spark.createDataFrame([("P.0_subCamera_3.azimuth", "1.5"), ("P.width", "5")], "key string, value string")
    assert list(map(tuple, files.camera_parameters(p).collect())) == [(0, 3, "azimuth", "1.5")]


def test_mesh_counts_across_clusters(spark, tmp_path):
    v = spark.createDataFrame([(c, k, 0.0, 1.0, float(k)) for c in range(3) for k in range(3)], "cluster int, k int, x double, y double, z double")
    f = spark.createDataFrame([(c, 0, 1, 2) for c in range(3)], "cluster int, a int, b int, c int")
    sinks.write_mesh(sinks.mesh_lines(v, f), f"{tmp_path}/m", 2)
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/m").collect()]
    assert len(lines) == 12 and {"f 1 2 3", "f 4 5 6", "f 7 8 9"} <= set(lines)


def test_closing_and_poison(spark):
    everything = cells(spark, ["#" * 11] * 11)
    ring = cells(spark, ["." * 11] * 4 + ["...#####...", "...##.##...", "...#####..."] + ["." * 11] * 4)
    assert len(drawn(grid.closed(ring, 2, everything))) == 15
    hole = spark.createDataFrame([(5, 5)], "x long, y long")
    assert drawn(grid.closed(ring, 2, everything, hole)) == drawn(ring)


def test_spread_stops_at_steps(spark):
    tiles = spark.createDataFrame([(k, 0, float(k if k < 6 else k + 5)) for k in range(12)], "x long, y long, value double")
    seeds = tiles.where("x = 2")
    assert sorted(x for x, _ in drawn(grid.spread(seeds, tiles, 1.0, 0.0))) == [0, 1, 2, 3, 4, 5]
    assert drawn(grid.spread(seeds.limit(0), tiles, 1.0, 0.0)) == set()


def test_small_clusters(spark):
    tiles = spark.createDataFrame([(0, 0, 1.0), (1, 0, 1.0), (5, 5, 9.0)], "x long, y long, weight double")
    assert len(drawn(grid.without_small_clusters(tiles, 2))) == 2
    assert len(drawn(grid.without_small_clusters(tiles, 1, 5.0))) == 1


def test_streams_of_many_unordered_files(spark, tmp_path):
    from tessella.plans import streams

    rows = [(k, k % 2, f"2024-0{1 + 5 * (k // 2 % 2)}-01 00:{k:02d}:00", "click" if k % 4 < 2 else "view", float(k)) for k in range(12)]
    rows += [(100 + k, 0, f"2024-0{m}-02 00:{k:02d}:00", kind, 1.0) for m in (1, 6) for k, kind in ((2 * m, "click"), (2 * m + 1, "view"))]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    folder = str(tmp_path)
    for month in (6, 1):  # the later rows are written first, as part files of one folder
        events.where(F.month("ts") == month).repartition(3).write.mode("append").parquet(f"{folder}/events.parquet")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(streams.stream_without_repeats(spark, folder)) == key(events.select("user_id", "event_id", "value").distinct())
    a, b = events.where("event_type = 'click'").alias("a"), events.where("event_type = 'view'").alias("b")
    pairs = a.join(b, F.expr("a.user_id = b.user_id and b.ts between a.ts - interval 1 hour and a.ts + interval 1 hour"))
    assert key(streams.stream_alignment(spark, folder)) == key(pairs.select("a.user_id", "a.event_id", "b.event_id")) != []
    averages = events.groupBy("user_id", F.to_date("ts")).agg(F.count("*").alias("n"))
    assert sorted(r["n"] for r in streams.stream_window_average(spark, folder).collect()) == sorted(r["n"] for r in averages.collect())


def test_clusters_left_of_and_above_the_origin(spark):
    got = grid.clusters(spark.createDataFrame([(-1, -1), (0, -1), (0, 0), (5, -3), (-7, 2)], "x long, y long")).collect()
    assert {(r["x"], r["y"]) for r in got} == {(-1, -1), (0, -1), (0, 0), (5, -3), (-7, 2)}
    assert len({r["cluster"] for r in got}) == 3


def test_transform_of_tiles_without_64_values(spark):
    basis = signal.dct_basis(2)
    rows = [(0, None), (1, [1.0] * 63), (2, [1.0] * 64), (3, [])]
    got = {r["i"]: r["v"] for r in spark.createDataFrame(rows, "i int, t array<double>").select("i", signal.applied(F.col("t"), basis, basis).alias("v")).collect()}
    assert got[0] is None and got[1] is None and got[3] is None
    assert np.allclose(got[2], [8.0] + [0.0] * 63)
    none = spark.createDataFrame([], "t array<double>").select(signal.applied(F.col("t"), basis, basis).alias("v"))
    assert none.collect() == []


def test_mesh_numbers_over_many_ranges(spark):
    sizes = {c: c % 3 + 1 for c in range(60)}
    v = spark.createDataFrame([(c, k, 0.0, 0.0, 0.0) for c, n in sizes.items() for k in range(n)], "cluster long, k long, x double, y double, z double")
    f = spark.createDataFrame([(c, 0, 0, 0) for c in sizes], "cluster long, a long, b long, c long")
    lines = sinks.mesh_lines(v, f).orderBy("part", "cluster", "number").collect()
    assert [r["number"] for r in lines if r["part"] == 0] == list(range(1, sum(sizes.values()) + 1))
    firsts = [1 + sum(sizes[d] for d in range(c)) for c in range(60)]
    assert [r["number"] for r in lines if r["part"] == 1] == firsts


def test_nearest_calibration_over_many_blocks(spark, monkeypatch):
    import os

    from tessella import registry
    from tessella.plans import surfaces

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    whole = registry.queries()["nearest_calibration"](spark, sf).collect()
    monkeypatch.setattr(surfaces, "BLOCK", 2)
    assert sorted(registry.queries()["nearest_calibration"](spark, sf).collect()) == sorted(whole)


def test_clusters_broadcast_nothing(spark):
    tiles = spark.createDataFrame([(x, y, 1.0) for x in range(6) for y in range(6) if (x * y) % 3], "x long, y long, weight double")
    for df in (grid.clusters(tiles), grid.without_small_clusters(tiles, 2)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_trusted_density_sorts_no_spirals(spark):
    from tessella.plans import candidates

    plan = candidates.trusted_density(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
