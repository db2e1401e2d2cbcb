"""Lenses: the inverse table, its ends, and both ways through the world."""

import math

import pytest
from pyspark.sql import functions as F

from tessella.operators import geometry as g


def test_table_inverts_the_lens():
    camera = g.Camera()
    table = g.reverse_table(camera)
    for k in (1, 10, 500, len(table) - 1):
        true = table[k] * k * camera.step
        assert true * g.ratio(camera, true) == pytest.approx(k * camera.step, abs=1e-10)
    assert g.ratio(camera, 1.0) == pytest.approx(1.0)


def test_table_ends_where_the_lens_folds():
    """A strong barrel: past the radius where the slope falls under a tenth nothing is known."""
    camera = g.Camera(coefficients=(0.0, -0.35), most=1.5)
    table = g.reverse_table(camera)
    bad = next(k for k, v in enumerate(table) if math.isnan(v))
    assert all(math.isnan(v) for v in table[bad:]) and not any(math.isnan(v) for v in table[:bad])
    true = table[bad - 1] * (bad - 1) * camera.step
    assert g.slope(camera, true) >= g.LEAST_SLOPE and g.slope(camera, true + 0.01) < g.LEAST_SLOPE + 0.05


def test_ends_of_the_table(spark):
    rows = [(-0.1,), (0.0,), (0.15,), (0.2,), (0.25,), (float("nan"),), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "r double").select(g.looked_up(F.col("r"), [1.0, 2.0, 4.0], 0.1)).collect()]
    assert got[1] == 1.0 and got[2] == pytest.approx(3.0) and got[6] is None
    assert all(math.isnan(got[k]) for k in (0, 3, 4, 5))


def test_there_and_back(spark):
    camera = g.Camera()
    rows = [(float(x), float(y), d) for x in range(20, 2592, 300) for y in range(20, 1936, 300) for d in (0.5, 3.0, -7.0)] + [(1296.0, 968.0, 2.0), (5.0, 5.0, 0.0), (None, 3.0, 1.0)]
    df = spark.createDataFrame(rows, "px double, py double, d double")
    for distorted in (True, False):
        w = g.world(camera, F.col("px"), F.col("py"), F.col("d"), distorted)
        df2 = df.select("*", *(v.alias(n) for v, n in zip(w, "xyz", strict=True)))
        back = g.image(camera, F.col("x"), F.col("y"), F.col("z"), distorted)
        for r in df2.select("*", *(v.alias(n) for v, n in zip(back, ("bd", "bx", "by"), strict=True))).collect():
            if r["d"] == 0 or r["px"] is None:
                assert r["x"] is None
            elif not math.isnan(r["x"]):
                assert r["bd"] == pytest.approx(r["d"], abs=1e-9)
                assert (r["bx"], r["by"]) == pytest.approx((r["px"], r["py"]), abs=1e-6)


def test_plane_and_ports(spark):
    camera = g.Camera(width=2000, height=2000)
    df = spark.createDataFrame([(300.0, 1500.0, 4.0)], "px double, py double, d double")
    c = F.col
    w = g.world(camera, c("px"), c("py"), c("d"))
    # the plane through a place, square to its own direction, is met there
    assert df.select(g.plane_disparity(camera, w, c("px"), c("py"))).first()[0] == pytest.approx(4.0, abs=1e-9)
    assert df.select(g.plane_disparity(camera, (F.lit(0.0),) * 3, c("px"), c("py"))).first()[0] is None
    still = df.select(*(v for p in g.port_pixels(camera, c("px"), c("py"), F.lit(0.0)) for v in p)).first()
    assert tuple(still) == pytest.approx((300.0, 1500.0) * 4, abs=1e-3)
    moved = df.select(*(v for p in g.port_pixels(camera, c("px"), c("py"), c("d")) for v in p)).first()
    assert moved[0] > 300 > moved[2] and moved[1] > 1500 > moved[5]


def test_turns(spark):
    df = spark.createDataFrame([(1.0, 2.0, -5.0)], "x double, y double, z double")
    place = (F.col("x"), F.col("y"), F.col("z"))
    got = df.select(*g.rotated(place, 0.1, -0.2, 0.3)).first()
    assert sum(v * v for v in got) == pytest.approx(30.0)
    assert tuple(df.select(*g.rotated(place, 0.0, 0.0, math.pi / 2, 1.0)).first()) == pytest.approx((4.0, -2.0, -5.0))
