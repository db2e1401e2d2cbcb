"""Fits against numpy on small groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import fits


def test_plane_recovers_its_tilts(spark):
    rows = [(float(x), float(y), 1.0 + x * y, 3 + 0.5 * x - 0.25 * y) for x in range(5) for y in range(4)]
    df = spark.createDataFrame(rows, "x double, y double, w double, v double")
    v, tx, ty = fits.plane_of()
    m = df.agg(*(c.alias(k) for k, c in fits.plane_moments(F.col("w"), F.col("x"), F.col("y"), F.col("v")).items()))
    r = m.select(v.alias("v"), tx.alias("tx"), ty.alias("ty")).first()
    assert r["tx"] == pytest.approx(0.5) and r["ty"] == pytest.approx(-0.25)


def test_samples_on_a_line_have_no_tilt(spark):
    df = spark.createDataFrame([(float(k), float(k), 1.0, float(k)) for k in range(4)], "x double, y double, w double, v double")
    m = df.agg(*(c.alias(k) for k, c in fits.plane_moments(F.col("w"), F.col("x"), F.col("y"), F.col("v")).items()))
    r = m.select(*(c.alias(n) for c, n in zip(fits.plane_of(), ("v", "tx", "ty"), strict=True))).first()
    assert (r["v"], r["tx"], r["ty"]) == (1.5, None, None)


def test_fill_reaches_a_hole(spark):
    tiles = [(x, y, None if (x, y) == (2, 2) else 7.0) for x in range(5) for y in range(5)]
    got = fits.fill_and_smooth(spark.createDataFrame(tiles, "x long, y long, value double"), 0.5, 2)
    assert {round(r["value"], 9) for r in got.collect()} == {7.0}


def test_trimmed_mean_drops_the_outlier(spark):
    rows = [(1, v, 1.0) for v in (1.0, 1.1, 0.9, 50.0)] + [(2, 1.0, 1.0)] + [(3, v, 1.0) for v in (0.0, 10.0, 20.0)] + [(4, None, 1.0)]
    got = fits.trimmed_means(spark.createDataFrame(rows, "g int, value double, weight double"), ["g"], 3, 1.0).collect()
    assert [(r["g"], r["n"], round(r["mean"], 9)) for r in got] == [(1, 3, 1.0)]


def test_blur_keeps_a_constant_and_the_sum(spark):
    rows = [("a", k, 4.0) for k in range(9)] + [("b", k, 1.0 if k == 10 else 0.0) for k in range(21)]
    got = fits.blurred(spark.createDataFrame(rows, "line string, at int, value double"), 1.0, ["line"]).collect()
    assert all(r["value"] == pytest.approx(4.0) for r in got if r["line"] == "a")
    assert sum(r["value"] for r in got if r["line"] == "b") == pytest.approx(1.0)


def test_principal_plane(spark):
    rng = np.random.default_rng(0)
    rows = [(1, float(x), float(y), float(0.1 * x + 2), 1.0) for x, y in rng.uniform(-5, 5, (50, 2))]
    r = fits.principal_planes(spark.createDataFrame(rows, "g int, x double, y double, z double, weight double"), ["g"]).first()
    want = np.array([-0.1, 0, 1]) / np.sqrt(1.01)
    assert np.allclose([r["nx"], r["ny"], r["nz"]], want, atol=1e-6) and r["flatness"] < 1e-9


def test_focus_curve(spark):
    z = np.linspace(-4, 4, 15)
    rows = [(1, float(x), float(np.hypot(1.5, 0.8 * (x - 0.7)))) for x in z] + [(2, 0.0, 1.0), (2, 1.0, None)]
    got = fits.focus_curves(spark.createDataFrame(rows, "g int, z double, width double"), ["g"]).collect()
    assert len(got) == 1 and got[0]["n"] == 15
    assert [got[0]["z0"], got[0]["least"], got[0]["slope"]] == pytest.approx([0.7, 1.5, 0.8], abs=1e-4)
