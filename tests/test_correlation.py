"""Frequency-domain operators against direct computation."""

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import correlation


def frame(spark, *tiles):
    return spark.createDataFrame([tuple(None if t is None else [float(x) for x in t.ravel()] for t in tiles)], ", ".join(f"t{k} array<double>" for k in range(len(tiles))))


def test_phase_correlation_finds_the_shift(spark):
    a = np.random.default_rng(0).standard_normal((16, 16))
    b = np.roll(a, (3, -2), (0, 1))
    got = np.array(frame(spark, a, b).select(correlation.correlated(F.col("t0"), F.col("t1"), 1.0, 0.01).alias("c")).first()["c"]).reshape(16, 16)
    assert np.unravel_index(got.argmax(), got.shape) == (3, 14)


def test_shift_there_and_back(spark):
    a = np.random.default_rng(1).standard_normal((8, 8))
    df = frame(spark, a)
    whole = np.array(df.select(correlation.shifted(F.col("t0"), F.lit(1.0), F.lit(2.0)).alias("c")).first()["c"]).reshape(8, 8)
    assert np.allclose(whole, np.roll(a, (2, 1), (0, 1)))


def test_convolution_and_low_pass(spark):
    a, one = np.random.default_rng(2).standard_normal((8, 8)), np.zeros((8, 8))
    one[0, 0] = 1
    df = frame(spark, a, one)
    r = df.select(correlation.convolved(F.col("t0"), F.col("t1")).alias("c"), correlation.low_passed(F.col("t0"), 0.01).alias("l")).first()
    assert np.allclose(np.array(r["c"]), a.ravel()) and np.allclose(np.array(r["l"]), a.mean(), atol=1e-6)


def test_missing_tiles_stay_missing(spark):
    df = frame(spark, np.ones((2, 2)), None)
    assert df.select(correlation.correlated(F.col("t0"), F.col("t1")).alias("c")).first()["c"] is None
