"""Lapped transforms: reconstruction at blocks' edges, plain loops, shifts of moved tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import lapped


def image_rows(images):
    return [(k, x, y, float(v)) for k, image in enumerate(images) for (y, x), v in np.ndenumerate(image)]


def whole(df, n=256):
    return {(r[0], r["ty"], r["tx"]): np.array(r["clt"]) for r in df.collect()}


@pytest.mark.parametrize("kind", ["flat", "sine", "steep"])
def test_reconstruction(spark, kind):
    """Two images larger than a block, not a multiple of the tile's size: every covered pixel comes back."""
    rng = np.random.default_rng(1)
    images = rng.standard_normal((2, 83, 150))
    df = spark.createDataFrame(image_rows(images), "image long, x long, y long, v double").repartition(5)
    tiles = lapped.transformed(df, "image", 150, 83, kind)
    assert tiles.count() == 2 * 17 * 9
    got = lapped.restored(tiles, "image", 150, 83, kind).collect()
    assert len(got) == 2 * (8 * 17 - 8) * (8 * 9 - 8)
    assert max(abs(r["v"] - images[r["image"], r["y"], r["x"]]) for r in got) < 1e-12


def test_transform_against_loops(spark):
    rng = np.random.default_rng(2)
    image = rng.standard_normal((24, 32))
    df = spark.createDataFrame(image_rows([image]) + [(0, 40, 3, 1.0), (0, -1, 3, 1.0)], "image long, x long, y long, v double")
    tiles = whole(lapped.transformed(df.where("not (x = 5 and y = 6)").union(spark.createDataFrame([(0, 5, 6, None)], df.schema)), "image", 32, 24))
    image[6, 5] = 0
    assert set(tiles) == {(0, y, x) for y in range(2) for x in range(3)}
    w = np.sin(np.pi / 16 * (np.arange(16) + 0.5))
    for ty, tx in ((0, 0), (1, 2)):
        for q, (down, across) in enumerate(((np.cos, np.cos), (np.cos, np.sin), (np.sin, np.cos), (np.sin, np.sin))):
            for k, m in ((0, 0), (3, 5), (7, 2)):
                want = sum(0.25 * w[i] * w[j] * image[8 * ty + i, 8 * tx + j] * down(np.pi / 8 * (i + 4.5) * (k + 0.5)) * across(np.pi / 8 * (j + 4.5) * (m + 0.5)) for i in range(16) for j in range(16))
                assert tiles[0, ty, tx][64 * q + 8 * k + m] == pytest.approx(want, abs=1e-12)


def test_product_is_conjugate_times():
    """Both units apart are complex numbers."""
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((2, 5, 4, 64))
    for used, other in (((0, 1), (2, 3)), ((0, 2), (1, 3))):
        x, y = a.copy(), b.copy()
        x[:, other], y[:, other] = 0, 0
        want = np.conj(x[:, used[0]] + 1j * x[:, used[1]]) * (y[:, used[0]] + 1j * y[:, used[1]])
        got = lapped.product(x, y)
        assert np.allclose(got[:, used[0]], want.real) and np.allclose(got[:, used[1]], want.imag) and np.allclose(got[:, other], 0)


def smooth(rng, n):
    f = np.fft.fftfreq(n)
    return np.fft.ifft2(np.fft.fft2(rng.standard_normal((n, n))) * np.exp(-40 * (f[:, None] ** 2 + f[None, :] ** 2))).real


@pytest.mark.parametrize("move", [(0, 0), (2, 0), (-1, 3), (1, -2)])
def test_shift_of_a_moved_image(spark, move):
    dx, dy = move
    image = smooth(np.random.default_rng(4), 64)
    df = spark.createDataFrame(image_rows([image, np.roll(image, (dy, dx), (0, 1))]), "image long, x long, y long, v double")
    t = lapped.transformed(df, "image", 64, 64)
    both = t.where("image = 0").select("ty", "tx", F.col("clt").alias("a")).join(t.where("image = 1").select("ty", "tx", F.col("clt").alias("b")), ["ty", "tx"])
    got = both.select(lapped.by_shift(lapped.correlated(F.col("a"), F.col("b"), 0.1)).alias("c")).collect()
    mean = np.mean([r["c"] for r in got], axis=0).reshape(15, 15)
    assert np.unravel_index(mean.argmax(), mean.shape) == (dy + 7, dx + 7)


def test_equal_tiles_and_nulls(spark):
    rng = np.random.default_rng(5)
    t = rng.standard_normal(256).tolist()
    df = spark.createDataFrame([(0, t, t), (1, None, t), (2, t, t[:7]), (3, [0.0] * 256, [0.0] * 256)], "k int, a array<double>, b array<double>")
    got = {r["k"]: r["c"] for r in df.select("k", lapped.by_shift(lapped.correlated(F.col("a"), F.col("b"), 0.0)).alias("c")).collect()}
    assert got[1] is None and got[2] is None and got[3] == [0.0] * 225
    assert np.argmax(got[0]) == 112


def test_turned_by_a_shift(spark):
    """Turning by a shift and correlating with the tile gives the shift back; turning back restores."""
    rng = np.random.default_rng(6)
    t = rng.standard_normal(256).tolist()
    df = spark.createDataFrame([(t, 3.0, -2.0), (t, None, 1.0)], "t array<double>, x double, y double")
    moved = df.withColumn("m", lapped.shifted(F.col("t"), F.col("x"), F.col("y")))
    rows = moved.select(lapped.by_shift(lapped.correlated(F.col("t"), F.col("m"), 0.0)).alias("c"), lapped.shifted(F.col("m"), -F.col("x"), -F.col("y")).alias("back")).collect()
    assert np.unravel_index(np.argmax(rows[0]["c"]), (15, 15)) == (5, 10) and np.allclose(rows[0]["back"], t)
    assert rows[1]["c"] is None and rows[1]["back"] is None


def test_slices_keep_what_is_computed_at_once_small(spark):
    """A batch of any size is transformed and restored in slices."""
    import pyarrow as pa

    from tessella.shared import sliced, small_batches

    batch = pa.RecordBatch.from_pydict({"a": list(range(1000))})
    got = list(sliced([batch, batch.slice(0, 0)], 64))
    assert max(b.num_rows for b in got) == 64 and [v for b in got for v in b["a"].to_pylist()] == list(range(1000))
    small_batches(spark)
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
