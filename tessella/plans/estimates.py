"""Queries that fit models: one for each tile, or one over all rows. Iterative fits have no SQL: tests hold them against plain ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lapped, marquardt
from ..shared import checkpointed
from .lapping import WIDTH, _images
from .views import MEAS, meas

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


PAIRS, COLUMNS = 6, ["x", "y", "scale", "pair", "diagonal"]
#: What draws w and wxy to 0.
PULL = [0.0, 0.001, 0.001] + [0.0] * PAIRS


def peak_samples(spark, sf_dir) -> DataFrame:
    """Correlations of neighbouring images within three pixels of no shift, where they are above 0, weighted by themselves."""
    pixels, height = _images(spark, sf_dir)
    t = lapped.transformed(pixels, "image", WIDTH, height)
    both = t.withColumnRenamed("clt", "first").join(t.select((F.col("image") - 1).alias("image"), "ty", "tx", F.col("clt").alias("second")), ["image", "ty", "tx"])
    fit = lapped.by_shift(lapped.correlated(F.col("first"), F.col("second"), 0.1))
    s = both.select("ty", "tx", (F.col("image") - 1).cast("double").alias("pair"), F.posexplode(fit).alias("place", "value"))
    x, y = (F.col("place") % 15 - 7).cast("double"), (F.floor(F.col("place") / 15) - 7).cast("double")
    s = s.select("ty", "tx", x.alias("x"), y.alias("y"), F.lit(1.0).alias("scale"), "pair", F.lit(0.0).alias("diagonal"), "value", F.col("value").alias("weight"))
    return s.where("abs(x) <= 3 and abs(y) <= 3 and value > 0")


def peak_start():
    return F.array(F.lit(0.0), F.lit(4.0), F.lit(0.0), *(F.coalesce(F.max(F.when(F.col("pair") == k, F.col("value"))), F.lit(0.1)) for k in range(PAIRS)))


@query(None)
def peak_fits(spark, sf_dir):
    """The common peak of each tile's correlations: centre, widths, amplitudes, and how the fit went."""
    found = marquardt.fit_groups(peak_samples(spark, sf_dir), ["ty", "tx"], marquardt.peak_model(PAIRS), COLUMNS, peak_start(), pull=PULL)
    p = lambda k, name: F.round(F.get("parameters", F.lit(k)), 6).alias(name)
    return found.select("ty", "tx", p(0, "x0"), p(1, "w"), p(2, "wxy"), F.transform(F.slice("parameters", 4, PAIRS), lambda a: F.round(a, 6)).alias("amplitudes"), F.round("rms", 6).alias("rms"), F.round("first_rms", 6).alias("first_rms"), "steps", "success")


CHANNELS = 7
#: Focus and tilts of the field, then slope, least blur and shift of each channel: what joint_focus is to find again.
FIELD = [25.0, 0.02, -0.01] + [v for c in range(CHANNELS) for v in (0.3 + 0.02 * c, 2.0 - 0.1 * c, 0.5 * c)]
FIRST = [20.0, 0.0, 0.0] + [0.25, 1.5, 0.0] * CHANNELS
FREE = [True] * 5 + [False] + [True] * (3 * CHANNELS - 3)


def focus_samples(spark, sf_dir) -> DataFrame:
    """Blur over the field by focus position, with resid for noise."""
    m = meas(spark, sf_dir).select(F.col("target").cast("double").alias("z"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (F.col("pass_id") - 1).cast("double").alias("channel"), "resid")
    of = lambda k: F.get(F.array(*(F.lit(v) for v in FIELD[3 + k :: 3])), F.col("channel").cast("int"))
    away = F.col("z") - FIELD[0] - of(2) - FIELD[1] * F.col("x") - FIELD[2] * F.col("y")
    return m.select("z", "x", "y", "channel", (F.sqrt(F.pow(of(0) * away, 2) + F.pow(of(1), 2)) + F.col("resid")).alias("value"), F.lit(1.0).alias("weight"))


@query(None)
def joint_focus(spark, sf_dir):
    """Focus, tilts and channels' curves of a whole field in one fit over all rows."""
    rows = checkpointed(focus_samples(spark, sf_dir))
    fit = marquardt.fit_all(rows, ["z", "x", "y", "channel"], marquardt.focus_model(CHANNELS), FIRST, free=FREE)
    names = ["z0", "tx", "ty"] + [f"{n}{c}" for c in range(CHANNELS) for n in ("slope", "least", "shift")]
    out = [(n, round(v, 6), round(s, 6), round(fit.rms, 6), fit.steps, fit.success) for n, v, s in zip(names, fit.parameters, fit.spread, strict=True)]
    return spark.createDataFrame(out, "parameter string, value double, spread double, rms double, steps long, success boolean")


@query(f"""WITH {MEAS}, s AS (SELECT sum(w) AS n, sum(w * a) AS a, sum(w * b) AS b, sum(w * a * a) AS aa, sum(w * a * b) AS ab, sum(w * b * b) AS bb, sum(w * v) AS v, sum(w * a * v) AS av, sum(w * b * v) AS bv FROM (SELECT strength AS a, target / 50 AS b, resid + 0.1 * strength AS v, 1 + n_tile % 3 AS w FROM meas)),
d AS (SELECT *, n * (aa * bb - ab * ab) - a * (a * bb - ab * b) + b * (a * ab - aa * b) AS det FROM s)
SELECT 'constant' AS parameter, round((v * (aa * bb - ab * ab) - a * (av * bb - ab * bv) + b * (av * ab - aa * bv)) / det, 6) AS value FROM d
UNION ALL SELECT 'strength', round((n * (av * bb - ab * bv) - v * (a * bb - ab * b) + b * (a * bv - av * b)) / det, 6) FROM d
UNION ALL SELECT 'target', round((n * (aa * bv - av * ab) - a * (a * bv - av * b) + v * (a * ab - aa * b)) / det, 6) FROM d""")
def linear_alignment(spark, sf_dir):
    """Weighted correction of residuals by a constant and two slopes, from normal equations that are summed where the rows are."""
    rows = meas(spark, sf_dir).select("strength", (F.col("target") / 50).alias("target"), (F.col("resid") + 0.1 * F.col("strength")).alias("value"), (1 + F.col("n_tile") % 3).cast("double").alias("weight"))
    found = marquardt.solved(rows, ["strength", "target"])
    return spark.createDataFrame([(n, round(v, 6)) for n, v in zip(("constant", "strength", "target"), found, strict=True)], "parameter string, value double")
