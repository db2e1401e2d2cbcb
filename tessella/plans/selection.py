"""Queries on measurements: pass algebra, filters, histograms, robust statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import grid, passes
from .views import MEAS, TILE, meas, tile

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Register a query with its SQL."""

    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {MEAS}, b AS (SELECT least(greatest(floor((target - 1) / 5), 0), 9)::INT AS dbin, least(floor(strength / 0.1), 7)::INT AS sbin, resid, strength FROM meas WHERE strength > 0),
g AS (SELECT dbin, sbin, count(*) AS n, round(sqrt(sum(strength * resid * resid) / sum(strength)), 6) AS rms FROM b GROUP BY dbin, sbin)
SELECT dbin, sbin, n, rms, (sum(n) OVER (ORDER BY dbin, sbin))::BIGINT AS running FROM g""")
def dsi_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-dimensional histogram of disparity and strength with a weighted RMS and a running total."""
    b = meas(spark, sf_dir).where("strength > 0").select(
        F.least(F.greatest(F.floor((F.col("target") - 1) / 5), F.lit(0)), F.lit(9)).cast("int").alias("dbin"),
        F.least(F.floor(F.col("strength") / 0.1), F.lit(7)).cast("int").alias("sbin"), "resid", "strength",
    )
    g = b.groupBy("dbin", "sbin").agg(F.count("*").alias("n"), F.round(F.sqrt(F.sum(F.col("strength") * F.col("resid") * F.col("resid")) / F.sum("strength")), 6).alias("rms"))
    # at most 80 rows meet in the running total
    return g.withColumn("running", F.sum("n").over(Window.orderBy("dbin", "sbin")))


@query(f"""WITH {MEAS}, r AS (SELECT *, strength >= 0.4 AS ok,
  row_number() OVER (PARTITION BY n_tile, strength >= 0.4 ORDER BY abs(resid), pass_id, src, target) AS by_resid,
  row_number() OVER (PARTITION BY n_tile ORDER BY -strength, pass_id, src, target) AS by_strength, max(strength) OVER (PARTITION BY n_tile) >= 0.4 AS any_ok FROM meas)
SELECT n_tile, any_ok AS is_strong, pass_id, round(target + resid / 0.85, 6) AS disparity, strength FROM r WHERE (any_ok AND ok AND by_resid = 1) OR (NOT any_ok AND by_strength = 1)""")
def best_of_passes(spark, sf_dir):
    """Per tile the best of all passes."""
    return passes.composite(meas(spark, sf_dir), 0.4).withColumn("disparity", F.round("disparity", 6))


@query(f"""WITH {MEAS}, c AS (SELECT DISTINCT n_tile, target FROM meas WHERE pass_id = 7), m AS (SELECT n_tile, target FROM meas WHERE pass_id <= 3)
SELECT n_tile, target FROM c WHERE target > 0 AND target <= 45 AND NOT EXISTS (SELECT 1 FROM m WHERE m.n_tile = c.n_tile AND abs(c.target - m.target) < 2)""")
def unique_candidates(spark, sf_dir):
    """Proposed disparities that no pass has tried."""
    m = meas(spark, sf_dir)
    return passes.unique(m.where("pass_id = 7").select("n_tile", "target").distinct(), m.where("pass_id <= 3"), 2, 45)


@query(f"""WITH {MEAS}, c AS (SELECT DISTINCT n_tile, target AS wanted FROM meas WHERE pass_id = 7), m AS (SELECT n_tile, target FROM meas WHERE pass_id <= 3),
k AS (SELECT unnest([0, 1, 2, 3, 4, -1, -2, -3, -4]) AS k), o AS (SELECT n_tile, wanted, wanted + k * 3 AS target, CASE WHEN k >= 0 THEN k ELSE 4 - k END AS o FROM c, k),
f AS (SELECT n_tile, wanted, min_by(target, o) AS free FROM o WHERE target > 0 AND target <= 45 AND NOT EXISTS (SELECT 1 FROM m WHERE m.n_tile = o.n_tile AND abs(o.target - m.target) < 2) GROUP BY n_tile, wanted)
SELECT n_tile, wanted, free FROM c LEFT JOIN f USING (n_tile, wanted)""")
def next_free_disparity(spark, sf_dir):
    """The nearest untried disparity to each proposal, upwards first."""
    m = meas(spark, sf_dir)
    return passes.next_free(m.where("pass_id = 7").select("n_tile", "target").distinct(), m.where("pass_id <= 3"), 3, 4, 2, 45)


@query(f"WITH {MEAS} SELECT n_tile, max(target) FILTER (strength > 0.2) AS max_tried, max(pass_id) AS last_pass, max_by(target, (pass_id, src, target)) AS last_target FROM meas GROUP BY n_tile")
def max_tried_and_last(spark, sf_dir):
    """Largest disparity tried and the latest pass of each tile."""
    return meas(spark, sf_dir).groupBy("n_tile").agg(F.max(F.when(F.col("strength") > 0.2, F.col("target"))).alias("max_tried"), F.max("pass_id").alias("last_pass"), F.max_by("target", F.struct("pass_id", "src", "target")).alias("last_target"))


@query(f"WITH {MEAS} SELECT n_tile, max_by(pass_id, (strength, pass_id, src)) AS pass_id, max(strength) AS strength FROM meas WHERE pass_id < 6 GROUP BY n_tile")
def strongest_earlier_pass(spark, sf_dir):
    """The strongest pass before a given one; ties go to the later."""
    return meas(spark, sf_dir).where("pass_id < 6").groupBy("n_tile").agg(F.max_by("pass_id", F.struct("strength", "pass_id", "src")).alias("pass_id"), F.max("strength").alias("strength"))


@query(f"""WITH {MEAS}, o AS (SELECT n_tile, pass_id, src, target, strength, round(target + resid / 0.85, 6) AS refined FROM meas WHERE strength >= 0.5 AND abs(resid) >= 0.02),
f AS (SELECT o.*, row_number() OVER (PARTITION BY n_tile ORDER BY pass_id, src, target, refined) AS k FROM o
  WHERE NOT EXISTS (SELECT 1 FROM meas m WHERE m.n_tile = o.n_tile AND (abs(m.target - o.refined) < 0.01 OR (m.target > least(o.target, o.refined) AND m.target < greatest(o.target, o.refined)))))
SELECT n_tile, pass_id, target, refined FROM f WHERE k = 1""")
def refined_targets(spark, sf_dir):
    """Per tile the first strong measurement whose refined disparity is new: it moves far enough, and no
    other target lies near it or between."""
    m = meas(spark, sf_dir)
    o = m.where("strength >= 0.5 and abs(resid) >= 0.02").select("n_tile", "pass_id", "src", "target", F.round(F.col("target") + F.col("resid") / passes.GAIN, 6).alias("refined"))
    t = m.select(F.col("n_tile").alias("t"), F.col("target").alias("d"))
    taken = (F.col("n_tile") == F.col("t")) & ((F.abs(F.col("d") - F.col("refined")) < 0.01) | ((F.col("d") > F.least("target", "refined")) & (F.col("d") < F.greatest("target", "refined"))))
    best = o.join(t, taken, "left_anti").groupBy("n_tile").agg(F.min(F.struct("pass_id", "src", "target", "refined")).alias("r"))
    return best.select("n_tile", "r.pass_id", "r.target", "r.refined")


@query(f"""WITH {MEAS} SELECT n_tile, pass_id, src, target, strength, CASE WHEN abs(resid) > 0.04 OR price > 90000 THEN 0 ELSE strength END AS masked,
CASE pass_id % 4 WHEN 1 THEN round(target + resid / 0.85, 6) WHEN 2 THEN target WHEN 3 THEN resid ELSE round(target + resid, 6) END AS by_mode,
CASE WHEN strength > 0 AND target >= 10 THEN target END AS kept FROM meas""")
def masked_measurements(spark, sf_dir):
    """Strength without untrusted or overexposed measurements, disparity by mode, and a dense filter."""
    mode = F.col("pass_id") % 4
    return meas(spark, sf_dir).select(
        "n_tile", "pass_id", "src", "target", "strength",
        F.when((F.abs("resid") > 0.04) | (F.col("price") > 90000), 0.0).otherwise(F.col("strength")).alias("masked"),
        F.when(mode == 1, F.round(F.col("target") + F.col("resid") / passes.GAIN, 6)).when(mode == 2, F.col("target")).when(mode == 3, F.col("resid")).otherwise(F.round(F.col("target") + F.col("resid"), 6)).alias("by_mode"),
        F.when((F.col("strength") > 0) & (F.col("target") >= 10), F.col("target")).alias("kept"),
    )


@query(f"""WITH {TILE} SELECT n_tile, strength > 0 AND strength >= 0.5 AND disparity >= 40 AS near, strength >= 0.3 AND disparity < 40 AND disparity >= 20 AS lone_far,
(strength > 0 AND strength >= 0.5 AND disparity >= 40) OR (strength >= 0.3 AND disparity < 40 AND disparity >= 20 AND x % 2 = 0) AS combined FROM tile""")
def near_and_far_selections(spark, sf_dir):
    """Near objects, lone far ones, and near or (far and enabled)."""
    near = (F.col("strength") > 0) & (F.col("strength") >= 0.5) & (F.col("disparity") >= 40)
    far = (F.col("strength") >= 0.3) & (F.col("disparity") < 40) & (F.col("disparity") >= 20)
    return tile(spark, sf_dir).select("n_tile", near.alias("near"), far.alias("lone_far"), (near | (far & (F.col("x") % 2 == 0))).alias("combined"))


@query(f"""WITH {TILE} SELECT a.n_tile, count(*) AS friends FROM tile a JOIN tile b ON b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.n_tile <> a.n_tile
WHERE a.strength >= 0.4 AND a.disparity >= 20 AND abs(a.disparity - b.disparity) <= 1 + 0.05 * a.disparity AND b.strength >= 0.3 GROUP BY a.n_tile HAVING count(*) >= 3""")
def near_over_infinity(spark, sf_dir):
    """Tiles that enough neighbours agree with, within an absolute and a relative tolerance."""
    t = tile(spark, sf_dir)
    p = grid.pairs(t, ["disparity", "strength"]).join(t.select("x", "y", "n_tile", "disparity", "strength"), ["x", "y"])
    ok = (F.col("strength") >= 0.4) & (F.col("disparity") >= 20) & (F.abs(F.col("disparity") - F.col("n_disparity")) <= 1 + 0.05 * F.col("disparity")) & (F.col("n_strength") >= 0.3)
    return p.where(ok).groupBy("n_tile").agg(F.count("*").alias("friends")).where("friends >= 3")


@query(f"""WITH {TILE}, m AS (SELECT a.x, a.y, a.weakest AS s, max(b.weakest) AS top FROM tile a JOIN tile b ON b.x BETWEEN a.x - 2 AND a.x + 2 AND b.y BETWEEN a.y - 2 AND a.y + 2 AND b.n_tile <> a.n_tile GROUP BY ALL),
bad AS (SELECT x, y FROM m WHERE s >= 0.2 AND s < 0.5 AND top < 0.35 AND (top - 0.05) / (s - 0.05) <= 0.9)
SELECT n_tile, CASE WHEN EXISTS (SELECT 1 FROM bad WHERE abs(bad.x - tile.x) <= 2 AND abs(bad.y - tile.y) <= 2) THEN NULL ELSE disparity END AS disparity FROM tile""")
def without_false_matches(spark, sf_dir):
    """Blank the square around a tile that stands out of weak surroundings."""
    t = tile(spark, sf_dir)
    top = grid.window_pairs(t, ["weakest"], 2).groupBy("x", "y").agg(F.max("n_weakest").alias("top"))
    bad = t.join(top, ["x", "y"]).where("weakest >= 0.2 and weakest < 0.5 and top < 0.35 and (top - 0.05) / (weakest - 0.05) <= 0.9")
    square = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3)]
    blank = bad.select("x", "y", F.explode(grid.offsets(square)).alias("o")).select((F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y")).distinct().withColumn("blank", F.lit(True))
    return t.join(blank, ["x", "y"], "left").select("n_tile", F.when(F.col("blank").isNull(), F.col("disparity")).alias("disparity"))


@query(f"""WITH {TILE}, w AS (SELECT a.n_tile, sum(b.strength * b.disparity * d) / sum(b.strength * d) AS mean FROM (SELECT *, 1.0 AS one FROM tile) a JOIN
(SELECT *, 1.0 AS one FROM tile WHERE strength > 0) b ON b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.n_tile <> a.n_tile,
LATERAL (SELECT CASE WHEN a.x <> b.x AND a.y <> b.y THEN 0.7 ELSE 1.0 END AS d) GROUP BY a.n_tile)
SELECT tile.n_tile, round(CASE WHEN strength < 0.3 OR abs(disparity - mean) > 8 THEN coalesce(mean, 0) ELSE disparity END, 6) AS disparity FROM tile LEFT JOIN w USING (n_tile)""")
def smoothed_outliers(spark, sf_dir):
    """Weak or outlying tiles take the weighted mean of their neighbours, diagonal ones at 0.7."""
    t = tile(spark, sf_dir)
    # every tile asks, tiles of positive strength answer
    asked = t.select("x", "y", F.explode(grid.offsets(grid.RING8)).alias("o")).select("x", "y", "o.dx", "o.dy", (F.col("x") + F.col("o.dx")).alias("nx"), (F.col("y") + F.col("o.dy")).alias("ny"))
    answers = t.where("strength > 0").select(F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("disparity").alias("d"), F.col("strength").alias("s"))
    weight = F.col("s") * F.when((F.col("dx") != 0) & (F.col("dy") != 0), 0.7).otherwise(1.0)
    mean = asked.join(answers, ["nx", "ny"]).groupBy("x", "y").agg((F.sum(weight * F.col("d")) / F.sum(weight)).alias("mean"))
    replaced = F.when((F.col("strength") < 0.3) | (F.abs(F.col("disparity") - F.col("mean")) > 8), F.coalesce("mean", F.lit(0.0))).otherwise(F.col("disparity"))
    return t.join(mean, ["x", "y"], "left").select("n_tile", F.round(replaced, 6).alias("disparity"))


@query(f"""WITH {TILE}, s AS (SELECT sx, sy, least(floor(disparity / 10), 4)::INT AS bin, strength FROM tile, LATERAL (SELECT unnest([(x + 4) // 8 - 1, (x + 4) // 8]) AS sx), LATERAL (SELECT unnest([(y + 4) // 8 - 1, (y + 4) // 8]) AS sy) WHERE sx >= 0 AND sy >= 0)
SELECT sx, sy, bin, round(sum(strength) / sum(sum(strength)) OVER (PARTITION BY sx, sy), 6) AS share, round(sum(sum(strength)) OVER (PARTITION BY sx, sy), 4) AS strength FROM s WHERE strength > 0 GROUP BY sx, sy, bin""")
def supertile_histogram(spark, sf_dir):
    """Weighted histograms over windows of 16 x 16 tiles that overlap by half."""
    t = tile(spark, sf_dir).where("strength > 0")
    near = lambda c: F.expr(f"explode(array(({c} + 4) div 8 - 1, ({c} + 4) div 8))")
    s = t.select("y", "disparity", "strength", near("x").alias("sx")).select("sx", near("y").alias("sy"), F.least(F.floor(F.col("disparity") / 10), F.lit(4)).cast("int").alias("bin"), "strength").where("sx >= 0 and sy >= 0")
    g = s.groupBy("sx", "sy", "bin").agg(F.sum("strength").alias("w"))
    total = F.sum("w").over(Window.partitionBy("sx", "sy"))
    return g.select("sx", "sy", "bin", F.round(F.col("w") / total, 6).alias("share"), F.round(total, 4).alias("strength"))


@query(f"""WITH {MEAS} SELECT n_tile, count(*) AS n, round(sum(strength), 6) AS w,
round((sum(strength) * sum(strength * target * price) - sum(strength * target) * sum(strength * price)) / nullif(round(sum(strength) * sum(strength * target * target) - sum(strength * target) * sum(strength * target), 6), 0), 4) AS slope
FROM meas WHERE strength > 0 GROUP BY n_tile""")
def weighted_regression(spark, sf_dir):
    """Slope of a weighted linear fit per tile from moment sums; null where all x are equal."""
    w, x, y = F.col("strength"), F.col("target"), F.col("price")
    det = F.round(F.sum(w) * F.sum(w * x * x) - F.sum(w * x) * F.sum(w * x), 6)
    return meas(spark, sf_dir).where("strength > 0").groupBy("n_tile").agg(F.count("*").alias("n"), F.round(F.sum(w), 6).alias("w"), F.round((F.sum(w) * F.sum(w * x * y) - F.sum(w * x) * F.sum(w * y)) / F.nullif(det, F.lit(0.0)), 4).alias("slope"))


@query(f"""WITH {MEAS}, m AS (SELECT pass_id, x % 2 AS phase, avg(price) FILTER (price < 90000) AS mean FROM meas GROUP BY ALL)
SELECT pass_id, phase, round(mean, 4) AS mean, round((SELECT avg(mean) FROM m) / mean, 6) AS gain FROM m""")
def channel_gains(spark, sf_dir):
    """Mean per channel and mosaic phase without saturated values, and the gain that equalises them."""
    m = meas(spark, sf_dir).groupBy("pass_id", (F.col("x") % 2).alias("phase")).agg(F.avg(F.when(F.col("price") < 90000, F.col("price"))).alias("mean"))
    return m.select("pass_id", "phase", F.round("mean", 4).alias("mean"), F.round(F.avg("mean").over(Window.partitionBy(F.lit(0))) / F.col("mean"), 6).alias("gain"))


@query(f"""WITH {MEAS}, g AS (SELECT n_tile, list(abs(resid) ORDER BY abs(resid) DESC) AS d FROM meas GROUP BY n_tile) SELECT n_tile, d[2] AS second FROM g""")
def second_largest_difference(spark, sf_dir):
    """The second largest of a tile's differences; null where there is one only."""
    d = F.array_sort(F.collect_list(-F.abs("resid")))
    return meas(spark, sf_dir).groupBy("n_tile").agg((-F.try_element_at(d, F.lit(2))).alias("second"))


@query(f"""WITH {MEAS}, g AS (SELECT n_tile, count(DISTINCT target // 10) AS kinds, count(*) AS n, min(target // 10) AS least, bool_or(resid < -0.045) AS veto FROM meas GROUP BY n_tile)
SELECT n_tile, CASE WHEN veto THEN -1 WHEN kinds = 1 AND n >= 2 THEN least::INT ELSE 0 END AS consensus FROM g""")
def consensus_assignment(spark, sf_dir):
    """A negative opinion wins; else the single opinion of enough votes; else none."""
    opinion = F.floor(F.col("target") / 10).cast("int")
    g = meas(spark, sf_dir).groupBy("n_tile").agg(F.count_distinct(opinion).alias("kinds"), F.count("*").alias("n"), F.min(opinion).alias("least"), F.bool_or(F.col("resid") < -0.045).alias("veto"))
    return g.select("n_tile", F.when(F.col("veto"), -1).when((F.col("kinds") == 1) & (F.col("n") >= 2), F.col("least")).otherwise(0).alias("consensus"))


@query(f"""WITH {MEAS}, r AS (SELECT pass_id, n_tile % 10 AS sample, min(target) AS lo, max(target) AS hi, max(price) AS top FROM meas WHERE strength >= 0.7 GROUP BY ALL)
SELECT m.pass_id, m.n_tile % 10 AS sample, count(*) AS kept, min(lo) AS lo, max(hi) AS hi FROM meas m JOIN r ON r.pass_id = m.pass_id AND r.sample = m.n_tile % 10 WHERE (m.target BETWEEN lo + 2 AND hi - 2 AND price <= top) OR m.strength = 0 GROUP BY ALL""")
def within_group_ranges(spark, sf_dir):
    """Rows within their group's range and below its maximum; marked rows are exempt."""
    m = meas(spark, sf_dir).withColumn("sample", F.col("n_tile") % 10)
    r = m.where("strength >= 0.7").groupBy("pass_id", "sample").agg(F.min("target").alias("lo"), F.max("target").alias("hi"), F.max("price").alias("top"))
    kept = m.join(r, ["pass_id", "sample"]).where("(target between lo + 2 and hi - 2 and price <= top) or strength = 0")
    return kept.groupBy("pass_id", "sample").agg(F.count("*").alias("kept"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


@query(f"""WITH {MEAS}, s AS (SELECT pass_id, n_tile % 10 AS sample, sum(w * target) / sum(w) AS mean, sum(w * target * target) / sum(w) - (sum(w * target) / sum(w)) ** 2 AS var FROM (SELECT *, 110000 - price AS w FROM meas) GROUP BY ALL)
SELECT m.pass_id, count(*) AS kept, sum(m.target) AS total FROM meas m JOIN s ON s.pass_id = m.pass_id AND s.sample = m.n_tile % 10 WHERE (target - mean) ** 2 <= 2.25 * var GROUP BY m.pass_id""")
def without_far_samples(spark, sf_dir):
    """Rows within 1.5 deviations of their group's weighted mean."""
    m = meas(spark, sf_dir).withColumn("sample", F.col("n_tile") % 10)
    w, x = 110000 - F.col("price"), F.col("target")
    s = m.groupBy("pass_id", "sample").agg((F.sum(w * x) / F.sum(w)).alias("mean"), (F.sum(w * x * x) / F.sum(w) - F.pow(F.sum(w * x) / F.sum(w), 2)).alias("var"))
    return m.join(s, ["pass_id", "sample"]).where("(target - mean) * (target - mean) <= 2.25 * var").groupBy("pass_id").agg(F.count("*").alias("kept"), F.sum("target").alias("total"))


@query(f"""WITH {MEAS}, e AS (SELECT src, count(*) AS n, sqrt(sum(strength * resid * resid) / nullif(sum(strength), 0)) AS rms FROM meas GROUP BY src), a AS (SELECT sqrt(sum(strength * resid * resid) / sum(strength)) AS rms FROM meas)
SELECT e.src, e.n, round(e.rms, 6) AS rms FROM e, a WHERE e.rms <= 1.2 * a.rms""")
def sets_within_rms(spark, sf_dir):
    """Sets whose weighted RMS isn't far above that of all; the overall figure is one row."""
    w = F.col("strength") * F.col("resid") * F.col("resid")
    m = meas(spark, sf_dir)
    e = m.groupBy("src").agg(F.count("*").alias("n"), F.sqrt(F.sum(w) / F.nullif(F.sum("strength"), F.lit(0.0))).alias("rms"))
    a = m.agg(F.sqrt(F.sum(w) / F.sum("strength")).alias("all"))
    return e.join(F.broadcast(a)).where("rms <= 1.2 * all").select("src", "n", F.round("rms", 6).alias("rms"))


@query(f"""WITH {MEAS} SELECT n_tile, pass_id, src, target, CASE WHEN target < 20 THEN floor(target / 2) ELSE 10 + floor((target - 20) / 8) END::BIGINT AS bin,
round(abs(target - price / 2000) * CASE WHEN (target + price / 2000) / 2 > 15 THEN 15 / ((target + price / 2000) / 2) ELSE 1 END, 6) AS diff FROM meas""")
def bins_and_differences(spark, sf_dir):
    """Two-zone bins, and differences scaled down for large disparities."""
    return meas(spark, sf_dir).select("n_tile", "pass_id", "src", "target", scalars.disparity_bin(F.col("target"), 20, 2, 8).alias("bin"), F.round(scalars.scaled_difference(F.col("target"), F.col("price") / 2000, 15), 6).alias("diff"))
