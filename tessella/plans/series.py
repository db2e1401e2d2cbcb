"""Queries on frames, image sets and other ordered data."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import sequence
from .views import FRAME, MEAS, TILE, frame, meas, table, tile

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {TILE} SELECT n_tile, round(CASE WHEN lag(disparity) OVER w IS NULL OR lead(disparity) OVER w IS NULL THEN disparity ELSE disparity * 1.5 - 0.25 * (lag(disparity) OVER w + lead(disparity) OVER w) END, 6) AS sharp,
round(avg(disparity) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING), 6) AS forward_mean FROM tile WINDOW w AS (PARTITION BY y ORDER BY x)""")
def sharpened_lines(spark, sf_dir):
    """Three-point sharpening and a forward moving average along rows of tiles."""
    w = Window.partitionBy("y").orderBy("x")
    d = F.col("disparity")
    return tile(spark, sf_dir).select("n_tile", F.round(sequence.sharpened(d, 0.25, w), 6).alias("sharp"), F.round(F.avg(d).over(w.rowsBetween(0, 3)), 6).alias("forward_mean"))


@query(f"""WITH {TILE}, s AS (SELECT *, avg(disparity) OVER (PARTITION BY x ORDER BY y ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS below FROM tile)
SELECT n_tile, disparity, round(below, 6) AS below FROM s WHERE strength > 0.2 AND disparity > 20 AND disparity >= below + 2 + 0.05 * disparity""")
def pole_seeds(spark, sf_dir):
    """Tiles that stand over the mean of the next ones below by an absolute and a relative margin."""
    below = F.avg("disparity").over(Window.partitionBy("x").orderBy("y").rowsBetween(1, 3))
    s = tile(spark, sf_dir).withColumn("below", below)
    return s.where("strength > 0.2 and disparity > 20 and disparity >= below + 2 + 0.05 * disparity").select("n_tile", "disparity", F.round("below", 6).alias("below"))


@query(f"""WITH {FRAME}, c AS (SELECT *, CASE WHEN lag(kind) OVER w IS DISTINCT FROM kind AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS new FROM frame WINDOW w AS (PARTITION BY channel ORDER BY ts, frame_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY channel ORDER BY ts, frame_id) AS run FROM c)
SELECT channel, run::BIGINT AS run, min(kind) AS kind, count(*) AS n, round(avg(value), 6) AS mean, max(ts) AS until FROM r GROUP BY channel, run""")
def runs_of_equal_state(spark, sf_dir):
    """Runs of frames of equal state with their mean (gaps and islands)."""
    r = sequence.runs(frame(spark, sf_dir), ["channel"], ["ts", "frame_id"], F.col("kind"))
    return r.groupBy("channel", "run").agg(F.min("kind").alias("kind"), F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("ts").alias("until"))


@query(f"""WITH {FRAME}, l AS (SELECT *, value - lag(value) OVER w AS jump, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap FROM frame WINDOW w AS (PARTITION BY channel ORDER BY ts, frame_id)),
b AS (SELECT *, coalesce(abs(jump) >= 150 AND gap <= 3600000000 * 12, false) AS bad FROM l), f AS (SELECT *, bad OR coalesce(lead(bad) OVER (PARTITION BY channel ORDER BY ts, frame_id), false) AS out FROM b)
SELECT channel, frame_id, value FROM f WHERE NOT out""")
def without_jumps(spark, sf_dir):
    """Frames but for both sides of a large jump within a short time."""
    w = Window.partitionBy("channel").orderBy("ts", "frame_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = micros - F.lag(micros).over(w)
    bad = F.coalesce((F.abs(F.col("value") - F.lag("value").over(w)) >= 150) & (gap <= 3600000000 * 12), F.lit(False))
    f = frame(spark, sf_dir).withColumn("bad", bad)
    return f.withColumn("next", F.coalesce(F.lead("bad").over(w), F.lit(False))).where("not bad and not next").select("channel", "frame_id", "value")


@query(f"""WITH {FRAME}, a AS (SELECT * FROM frame WHERE kind = 'click'), b AS (SELECT * FROM frame WHERE kind <> 'click')
SELECT a.channel, a.frame_id, (SELECT max_by(b.frame_id, (b.ts, b.frame_id)) FROM b WHERE b.channel = a.channel AND b.ts <= a.ts) AS other_frame,
(SELECT max_by(b.value, (b.ts, b.frame_id)) FROM b WHERE b.channel = a.channel AND b.ts <= a.ts) AS other_value FROM a""")
def aligned_frames(spark, sf_dir):
    """Each frame of one stream with the latest of the other at its time."""
    f = frame(spark, sf_dir)
    a, b = f.where("kind = 'click'").select("channel", "frame_id", "ts"), f.where("kind <> 'click'")
    b = b.select("channel", "frame_id", "ts", F.col("frame_id").alias("other_frame"), F.col("value").alias("other_value"))
    return sequence.latest_before(a, b, ["channel"], "ts", ["other_frame", "other_value"], ["frame_id"]).drop("ts")


@query("""WITH i AS (SELECT o_orderdate AS ts, o_custkey % 4 AS channel, max(o_orderkey) AS file FROM orders GROUP BY ALL)
SELECT (dense_rank() OVER (ORDER BY ts) - 1)::INT AS set_id, ts, max(file) FILTER (channel = 0) AS c0, max(file) FILTER (channel = 1) AS c1, max(file) FILTER (channel = 2) AS c2, max(file) FILTER (channel = 3) AS c3 FROM i GROUP BY ts""")
def image_sets(spark, sf_dir):
    """Images of equal time as one set, a column per channel; the last image of a channel wins. Sets
    are numbered by counting per range of time, so no task sees them all."""
    i = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"), (F.col("o_custkey") % 4).alias("channel"), F.col("o_orderkey").alias("file"))
    wide = i.groupBy("ts").pivot("channel", [0, 1, 2, 3]).agg(F.max("file")).toDF("ts", "c0", "c1", "c2", "c3")
    day = F.date_trunc("year", "ts")
    years = wide.groupBy(day.alias("year")).agg(F.count("*").alias("n"))  # as many rows as years
    before = years.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("year").orderBy("ts"))
    return wide.withColumn("year", day).withColumn("own", own).join(F.broadcast(before), "year").select((F.col("own") + F.col("before") - 1).cast("int").alias("set_id"), "ts", "c0", "c1", "c2", "c3")


@query("""SELECT o_orderkey, o_custkey, o_totalprice, round(0.25 * max(o_totalprice) OVER w + 0.75 * min(o_totalprice) OVER w, 6) AS reference FROM orders WINDOW w AS (PARTITION BY o_custkey)""")
def reference_exposures(spark, sf_dir):
    """A reference between the smallest and largest exposure of each group, given to all its files."""
    w = Window.partitionBy("o_custkey")
    v = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.round(0.25 * F.max(v).over(w) + 0.75 * F.min(v).over(w), 6).alias("reference"))


@query(f"""WITH {FRAME}, g AS (SELECT channel, date_trunc('day', ts) AS day, kind, count(*) AS n FROM frame GROUP BY ALL), k AS (SELECT channel, day, sum(n) AS total, max(n) AS best FROM g GROUP BY ALL)
SELECT f.channel, f.frame_id FROM frame f JOIN k ON k.channel = f.channel AND k.day = date_trunc('day', f.ts) WHERE k.total >= 3 AND k.best >= 2""")
def groups_with_enough_samples(spark, sf_dir):
    """Frames of groups with enough samples, in all and in their best class."""
    f = frame(spark, sf_dir).withColumn("day", F.date_trunc("day", "ts"))
    k = f.groupBy("channel", "day", "kind").count().groupBy("channel", "day").agg(F.sum("count").alias("total"), F.max("count").alias("best"))
    return f.join(k.where("total >= 3 and best >= 2"), ["channel", "day"], "left_semi").select("channel", "frame_id")


@query(f"""WITH {MEAS}, d AS (SELECT src, pass_id, target::INT - n_tile::INT % 7 AS d FROM meas), m AS (SELECT d FROM d GROUP BY d ORDER BY count(*) DESC, d LIMIT 1),
s AS (SELECT src, pass_id, max(d.d = m.d) AS ok FROM d, m GROUP BY ALL), r AS (SELECT src, pass_id, ok, row_number() OVER (PARTITION BY src ORDER BY pass_id) - row_number() OVER (PARTITION BY src, ok ORDER BY pass_id) AS island FROM s)
SELECT src, count(*) AS length, min(pass_id) AS since FROM r WHERE ok GROUP BY src, island QUALIFY row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, min(pass_id)) = 1""")
def longest_modal_run(spark, sf_dir):
    """Per group the longest contiguous run of rows that hold the overall modal value."""
    d = meas(spark, sf_dir).select("src", "pass_id", (F.col("target").cast("int") - F.col("n_tile").cast("int") % 7).alias("d"))
    mode = d.groupBy("d").count().orderBy(F.desc("count"), "d").limit(1).select(F.col("d").alias("mode"))
    s = d.join(F.broadcast(mode)).groupBy("src", "pass_id").agg(F.max(F.col("d") == F.col("mode")).alias("ok"))
    r = sequence.runs(s, ["src"], ["pass_id"], F.col("ok")).where("ok").groupBy("src", "run").agg(F.count("*").alias("length"), F.min("pass_id").alias("since"))
    best = r.groupBy("src").agg(F.max_by(F.struct("length", "since"), F.struct("length", (-F.col("since")).alias("s"))).alias("b"))
    return best.select("src", "b.length", "b.since")


@query(f"""WITH {FRAME}, r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY ts DESC, frame_id DESC) AS k FROM frame), n AS (SELECT channel, value AS y, hour(ts) + minute(ts) / 60.0 AS x FROM r WHERE k <= 20)
SELECT channel, count(*) AS n, round(regr_slope(y, x::DOUBLE), 4) AS slope, round(regr_intercept(y, x::DOUBLE), 4) AS intercept FROM n GROUP BY channel""")
def recent_linear_fit(spark, sf_dir):
    """Linear fit over the last rows of each channel."""
    k = F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("ts"), F.desc("frame_id")))
    n = frame(spark, sf_dir).withColumn("k", k).where("k <= 20").select("channel", F.col("value").alias("y"), (F.hour("ts") + F.minute("ts") / 60.0).cast("double").alias("x"))
    return n.groupBy("channel").agg(F.count("*").alias("n"), F.round(F.regr_slope("y", "x"), 4).alias("slope"), F.round(F.regr_intercept("y", "x"), 4).alias("intercept"))


@query(f"""WITH {FRAME} SELECT channel, kind, count(*) AS n, round(avg(value), 6) AS mean, min_by(frame_id, (ts, frame_id)) AS first_frame FROM frame GROUP BY channel, kind""")
def averaged_frames(spark, sf_dir):
    """Average per channel and position, with the first frame's properties."""
    return frame(spark, sf_dir).groupBy("channel", "kind").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min_by("frame_id", F.struct("ts", "frame_id")).alias("first_frame"))


@query("""WITH r AS (SELECT p_brand AS model, p_type AS version, p_size::DOUBLE AS v FROM part), a AS (SELECT model, version, round(avg(v), 6) AS value FROM r GROUP BY ALL)
SELECT 0 AS part, model, version, value FROM a UNION ALL SELECT 1, 'mean', NULL, round(avg(value), 4) FROM a UNION ALL SELECT 2, 'deviation', NULL, round(stddev_pop(value), 4) FROM a""")
def extrinsics_list(spark, sf_dir):
    """Rows per model and version, with mean and deviation as footer rows."""
    a = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("model"), F.col("p_type").alias("version")).agg(F.round(F.avg(F.col("p_size").cast("double")), 6).alias("value"))
    foot = lambda part, name, f: a.agg(F.round(f("value"), 4).alias("value")).select(F.lit(part).alias("part"), F.lit(name).alias("model"), F.lit(None).cast("string").alias("version"), "value")
    return a.select(F.lit(0).alias("part"), "model", "version", "value").union(foot(1, "mean", F.avg)).union(foot(2, "deviation", F.stddev_pop))
