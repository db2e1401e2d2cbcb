"""Queries on histograms, layers, links and calibration tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import grid
from .views import FRAME, MEAS, TILE, frame, meas, table, tile

Q: dict = {}
SQL: dict[str, str] = {}

#: Rows of a block of calibration rows, in the mean.
BLOCK = 1000


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_HIST = f"""{TILE}, h AS (SELECT x // 10 AS sx, y // 10 AS sy, floor(disparity / 2)::INT AS bin, round(sum(strength), 4) AS w FROM tile GROUP BY ALL)"""


def _histogram(spark, sf_dir):
    sx, sy = F.floor(F.col("x") / 10).alias("sx"), F.floor(F.col("y") / 10).alias("sy")
    return tile(spark, sf_dir).groupBy(sx, sy, F.floor(F.col("disparity") / 2).cast("int").alias("bin")).agg(F.round(F.sum("strength"), 4).alias("w"))


@query(f"""WITH {_HIST}, n AS (SELECT *, CASE WHEN lag(bin) OVER s = bin - 1 THEN lag(w) OVER s ELSE 0 END AS a, CASE WHEN lead(bin) OVER s = bin + 1 THEN lead(w) OVER s ELSE 0 END AS b FROM h WINDOW s AS (PARTITION BY sx, sy ORDER BY bin))
SELECT sx, sy, bin, w, round(bin + CASE WHEN a + b - 2 * w < 0 THEN 0.5 * (a - b) / (a + b - 2 * w) ELSE 0 END, 5) AS peak FROM n WHERE w >= a AND w > b""")
def histogram_peaks(spark, sf_dir):
    """Local maxima of each histogram, refined by a parabola through the neighbours; of a plateau the
    last bin."""
    s = Window.partitionBy("sx", "sy").orderBy("bin")
    a = F.when(F.lag("bin").over(s) == F.col("bin") - 1, F.lag("w").over(s)).otherwise(0.0)
    b = F.when(F.lead("bin").over(s) == F.col("bin") + 1, F.lead("w").over(s)).otherwise(0.0)
    n = _histogram(spark, sf_dir).withColumn("a", a).withColumn("b", b)
    bend = F.col("a") + F.col("b") - 2 * F.col("w")
    return n.where("w >= a and w > b").select("sx", "sy", "bin", "w", F.round(F.col("bin") + F.when(bend < 0, 0.5 * (F.col("a") - F.col("b")) / bend).otherwise(0), 5).alias("peak"))


@query(f"""WITH {_HIST}, r AS (SELECT *, round(sum(w) OVER (PARTITION BY sx, sy ORDER BY bin), 4) AS so_far, round(sum(w) OVER (PARTITION BY sx, sy), 4) AS total FROM h)
SELECT sx, sy, min(bin) AS background FROM r WHERE so_far >= 0.2 * total GROUP BY sx, sy""")
def background_bins(spark, sf_dir):
    """The bin at which each histogram has gathered a fifth of its weight, from far to near."""
    w = Window.partitionBy("sx", "sy")
    r = _histogram(spark, sf_dir).withColumn("so_far", F.round(F.sum("w").over(w.orderBy("bin")), 4)).withColumn("total", F.round(F.sum("w").over(w), 4))
    return r.where("so_far >= 0.2 * total").groupBy("sx", "sy").agg(F.min("bin").alias("background"))


@query(f"""WITH {TILE}, s AS (SELECT sx, sy, disparity, strength * (1 - abs(x + 0.5 - 8 * (sx + 1)) / 8) * (1 - abs(y + 0.5 - 8 * (sy + 1)) / 8) AS w FROM tile, LATERAL (SELECT unnest([x // 8 - 1, x // 8]) AS sx), LATERAL (SELECT unnest([y // 8 - 1, y // 8]) AS sy))
SELECT sx, sy, count(*) AS n, round(sum(w * disparity) / sum(w), 5) AS disparity FROM s WHERE w > 0 GROUP BY sx, sy""")
def lapped_means(spark, sf_dir):
    """Means over windows of 16 x 16 tiles that overlap by half, weighted towards their centre."""
    near = lambda c: F.explode(F.array(F.floor(F.col(c) / 8) - 1, F.floor(F.col(c) / 8)))
    s = tile(spark, sf_dir).select("x", "y", "disparity", "strength", near("x").alias("sx")).select("*", near("y").alias("sy"))
    taper = lambda c, s: 1 - F.abs(F.col(c) + 0.5 - 8 * (F.col(s) + 1)) / 8
    s = s.withColumn("w", F.col("strength") * taper("x", "sx") * taper("y", "sy")).where("w > 0")
    return s.groupBy("sx", "sy").agg(F.count("*").alias("n"), F.round(F.sum(F.col("w") * F.col("disparity")) / F.sum("w"), 5).alias("disparity"))


@query(f"""WITH {TILE}, v AS (SELECT n_tile, x, y, CASE WHEN strength >= 0.75 AND (x + y) % 3 <> 0 THEN disparity END AS d FROM tile),
g AS (SELECT *, last_value(d IGNORE NULLS) OVER b AS a, last_value(CASE WHEN d IS NOT NULL THEN x END IGNORE NULLS) OVER b AS xa, first_value(d IGNORE NULLS) OVER f AS c, first_value(CASE WHEN d IS NOT NULL THEN x END IGNORE NULLS) OVER f AS xc FROM v
WINDOW b AS (PARTITION BY y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY y ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT n_tile, round(CASE WHEN d IS NOT NULL THEN d WHEN xc - xa <= 4 THEN a + (c - a) * (x - xa) / (xc - xa) END, 6) AS bridged FROM g""")
def bridged_gaps(spark, sf_dir):
    """Short gaps along rows filled by linear interpolation between their ends."""
    v = tile(spark, sf_dir).select("n_tile", "x", "y", F.when((F.col("strength") >= 0.75) & ((F.col("x") + F.col("y")) % 3 != 0), F.col("disparity")).alias("d"))
    w = Window.partitionBy("y").orderBy("x")
    back, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("d").isNotNull(), F.col("x"))
    g = v.select("*", F.last("d", True).over(back).alias("a"), F.last(at, True).over(back).alias("xa"), F.first("d", True).over(on).alias("c"), F.first(at, True).over(on).alias("xc"))
    between = F.col("a") + (F.col("c") - F.col("a")) * (F.col("x") - F.col("xa")) / (F.col("xc") - F.col("xa"))
    return g.select("n_tile", F.round(F.when(F.col("d").isNotNull(), F.col("d")).when(F.col("xc") - F.col("xa") <= 4, between), 6).alias("bridged"))


@query(f"""WITH {MEAS}, e AS (SELECT n_tile, min(price) AS lo, max(price) - min(price) AS span FROM meas GROUP BY n_tile)
SELECT pass_id, floor(m.target / 4)::INT AS bin, count(*) AS n, round(avg((price - lo) / span), 6) AS edge FROM meas m JOIN e USING (n_tile) WHERE span > 0 GROUP BY ALL""")
def edge_profile(spark, sf_dir):
    """Profile across an edge: values normalised by their row's range, averaged per bin."""
    m = meas(spark, sf_dir)
    e = m.groupBy("n_tile").agg(F.min("price").alias("lo"), (F.max("price") - F.min("price")).alias("span")).where("span > 0")
    return m.join(e, "n_tile").groupBy("pass_id", F.floor(F.col("target") / 4).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("price") - F.col("lo")) / F.col("span")), 6).alias("edge"))


@query(f"""WITH {TILE}, p AS (SELECT a.disparity AS u, b.disparity AS v, a.strength * b.strength AS w FROM tile a JOIN tile b ON b.y = a.y AND b.x = a.x + 1)
SELECT least(greatest(floor((u + v) / 2 / 5), 0), 9)::INT AS mean_bin, least(greatest(floor((u - v) / 2 / 5 + 5), 0), 9)::INT AS half_bin, round(sum(w * exp(-(u - v) * (u - v) / 200)), 5) AS weight FROM p GROUP BY ALL""")
def pair_histogram(spark, sf_dir):
    """Histogram of mean and half difference of neighbours, weighted down as they part."""
    t = tile(spark, sf_dir)
    p = grid.pairs(t, ["disparity", "strength"], [(1, 0)]).join(t.select("x", "y", "disparity", "strength"), ["x", "y"])
    u, v, w = F.col("disparity"), F.col("n_disparity"), F.col("strength") * F.col("n_strength")
    bin_ = lambda c: F.least(F.greatest(F.floor(c), F.lit(0)), F.lit(9)).cast("int")
    return p.groupBy(bin_((u + v) / 2 / 5).alias("mean_bin"), bin_((u - v) / 2 / 5 + 5).alias("half_bin")).agg(F.round(F.sum(w * F.exp(-(u - v) * (u - v) / 200)), 5).alias("weight"))


@query(f"""WITH {TILE}, m AS (SELECT a.n_tile, sum(b.strength * b.disparity * w) / sum(b.strength * w) AS mean FROM tile a JOIN tile b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.n_tile <> b.n_tile, LATERAL (SELECT CASE WHEN a.x <> b.x AND a.y <> b.y THEN 0.7 ELSE 1.0 END AS w) GROUP BY a.n_tile),
f AS (SELECT meas.*, (meas.strength - 0.05) / sqrt((target - mean) ** 2 + 0.0025) AS fit FROM meas JOIN m USING (n_tile))
SELECT n_tile, max_by(pass_id, (round(fit, 9), pass_id, src, target)) AS fittest FROM f GROUP BY n_tile""")
def fittest_pass(spark, sf_dir):
    """The pass that best joins strength with agreement to the neighbours' weighted mean."""
    t = tile(spark, sf_dir)
    w = F.col("n_strength") * F.when((F.col("dx") != 0) & (F.col("dy") != 0), 0.7).otherwise(1.0)
    mean = grid.pairs(t, ["disparity", "strength"]).groupBy("x", "y").agg((F.sum(w * F.col("n_disparity")) / F.sum(w)).alias("mean"))
    fit = (F.col("strength") - 0.05) / F.sqrt(F.pow(F.col("target") - F.col("mean"), 2) + 0.0025)
    return meas(spark, sf_dir).join(mean, ["x", "y"]).groupBy("n_tile").agg(F.max_by("pass_id", F.struct(F.round(fit, 9), "pass_id", "src", "target")).alias("fittest"))


@query(f"""WITH {MEAS}, d AS (SELECT n_tile, min(target) AS far FROM meas WHERE strength >= 0.3 GROUP BY n_tile)
SELECT m.n_tile, max(m.target) AS foreground FROM meas m JOIN d USING (n_tile) WHERE m.target >= d.far + 10 AND m.strength >= 0.4 GROUP BY m.n_tile""")
def foreground_disparity(spark, sf_dir):
    """The nearest strong candidate well in front of a tile's farthest one."""
    m = meas(spark, sf_dir)
    d = m.where("strength >= 0.3").groupBy("n_tile").agg(F.min("target").alias("far"))
    return m.join(d, "n_tile").where("target >= far + 10 and strength >= 0.4").groupBy("n_tile").agg(F.max("target").alias("foreground"))


@query(f"""WITH {MEAS}, l AS (SELECT DISTINCT n_tile, pass_id, floor(target / 10)::INT AS layer FROM meas WHERE strength >= 0.4)
SELECT a.pass_id AS p, b.pass_id AS q, count(*) AS shared FROM l a JOIN l b ON a.n_tile = b.n_tile AND a.layer = b.layer AND a.pass_id < b.pass_id GROUP BY ALL HAVING count(*) > 0""")
def merge_candidates(spark, sf_dir):
    """Pairs of passes with the number of links that they share."""
    l = meas(spark, sf_dir).where("strength >= 0.4").select("n_tile", "pass_id", F.floor(F.col("target") / 10).cast("int").alias("layer")).distinct()  # noqa: E741
    return l.withColumnRenamed("pass_id", "p").join(l.withColumnRenamed("pass_id", "q"), ["n_tile", "layer"]).where("p < q").groupBy("p", "q").agg(F.count("*").alias("shared"))


@query(f"""WITH {MEAS}, p AS (SELECT n_tile, pass_id, src, target, strength, exp(sum(ln(strength + 0.1)) OVER w / count(*) OVER w) - 0.1 AS g FROM meas WINDOW w AS (PARTITION BY n_tile))
SELECT n_tile, count(*) AS n, round(min(g), 6) AS geometric FROM p GROUP BY n_tile""")
def geometric_means(spark, sf_dir):
    """Geometric mean of a tile's strengths above an offset."""
    return meas(spark, sf_dir).groupBy("n_tile").agg(F.count("*").alias("n"), F.round(F.exp(F.avg(F.ln(F.col("strength") + 0.1))) - 0.1, 6).alias("geometric"))


@query(f"""WITH {TILE}, p AS (SELECT x // 10 AS sx, min(disparity) AS a, max(disparity) AS b, min(disparity) + (max(disparity) - min(disparity)) / 2 AS c FROM tile GROUP BY ALL), q AS (SELECT sx, unnest([a, b, c]) AS plane, unnest([0, 1, 2]) AS k FROM p)
SELECT n_tile, CASE WHEN min(abs(disparity - plane)) <= 3 THEN min_by(k, (abs(disparity - plane), k)) + 1 ELSE 0 END::INT AS plane FROM tile JOIN q ON q.sx = x // 10 GROUP BY n_tile""")
def snapped_planes(spark, sf_dir):
    """The nearest of a column's planes within a tolerance, counted from 1; 0 for none."""
    t = tile(spark, sf_dir).withColumn("sx", F.floor(F.col("x") / 10))
    p = t.groupBy("sx").agg(F.min("disparity").alias("a"), F.max("disparity").alias("b"))
    q = p.select("sx", F.posexplode(F.array(F.col("a"), F.col("b"), F.col("a") + (F.col("b") - F.col("a")) / 2)).alias("k", "plane"))
    d = F.abs(F.col("disparity") - F.col("plane"))
    return t.join(q, "sx").groupBy("n_tile").agg(F.when(F.min(d) <= 3, F.min_by("k", F.struct(d, "k")) + 1).otherwise(0).cast("int").alias("plane"))


@query("""WITH s AS (SELECT s_nationkey AS station, s_suppkey AS image, s_acctbal AS period FROM supplier), m AS (SELECT station, median(period) AS mid FROM s GROUP BY station)
SELECT s.station, count(*) AS images, count(*) FILTER (abs(period - mid) <= 0.5 * abs(mid)) AS kept, count(*) FILTER (period < 0) AS negative, round(min(mid), 6) AS mid FROM s JOIN m USING (station) GROUP BY s.station""")
def images_near_station_median(spark, sf_dir):
    """Images near the median of their station, with counts."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("station"), F.col("s_acctbal").alias("period"))
    m = s.groupBy("station").agg(F.median("period").alias("mid"))
    near = F.abs(F.col("period") - F.col("mid")) <= 0.5 * F.abs("mid")
    return s.join(m, "station").groupBy("station").agg(F.count("*").alias("images"), F.count_if(near).alias("kept"), F.count_if(F.col("period") < 0).alias("negative"), F.round(F.min("mid"), 6).alias("mid"))


@query("""SELECT o_custkey AS set_id, coalesce(max(o_orderkey) FILTER (o_orderstatus = 'F'), -1) AS f, coalesce(max(o_orderkey) FILTER (o_orderstatus = 'O'), -1) AS o, coalesce(max(o_orderkey) FILTER (o_orderstatus = 'P'), -1) AS p FROM orders GROUP BY o_custkey""")
def files_by_channel(spark, sf_dir):
    """The file of each channel of a set; -1 where one is missing."""
    wide = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("set_id")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.max("o_orderkey"))
    return wide.select("set_id", *(F.coalesce(c, F.lit(-1)).alias(c.lower()) for c in ("F", "O", "P")))


@query(f"""WITH {FRAME}, l AS (SELECT channel, frame_id, abs(second(ts) - second(lag(ts) OVER (PARTITION BY channel ORDER BY ts, frame_id))) AS d FROM frame)
SELECT channel, frame_id, CASE WHEN d > 30 THEN abs(d - 30) ELSE d END AS offset_s, lower(to_hex(frame_id % 256)) AS code FROM l WHERE d IS NOT NULL""")
def second_offsets(spark, sf_dir):
    """Differences of the seconds of successive frames across the minute's wrap, and a byte in hex."""
    d = F.abs(F.second("ts") - F.second(F.lag("ts").over(Window.partitionBy("channel").orderBy("ts", "frame_id"))))
    l = frame(spark, sf_dir).select("channel", "frame_id", d.cast("long").alias("d")).where("d is not null")  # noqa: E741
    return l.select("channel", "frame_id", F.when(F.col("d") > 30, F.abs(F.col("d") - 30)).otherwise(F.col("d")).alias("offset_s"), F.lower(F.hex(F.col("frame_id") % 256)).alias("code"))


@query(f"""WITH {MEAS}, c AS (SELECT pass_id, avg(target) AS t, avg(price) AS p FROM meas GROUP BY pass_id)
SELECT m.n_tile, m.src, m.pass_id, min_by(c.pass_id, (round((m.target - c.t) ** 2 + ((m.price - c.p) / 10000) ** 2, 6), c.pass_id)) AS nearest FROM meas m, c WHERE m.strength >= 0.78 GROUP BY m.n_tile, m.src, m.pass_id, m.target, m.price""")
def nearest_calibration(spark, sf_dir):
    """The calibration row of least weighted squared error. Calibration rows are dealt to blocks of some
    BLOCK rows; each measurement meets every block, and the least of its blocks' nearest rows counts."""
    m = meas(spark, sf_dir)
    c = m.groupBy("pass_id").agg(F.avg("target").alias("t"), F.avg("price").alias("p"))
    blocks = -(-c.count() // BLOCK) or 1
    c = c.groupBy(F.pmod(F.xxhash64("pass_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("pass_id", "t", "p")).alias("c"))
    error = lambda r: F.struct(F.round(F.pow(F.col("target") - r["t"], 2) + F.pow((F.col("price") - r["p"]) / 10000, 2), 6).alias("e"), r["pass_id"].alias("k"))
    met = m.where("strength >= 0.78").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(c, "block")
    near = met.select("n_tile", "src", "pass_id", "target", "price", F.array_min(F.transform("c", error)).alias("near"))
    return near.groupBy("n_tile", "src", "pass_id", "target", "price").agg(F.min("near")["k"].alias("nearest")).drop("target", "price")
