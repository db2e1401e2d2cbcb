"""Queries that fit, fill and compare planes over the grid."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import fits, grid
from .views import MEAS, TILE, meas, tile

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_PLANE = """SELECT x // 5 AS px, y // 5 AS py, count(*) AS n, sum(strength) AS w, sum(strength * x) / sum(strength) AS mx, sum(strength * y) / sum(strength) AS my, sum(strength * disparity) / sum(strength) AS mv,
sum(strength * x * x) / sum(strength) - (sum(strength * x) / sum(strength)) ** 2 AS sxx, sum(strength * y * y) / sum(strength) - (sum(strength * y) / sum(strength)) ** 2 AS syy,
sum(strength * x * y) / sum(strength) - sum(strength * x) / sum(strength) * sum(strength * y) / sum(strength) AS sxy, sum(strength * x * disparity) / sum(strength) - sum(strength * x) / sum(strength) * sum(strength * disparity) / sum(strength) AS sxv,
sum(strength * y * disparity) / sum(strength) - sum(strength * y) / sum(strength) * sum(strength * disparity) / sum(strength) AS syv FROM tile WHERE strength > 0 GROUP BY ALL"""


def planes(spark, sf_dir):
    """A weighted plane for each square of 5 x 5 tiles."""
    t = tile(spark, sf_dir).where("strength > 0")
    m = t.groupBy(F.floor(F.col("x") / 5).alias("px"), F.floor(F.col("y") / 5).alias("py")).agg(*(v.alias(k) for k, v in fits.plane_moments(F.col("strength"), F.col("x"), F.col("y"), F.col("disparity")).items()))
    v, tx, ty = fits.plane_of()
    return m.select("px", "py", "n", "w", v.alias("centre"), tx.alias("tilt_x"), ty.alias("tilt_y"))


@query(f"""WITH {TILE}, p AS ({_PLANE}) SELECT px, py, n, round(mv, 5) AS centre, round(CASE WHEN abs(sxx * syy - sxy * sxy) > 1e-9 THEN (sxv * syy - syv * sxy) / (sxx * syy - sxy * sxy) END, 5) + 0 AS tilt_x,
round(CASE WHEN abs(sxx * syy - sxy * sxy) > 1e-9 THEN (syv * sxx - sxv * sxy) / (sxx * syy - sxy * sxy) END, 5) + 0 AS tilt_y FROM p""")
def supertile_planes(spark, sf_dir):
    """Value and tilts of the plane of each square of tiles."""
    return planes(spark, sf_dir).select("px", "py", "n", *((F.round(c, 5) + 0).alias(c) for c in ("centre", "tilt_x", "tilt_y")))


@query(f"""WITH {TILE}, p AS ({_PLANE}), k AS (SELECT a.px, a.py, b.px AS qx, b.py AS qy, abs(a.mv - b.mv) AS d FROM p a JOIN p b ON abs(a.px - b.px) <= 1 AND abs(a.py - b.py) <= 1 AND (a.px, a.py) <> (b.px, b.py)),
r AS (SELECT *, row_number() OVER (PARTITION BY px, py ORDER BY round(d, 9), qy, qx) AS k FROM k), best AS (SELECT px, py, qx, qy, d FROM r WHERE k = 1)
SELECT a.px, a.py, a.qx, a.qy, round(a.d, 5) AS diff FROM best a JOIN best b ON a.px = b.qx AND a.py = b.qy AND a.qx = b.px AND a.qy = b.py""")
def mutual_plane_links(spark, sf_dir):
    """Pairs of neighbouring planes that are each other's nearest in value."""
    p = planes(spark, sf_dir).select(F.col("px").alias("x"), F.col("py").alias("y"), "centre")
    k = grid.pairs(p, ["centre"]).join(p, ["x", "y"]).select("x", "y", (F.col("x") + F.col("dx")).alias("qx"), (F.col("y") + F.col("dy")).alias("qy"), F.abs(F.col("centre") - F.col("n_centre")).alias("d"))
    best = k.groupBy("x", "y").agg(F.min(F.struct(F.round("d", 9).alias("r"), "qy", "qx", "d")).alias("b")).select("x", "y", "b.qx", "b.qy", "b.d")
    back = best.select(F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("qx").alias("x"), F.col("qy").alias("y"))
    return best.join(back, ["x", "y", "qx", "qy"]).select(F.col("x").alias("px"), F.col("y").alias("py"), "qx", "qy", F.round("d", 5).alias("diff"))


_STEP = """s{1} AS (SELECT a.x, a.y, any_value(a.own) AS own, coalesce(CASE WHEN any_value(a.own) IS NULL THEN sum(b.value * w) / sum(w) ELSE any_value(a.own) * 0.5 + 0.5 * sum(b.value * w) / sum(w) END, any_value(a.value)) AS value
FROM s{0} a LEFT JOIN (SELECT x + dx AS x, y + dy AS y, value, CASE WHEN dx <> 0 AND dy <> 0 THEN 0.7 ELSE 1.0 END AS w FROM s{0}, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy) WHERE (dx <> 0 OR dy <> 0) AND value IS NOT NULL) b USING (x, y) GROUP BY a.x, a.y)"""


@query(f"""WITH {TILE}, s0 AS (SELECT x, y, CASE WHEN strength >= 0.8 THEN disparity END AS own, CASE WHEN strength >= 0.8 THEN disparity END AS value FROM tile), {_STEP.format(0, 1)}, {_STEP.format(1, 2)}
SELECT x, y, round(value, 5) AS value FROM s2""")
def filled_disparity(spark, sf_dir):
    """Unknown tiles filled from their neighbours, known ones pulled half way to them; two rounds."""
    t = tile(spark, sf_dir).select("x", "y", F.when(F.col("strength") >= 0.8, F.col("disparity")).alias("value"))
    return fits.fill_and_smooth(t, 0.5, 2).select("x", "y", F.round("value", 5).alias("value"))


@query(f"""WITH {TILE}, m AS (SELECT a.x, a.y, count(*) AS k, sum(CASE WHEN abs(a.disparity - b.disparity) <= 3 THEN 1 ELSE 0 END) AS friends, sum(b.strength) AS s FROM tile a JOIN tile b ON abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 AND a.n_tile <> b.n_tile GROUP BY a.x, a.y)
SELECT x, y, k, friends::BIGINT AS friends, round(s / k, 6) AS density FROM m""")
def trust_counts(spark, sf_dir):
    """How many tiles within two steps agree, and their mean strength."""
    t = tile(spark, sf_dir)
    p = grid.window_pairs(t, ["disparity", "strength"], 2).join(t.select("x", "y", "disparity"), ["x", "y"])
    close = F.sum((F.abs(F.col("disparity") - F.col("n_disparity")) <= 3).cast("long"))
    return p.groupBy("x", "y").agg(F.count("*").alias("k"), close.alias("friends"), F.round(F.sum("n_strength") / F.count("*"), 6).alias("density"))


@query(f"""WITH {MEAS}, r AS (SELECT n_tile, pass_id, src, target, strength, row_number() OVER (PARTITION BY n_tile ORDER BY target, pass_id, src, strength) - 1 AS layer, max(strength) OVER (PARTITION BY n_tile) AS top FROM meas WHERE strength > 0)
SELECT n_tile, layer::INT AS layer, pass_id, target, round(strength / top, 6) AS share FROM r WHERE layer < 4""")
def sorted_layers(spark, sf_dir):
    """Layers of each tile from far to near, numbered anew."""
    w = Window.partitionBy("n_tile")
    r = meas(spark, sf_dir).where("strength > 0").withColumn("layer", F.row_number().over(w.orderBy("target", "pass_id", "src", "strength")) - 1).withColumn("top", F.max("strength").over(w))
    return r.where("layer < 4").select("n_tile", F.col("layer").cast("int").alias("layer"), "pass_id", "target", F.round(F.col("strength") / F.col("top"), 6).alias("share"))


@query(f"""WITH {MEAS}, l AS (SELECT n_tile, pass_id, src, target, lag(target) OVER (PARTITION BY n_tile ORDER BY target, pass_id, src) AS before FROM meas),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR target - before > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY n_tile ORDER BY target, pass_id, src ROWS UNBOUNDED PRECEDING) AS g FROM l)
SELECT n_tile, g::BIGINT AS cluster, count(*) AS n, round(avg(target), 6) AS disparity FROM g GROUP BY n_tile, g""")
def merged_disparities(spark, sf_dir):
    """Disparities of a tile merged where they follow each other closely."""
    w = Window.partitionBy("n_tile").orderBy("target", "pass_id", "src")
    fresh = F.coalesce(F.col("target") - F.lag("target").over(w) > 2, F.lit(True)).cast("int")
    g = meas(spark, sf_dir).withColumn("fresh", fresh).withColumn("cluster", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return g.groupBy("n_tile", "cluster").agg(F.count("*").alias("n"), F.round(F.avg("target"), 6).alias("disparity"))
