"""Queries on pixels and meshes; tiles stand for pixels here."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import grid
from .views import TILE, tile

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_PIX = f"{TILE}, pix AS (SELECT x, y, disparity AS v, strength AS s FROM tile)"


def _pixels(spark, sf_dir):
    return tile(spark, sf_dir).select("x", "y", F.col("disparity").alias("v"), F.col("strength").alias("s"))


@query(f"""WITH {_PIX}, m AS (SELECT a.x, a.y, avg(b.v) AS mean, count(*) AS n FROM pix a JOIN pix b ON (abs(a.x - b.x) = 2 AND a.y = b.y) OR (abs(a.y - b.y) = 2 AND a.x = b.x) GROUP BY a.x, a.y)
SELECT x, y, round(CASE WHEN n = 4 AND abs(v - mean) > 2 THEN mean ELSE v END, 6) AS v FROM pix LEFT JOIN m USING (x, y)""")
def corrected_defects(spark, sf_dir):
    """Pixels that leave the mean of their four neighbours of the same colour take that mean."""
    p = _pixels(spark, sf_dir)
    m = grid.pairs(p, ["v"], [(2, 0), (-2, 0), (0, 2), (0, -2)]).groupBy("x", "y").agg(F.avg("n_v").alias("mean"), F.count("*").alias("n"))
    v = F.when((F.col("n") == 4) & (F.abs(F.col("v") - F.col("mean")) > 2), F.col("mean")).otherwise(F.col("v"))
    return p.join(m, ["x", "y"], "left").select("x", "y", F.round(v, 6).alias("v"))


@query(f"""WITH {_PIX} SELECT x // 2 AS cx, y // 2 AS cy, max(v) FILTER (y % 2 = 0 AND x % 2 = 1) AS red, max(v) FILTER (y % 2 = 1 AND x % 2 = 0) AS blue, avg(v) FILTER (x % 2 = y % 2) AS green FROM pix GROUP BY ALL""")
def mosaic_planes(spark, sf_dir):
    """The colour planes of a mosaic of two by two pixels."""
    at = lambda cond: F.when(F.expr(cond), F.col("v"))
    cell = [F.floor(F.col(c) / 2).alias(f"c{c}") for c in "xy"]
    return _pixels(spark, sf_dir).groupBy(*cell).agg(F.max(at("y % 2 = 0 and x % 2 = 1")).alias("red"), F.max(at("y % 2 = 1 and x % 2 = 0")).alias("blue"), F.avg(at("x % 2 = y % 2")).alias("green"))


@query(f"""WITH {_PIX}, c AS (SELECT x - 3 AS x, y - 2 AS y, v, s FROM pix WHERE x BETWEEN 3 AND 46 AND y BETWEEN 2 AND 37)
SELECT 35 - y AS x, x AS y, v, (65536 * least(greatest(floor(v * 256 / 50), 0), 255) + 256 * least(greatest(floor(s * 256), 0), 255) + least(greatest(floor((v + s) * 4), 0), 255))::BIGINT AS packed FROM c""")
def cropped_and_turned(spark, sf_dir):
    """An image without margins, turned clockwise, in packed 8-bit colours."""
    c = _pixels(spark, sf_dir).where("x between 3 and 46 and y between 2 and 37").select((F.col("x") - 3).alias("x"), (F.col("y") - 2).alias("y"), "v", "s")
    byte = lambda e: F.least(F.greatest(F.floor(e), F.lit(0)), F.lit(255))
    packed = byte(F.col("v") * 256 / 50) * 65536 + byte(F.col("s") * 256) * 256 + byte((F.col("v") + F.col("s")) * 4)
    return c.select((35 - F.col("y")).alias("x"), F.col("x").alias("y"), "v", packed.cast("long").alias("packed"))


@query(f"""WITH {_PIX}, m AS (SELECT a.x, a.y, avg(b.v) AS lo FROM pix a JOIN pix b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.x, a.y)
SELECT x, y, round(lo + (v - lo) * least(greatest(((v - lo) ** 2 / greatest(lo, 5) - 0.01) / 0.19, 0), 1), 6) AS v FROM pix JOIN m USING (x, y)""")
def blended_scales(spark, sf_dir):
    """Fine detail where it stands out against the coarse image, which is shown elsewhere."""
    p = _pixels(spark, sf_dir)
    square = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    m = grid.pairs(p, ["v"], square).groupBy("x", "y").agg(F.avg("n_v").alias("lo"))
    mask = F.least(F.greatest((F.pow(F.col("v") - F.col("lo"), 2) / F.greatest(F.col("lo"), F.lit(5.0)) - 0.01) / 0.19, F.lit(0.0)), F.lit(1.0))
    return p.join(m, ["x", "y"]).select("x", "y", F.round(F.col("lo") + (F.col("v") - F.col("lo")) * mask, 6).alias("v"))


@query(f"""WITH {_PIX}, m AS (SELECT a.x, a.y, max(b.v) FILTER (abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1) AS inner_top, max(b.v) FILTER (abs(a.x - b.x) = 2 OR abs(a.y - b.y) = 2) AS ring FROM pix a JOIN pix b ON abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 AND (a.x, a.y) <> (b.x, b.y) GROUP BY a.x, a.y)
SELECT x, y, round(CASE WHEN v >= inner_top AND v >= ring * 1.001 THEN ring * 1.0005 ELSE v END, 6) AS v FROM pix LEFT JOIN m USING (x, y)""")
def without_lone_peaks(spark, sf_dir):
    """Local maxima over the ring around them are clamped towards it."""
    p = _pixels(spark, sf_dir)
    near = (F.abs("dx") <= 1) & (F.abs("dy") <= 1)
    m = grid.window_pairs(p, ["v"], 2).groupBy("x", "y").agg(F.max(F.when(near, F.col("n_v"))).alias("inner_top"), F.max(F.when(~near, F.col("n_v"))).alias("ring"))
    v = F.when((F.col("v") >= F.col("inner_top")) & (F.col("v") >= F.col("ring") * 1.001), F.col("ring") * 1.0005).otherwise(F.col("v"))
    return p.join(m, ["x", "y"], "left").select("x", "y", F.round(v, 6).alias("v"))


_MESH = f"{_PIX}, sel AS (SELECT x, y, v FROM pix WHERE s >= 0.75), ids AS (SELECT *, (row_number() OVER (ORDER BY y, x) - 1)::BIGINT AS id FROM sel)"


def _vertices(spark, sf_dir):
    """Selected pixels with their number in line order: lines are counted first, then pixels within."""
    sel = _pixels(spark, sf_dir).where("s >= 0.75").select("x", "y", "v")
    lines = sel.groupBy("y").agg(F.count("*").alias("n"))  # as many rows as the image has lines
    before = lines.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("y").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("y", "before")
    own = sel.withColumn("own", F.row_number().over(Window.partitionBy("y").orderBy("x")))
    return own.join(before, "y").select("x", "y", "v", (F.col("own") + F.col("before") - 1).alias("id"))


@query(f"WITH {_MESH} SELECT id, x, y, round((x + 0.5) / 50, 6) AS u, round((40 - y - 0.5) / 40, 6) AS w FROM ids")
def mesh_vertices(spark, sf_dir):
    """Vertex numbers in line order, with texture coordinates."""
    return _vertices(spark, sf_dir).select("id", "x", "y", F.round((F.col("x") + 0.5) / 50, 6).alias("u"), F.round((40 - F.col("y") - 0.5) / 40, 6).alias("w"))


@query(f"""WITH {_MESH}, t AS (SELECT a.id AS a, b.id AS b, c.id AS c, a.v AS va, b.v AS vb, c.v AS vc FROM ids a JOIN ids b ON b.x = a.x + 1 AND b.y = a.y JOIN ids c ON c.x = a.x AND c.y = a.y + 1
UNION ALL SELECT b.id, d.id, c.id, b.v, d.v, c.v FROM ids b JOIN ids c ON c.x = b.x - 1 AND c.y = b.y + 1 JOIN ids d ON d.x = b.x AND d.y = b.y + 1)
SELECT a, b, c FROM t WHERE greatest(va, vb, vc) - least(va, vb, vc) <= 0.05 * (va + vb + vc) / 3""")
def mesh_triangles(spark, sf_dir):
    """Triangles over neighbouring vertices, without those across a step in disparity."""
    ids = _vertices(spark, sf_dir)
    to = lambda name, dx, dy: ids.select((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.col("id").alias(name), F.col("v").alias(f"v{name}"))
    upper = to("a", 0, 0).join(to("b", 1, 0), ["x", "y"]).join(to("c", 0, 1), ["x", "y"])
    lower = to("a", 0, 0).join(to("b", 0, 1), ["x", "y"]).join(to("c", -1, 1), ["x", "y"])
    t = upper.union(lower)
    spread = F.greatest("va", "vb", "vc") - F.least("va", "vb", "vc")
    return t.where(spread <= 0.05 * (F.col("va") + F.col("vb") + F.col("vc")) / 3).select("a", "b", "c")
