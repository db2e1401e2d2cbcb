"""Queries on lapped transforms; each pass of the stand-in is an image of 40 columns, its lines counted on by src."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lapped
from .views import MEAS, meas

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


WIDTH = 40
_ACROSS = WIDTH // 8 - 1
#: Tiles of every image by two separable sums; b is the windowed base, d and a say cosine (0) or sine down and across.
_CLT = f"""{MEAS}, pix AS (SELECT pass_id AS image, src % {WIDTH} AS x, src // {WIDTH} AS y, max(target) AS v FROM meas GROUP BY ALL), h AS (SELECT max(y) + 1 AS h FROM pix),
b AS (SELECT c, k, i, 0.5 * sin(pi() / 16 * (i + 0.5)) * CASE WHEN c = 0 THEN cos(pi() / 8 * (i + 4.5) * (k + 0.5)) ELSE sin(pi() / 8 * (i + 4.5) * (k + 0.5)) END AS w
  FROM (SELECT unnest([0, 1]) AS c), (SELECT unnest(range(8)) AS k), (SELECT unnest(range(16)) AS i)),
lines AS (SELECT image, y, tx, c AS a, k AS m, sum(v * w) AS v FROM (SELECT image, y, v, x // 8 - o AS tx, x % 8 + 8 * o AS i FROM pix, (VALUES (0), (1)) AS l(o)) JOIN b USING (i) WHERE tx BETWEEN 0 AND {_ACROSS - 1} GROUP BY ALL),
clt AS (SELECT image, ty, tx, c AS d, a, k, m, sum(v * w) AS v FROM (SELECT image, tx, a, m, v, y // 8 - o AS ty, y % 8 + 8 * o AS i FROM lines, (VALUES (0), (1)) AS l(o)) JOIN b USING (i), h WHERE ty BETWEEN 0 AND h // 8 - 2 GROUP BY ALL)"""


def _images(spark, sf_dir):
    """(image, x, y, v) and the images' height."""
    line, column = F.expr(f"src div {WIDTH}").alias("y"), (F.col("src") % WIDTH).alias("x")
    pixels = meas(spark, sf_dir).groupBy(F.col("pass_id").alias("image"), column, line).agg(F.max("target").alias("v"))
    return pixels, pixels.agg(F.max("y")).first()[0] + 1


@query(f"WITH {_CLT} SELECT image, ty, tx, (d * 128 + a * 64 + k * 8 + m)::INT AS place, round(v, 5) + 0 AS coefficient FROM clt")
def lapped_tiles(spark, sf_dir):
    """All coefficients of the overlapping tiles of every image."""
    pixels, height = _images(spark, sf_dir)
    t = lapped.transformed(pixels, "image", WIDTH, height)
    return t.select("image", "ty", "tx", F.posexplode("clt").alias("place", "v")).select("image", "ty", "tx", "place", (F.round("v", 5) + 0).alias("coefficient"))


@query(f"""WITH {MEAS}, pix AS (SELECT pass_id AS image, src % {WIDTH} AS x, src // {WIDTH} AS y, max(target) AS v FROM meas GROUP BY ALL), h AS (SELECT max(y) + 1 AS h FROM pix)
SELECT i.image, a.x, c.y, round(coalesce(v, 0), 6) + 0 AS v FROM (SELECT DISTINCT image FROM pix) i, (SELECT unnest(range(8, {8 * _ACROSS})) AS x) a, (SELECT unnest(range(8, 8 * (h // 8 - 1))) AS y FROM h) c LEFT JOIN pix ON pix.image = i.image AND pix.x = a.x AND pix.y = c.y""")
def lapped_restored(spark, sf_dir):
    """Images through the transform and back: every pixel that all its tiles cover."""
    pixels, height = _images(spark, sf_dir)
    tiles = lapped.transformed(pixels, "image", WIDTH, height)
    return lapped.restored(tiles, "image", WIDTH, height).select("image", "x", "y", (F.round("v", 6) + 0).alias("v"))


@query(f"""WITH {_CLT}, e AS (SELECT image, ty, tx, k, m, sum(v * v) AS s FROM clt GROUP BY ALL),
n AS (SELECT p.image, ty, tx, k, m, sqrt(p.s * q.s) AS n, avg(sqrt(p.s * q.s)) OVER (PARTITION BY p.image, ty, tx) * 0.01 AS fat FROM e p JOIN e q USING (ty, tx, k, m) WHERE q.image = p.image + 1),
c AS (SELECT p.image, ty, tx, k, m, xor(p.d, q.d) AS d, xor(p.a, q.a) AS a, sum(p.v * q.v * CASE WHEN p.d = 1 AND q.d = 0 THEN -1 ELSE 1 END * CASE WHEN p.a = 1 AND q.a = 0 THEN -1 ELSE 1 END) AS v FROM clt p JOIN clt q USING (ty, tx, k, m) WHERE q.image = p.image + 1 GROUP BY ALL),
r AS (SELECT c, s, k, CASE WHEN c = 0 THEN cos(pi() / 8 * s * (k + 0.5)) ELSE sin(pi() / 8 * s * (k + 0.5)) END / 8 AS w FROM (SELECT unnest([0, 1]) AS c), (SELECT unnest(range(-7, 8)) AS s), (SELECT unnest(range(8)) AS k)),
u AS (SELECT image, ty, tx, m, a, r.s AS sy, sum(v / (n.n + n.fat) * w) AS v FROM c JOIN n USING (image, ty, tx, k, m) JOIN r ON r.c = c.d AND r.k = c.k GROUP BY ALL)
SELECT image, ty, tx, ((sy + 7) * 15 + r.s + 7)::INT AS place, round(sum(v * w), 5) + 0 AS fit FROM u JOIN r ON r.c = u.a AND r.k = u.m GROUP BY ALL""")
def lapped_correlation(spark, sf_dir):
    """Phase correlation of each image's tiles with the next image's, by shift."""
    pixels, height = _images(spark, sf_dir)
    t = lapped.transformed(pixels, "image", WIDTH, height)
    both = t.withColumnRenamed("clt", "first").join(t.select((F.col("image") - 1).alias("image"), "ty", "tx", F.col("clt").alias("second")), ["image", "ty", "tx"])
    fit = lapped.by_shift(lapped.correlated(F.col("first"), F.col("second"), 0.1))
    return both.select("image", "ty", "tx", F.posexplode(fit).alias("place", "v")).select("image", "ty", "tx", "place", (F.round("v", 5) + 0).alias("fit"))
