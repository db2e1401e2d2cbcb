"""Queries on 8x8 tiles, colours, geometry and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars, signal
from .views import MEAS, clt, meas, table

Q: dict = {}
SQL: dict[str, str] = {}
_CLT = "clt AS (SELECT vec_id AS n_tile, embedding::DOUBLE[] AS tile, label AS sensor FROM embeddings)"


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _separable(kind: str) -> str:
    b = {
        "dct2": "sqrt(0.25) * CASE WHEN k = 0 THEN sqrt(0.5) ELSE 1 END * cos(pi() * (2 * i + 1) * k / 16)",
        "dct4": "sqrt(0.25) * cos(pi() * (2 * i + 1) * (k + 0.5) / 16)",
        "dst4": "sqrt(0.25) * sin(pi() * (2 * i + 1) * (k + 0.5) / 16)",
    }
    rows, cols = kind.split("/")
    base = lambda n, e: f"{n} AS (SELECT k, i, {b[e]} AS w FROM (SELECT unnest(range(8)) AS k), (SELECT unnest(range(8)) AS i))"
    return f"""WITH {_CLT}, {base('r', rows)}, {base('c', cols)}, v AS (SELECT n_tile, unnest(range(64)) AS p, unnest(tile) AS v FROM clt)
SELECT n_tile, (r.k * 8 + c.k)::INT AS k, round(sum(v * r.w * c.w), 5) + 0 AS coefficient FROM v JOIN r ON r.i = p // 8 JOIN c ON c.i = p % 8 GROUP BY ALL"""


def _coefficients(spark, sf_dir, rows, cols):
    t = clt(spark, sf_dir).select("n_tile", F.posexplode(signal.applied(F.col("tile"), rows, cols)).alias("k", "v"))
    return t.select("n_tile", "k", (F.round("v", 5) + 0).alias("coefficient"))


@query(_separable("dct2/dct2"))
def tile_dct2(spark, sf_dir):
    """Cosine transform of kind 2 in both directions."""
    return _coefficients(spark, sf_dir, signal.dct_basis(2), signal.dct_basis(2))


@query(_separable("dct4/dct4"))
def tile_dct4(spark, sf_dir):
    """Cosine transform of kind 4 in both directions."""
    return _coefficients(spark, sf_dir, signal.dct_basis(4), signal.dct_basis(4))


@query(_separable("dst4/dct4"))
def tile_dst4_dct4(spark, sf_dir):
    """Sine transform down the columns, cosine along the rows."""
    return _coefficients(spark, sf_dir, signal.dst_basis(), signal.dct_basis(4))


@query(f"""WITH {_CLT}, m AS (SELECT n_tile, list_max(tile) AS top, list_position(tile, list_max(tile)) - 1 AS pos FROM clt),
v AS (SELECT n_tile, unnest(range(64)) AS p, greatest(unnest(tile), 0) AS w FROM clt), c AS (SELECT n_tile, sum(w * (p % 8)) / sum(w) AS cx, sum(w * (p // 8)) / sum(w) AS cy FROM v GROUP BY n_tile HAVING sum(w) > 0)
SELECT n_tile, CASE WHEN top >= 0.3 THEN (pos % 8)::INT END AS max_x, CASE WHEN top >= 0.3 THEN (pos // 8)::INT END AS max_y, CASE WHEN top >= 0.3 THEN top END AS max_value, round(cx, 6) AS cx, round(cy, 6) AS cy FROM m LEFT JOIN c USING (n_tile)""")
def tile_peaks(spark, sf_dir):
    """Position of the maximum and centre of mass of each tile."""
    p = clt(spark, sf_dir).select("n_tile", signal.position_of_max(F.col("tile"), 0.3).alias("m"), signal.centroid(F.col("tile")).alias("c"))
    return p.select("n_tile", F.col("m.x").alias("max_x"), F.col("m.y").alias("max_y"), F.col("m.value").alias("max_value"), F.round("c.x", 6).alias("cx"), F.round("c.y", 6).alias("cy"))


@query(f"""WITH {_CLT}, v AS (SELECT sensor, unnest(range(64)) AS p, unnest(tile) AS v FROM clt), t AS (SELECT sensor, CASE WHEN sensor % 2 = 1 THEN (p % 8) * 8 + p // 8 ELSE p END AS p, v FROM v)
SELECT sensor // 2 AS pair, p::INT AS p, round(avg(v), 6) AS mean FROM t WHERE p % 8 BETWEEN 2 AND 5 AND p // 8 BETWEEN 2 AND 5 GROUP BY ALL""")
def combined_pairs(spark, sf_dir):
    """Centre of the mean of compatible tiles, every other one transposed."""
    turned = F.when(F.col("sensor") % 2 == 1, signal.transposed(F.col("tile"))).otherwise(F.col("tile"))
    v = clt(spark, sf_dir).select(F.floor(F.col("sensor") / 2).cast("int").alias("pair"), F.posexplode(signal.centre(turned, 2, 5)).alias("q", "v"))
    return v.groupBy("pair", ((F.floor(F.col("q") / 4) + 2) * 8 + F.col("q") % 4 + 2).cast("int").alias("p")).agg(F.round(F.avg("v"), 6).alias("mean"))


@query(f"""WITH {MEAS} SELECT n_tile, pass_id, src, target, round((price - 50000) * z * 0.0022 / 4.5, 6) AS wx, round(-(n_tile - 1000) * z * 0.0022 / 4.5, 6) AS wy, round(-z, 6) AS wz
FROM (SELECT *, CASE WHEN target > 10 THEN 4.5 * 0.26 * 1000 / ((target - 10) * 2.2) END AS z FROM meas)""")
def world_coordinates(spark, sf_dir):
    """Metres of a pixel of known disparity; null at infinity."""
    w = scalars.world(F.col("price"), F.col("n_tile"), F.col("target") - 10, 4.5, 0.26, 2.2, 50000, 1000)
    return meas(spark, sf_dir).select("n_tile", "pass_id", "src", "target", *(F.round(v, 6).alias(n) for v, n in zip(w, ("wx", "wy", "wz"), strict=True)))


@query(f"""WITH {MEAS}, r AS (SELECT n_tile, pass_id, src, target, strength + 2 * (1 - 0.299) * resid AS r, strength + 2 * (1 - 0.114) * (resid / 2) AS b, strength FROM meas)
SELECT n_tile, pass_id, src, target, round(r, 6) AS r, round((strength - 0.299 * r - 0.114 * b) / (1 - 0.299 - 0.114), 6) AS g, round(b, 6) AS b, round(CASE WHEN strength < 0.05 THEN strength * pow(0.05, -0.5) ELSE pow(strength, 0.5) END, 6) AS gamma FROM r""")
def colour_conversion(spark, sf_dir):
    """Luma and colour differences to red, green, blue; gamma with a linear toe."""
    c = scalars.rgb(F.col("strength"), F.col("resid") / 2, F.col("resid"))
    return meas(spark, sf_dir).select("n_tile", "pass_id", "src", "target", *(F.round(v, 6).alias(n) for v, n in zip(c, "rgb", strict=True)), F.round(scalars.gamma(F.col("strength"), 0.5, 0.05), 6).alias("gamma"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(name, '[-_][0-9]{1,3}\\.[^.]*$') THEN regexp_extract(name, '[-_]([0-9]{1,3})\\.[^.]*$', 1)::INT END AS channel, list_sum(list_transform(regexp_split_to_array(nums, '\\s*,\\s*|\\s+'), lambda x: x::DOUBLE)) AS total
FROM (SELECT p_partkey, replace(p_name, ' ', '_') || CASE WHEN p_size % 3 = 0 THEN '.jp4' ELSE '-' || (p_size % 100)::VARCHAR || '.jp4' END AS name, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR || ', 2,3' ELSE p_size::VARCHAR || ' 2 3.5' END AS nums FROM part)""")
def parsed_names(spark, sf_dir):
    """Channel numbers of file names, and lists of numbers parted by commas or blanks."""
    size = F.col("p_size").cast("string")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("p_size") % 3 == 0, ".jp4").otherwise(F.concat(F.lit("-"), (F.col("p_size") % 100).cast("string"), F.lit(".jp4"))))
    nums = F.when(F.col("p_size") % 2 == 0, F.concat(size, F.lit(", 2,3"))).otherwise(F.concat(size, F.lit(" 2 3.5")))
    p = table(spark, sf_dir, "part").select("p_partkey", scalars.channel_of(name).alias("channel"), scalars.numbers(nums).alias("n"))
    return p.select("p_partkey", "channel", F.aggregate("n", F.lit(0.0), lambda s, v: s + v).alias("total"))


@query(f"""WITH {_CLT}, v AS (SELECT n_tile, unnest(range(64)) AS p, unnest(tile) AS v FROM clt), s AS (SELECT unnest(range(64)) AS s)
SELECT a.n_tile, s.s::INT AS shift, round(sum(a.v * b.v), 5) + 0 AS correlation FROM v a, s, v b WHERE a.n_tile % 2 = 0 AND b.n_tile = a.n_tile + 1 AND b.p = ((a.p // 8 + s.s // 8) % 8) * 8 + (a.p % 8 + s.s % 8) % 8 GROUP BY ALL""")
def tile_correlation(spark, sf_dir):
    """Cross-correlation of each even tile with the next one, over all circular shifts."""
    from ..operators import correlation

    t = clt(spark, sf_dir).select("n_tile", "tile")
    a, b = t.where("n_tile % 2 = 0"), t.select((F.col("n_tile") - 1).alias("n_tile"), F.col("tile").alias("other"))
    c = a.join(b, "n_tile").select("n_tile", F.posexplode(correlation.correlated(F.col("tile"), F.col("other"))).alias("shift", "v"))
    return c.select("n_tile", "shift", (F.round("v", 5) + 0).alias("correlation"))
