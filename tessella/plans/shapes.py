"""Queries on selections of the grid: morphology, clusters, set algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid
from .views import TILE, tile

Q: dict = {}
SQL: dict[str, str] = {}

_SEL = f"{TILE}, sel AS (SELECT x, y FROM tile WHERE disparity >= 50 AND strength >= 0.8), ok AS (SELECT x, y FROM tile WHERE n > 22)"
_GROW = """g1 AS (SELECT DISTINCT s.x + d AS x, s.y FROM {0} s, (SELECT unnest([-1, 0, 1]) AS d) SEMI JOIN {1} o ON o.x = s.x + d AND o.y = s.y),
g2 AS (SELECT DISTINCT s.x, s.y + d AS y FROM g1 s, (SELECT unnest([-1, 0, 1]) AS d) SEMI JOIN {1} o ON o.x = s.x AND o.y = s.y + d)"""


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _selected(t):
    return t.where("disparity >= 50 and strength >= 0.8").select("x", "y")


@query(f"WITH {_SEL}, {_GROW.format('sel', 'ok')} SELECT x, y FROM g2")
def grown_selection(spark, sf_dir):
    """A selection grown by one tile all around, within the allowed tiles."""
    t = tile(spark, sf_dir)
    return grid.grow(_selected(t), 2, t.where("n > 22"))


@query(f"WITH {_SEL}, wide AS (SELECT x, y FROM tile WHERE disparity >= 30), rest AS (SELECT x, y FROM tile ANTI JOIN wide USING (x, y)), {_GROW.format('rest', 'tile')} SELECT x, y FROM wide ANTI JOIN g2 USING (x, y)")
def shrunk_selection(spark, sf_dir):
    """A selection without the tiles next to unselected ones."""
    t = tile(spark, sf_dir)
    return grid.shrink(t.where("disparity >= 30").select("x", "y"), 2, t)


@query(f"""WITH {_SEL}, a AS (SELECT s.x, s.y FROM sel s JOIN sel n ON abs(n.x - s.x) <= 1 AND abs(n.y - s.y) <= 1 AND (n.x, n.y) <> (s.x, s.y) GROUP BY ALL HAVING count(*) >= 2),
b AS (SELECT s.x, s.y FROM a s JOIN a n ON abs(n.x - s.x) <= 1 AND abs(n.y - s.y) <= 1 AND (n.x, n.y) <> (s.x, s.y) GROUP BY ALL HAVING count(*) >= 2) SELECT x, y FROM b""")
def without_few_neighbours(spark, sf_dir):
    """Tiles of enough selected neighbours, twice over."""
    return grid.prune_few_neighbours(_selected(tile(spark, sf_dir)), 2, 2)


@query(f"""WITH RECURSIVE {_SEL}, reach AS (SELECT x, y, x AS tx, y AS ty FROM sel UNION SELECT r.x, r.y, n.x, n.y FROM reach r JOIN sel n ON abs(n.x - r.tx) + abs(n.y - r.ty) = 1),
lab AS (SELECT x, y, min(ty * 4294967296 + tx) AS cluster FROM reach GROUP BY x, y), size AS (SELECT cluster, count(*) AS n FROM lab GROUP BY cluster HAVING count(*) >= 2)
SELECT x, y, cluster, n FROM lab JOIN size USING (cluster)""")
def large_clusters(spark, sf_dir):
    """Connected tiles with their cluster and its size, without single tiles."""
    c = grid.clusters(_selected(tile(spark, sf_dir)))
    return c.join(c.groupBy("cluster").agg(F.count("*").alias("n")).where("n >= 2"), "cluster").select("x", "y", "cluster", "n")


@query(f"WITH {_SEL}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(x + y) AS s0, max(x + y) AS s1, min(x - y) AS d0, max(x - y) AS d1 FROM sel) SELECT x, y, x + y BETWEEN s0 AND s1 AND x - y BETWEEN d0 AND d1 AS in_octagon FROM tile, b WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
def bounding_shape(spark, sf_dir):
    """Tiles in the bounding box, and whether in the octagon too; the bounds are one row."""
    t = tile(spark, sf_dir)
    both, diff = F.col("x") + F.col("y"), F.col("x") - F.col("y")
    b = _selected(t).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min(both).alias("s0"), F.max(both).alias("s1"), F.min(diff).alias("d0"), F.max(diff).alias("d1"))
    return t.join(F.broadcast(b)).where("x between x0 and x1 and y between y0 and y1").select("x", "y", (both.between(F.col("s0"), F.col("s1")) & diff.between(F.col("d0"), F.col("d1"))).alias("in_octagon"))


@query(f"""WITH {TILE}, k AS (SELECT * FROM (VALUES (0, 0.5), (-1, -0.125), (1, -0.125)) AS v(dx, w)), l AS (SELECT unnest([-1, 0, 1]) AS dy),
c AS (SELECT a.n_tile, sum(b.disparity * k.w * CASE WHEN l.dy = 0 THEN 1.0 ELSE 0.5 END) AS v, count(*) AS m FROM tile a, k, l, tile b WHERE b.x = a.x + k.dx AND b.y = a.y + l.dy GROUP BY a.n_tile)
SELECT tile.n_tile, round(CASE WHEN m = 9 THEN v ELSE disparity END, 6) AS vertical FROM tile JOIN c USING (n_tile)""")
def vertical_features(spark, sf_dir):
    """Convolution with a kernel for vertical edges; margins keep their value."""
    t = tile(spark, sf_dir)
    square = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    w = F.when(F.col("dx") == 0, 0.5).otherwise(-0.125) * F.when(F.col("dy") == 0, 1.0).otherwise(0.5)
    c = grid.pairs(t, ["disparity"], square).groupBy("x", "y").agg(F.sum(F.col("n_disparity") * w).alias("v"), F.count("*").alias("k"))
    return t.join(c, ["x", "y"]).select("n_tile", F.round(F.when(F.col("k") == 9, F.col("v")).otherwise(F.col("disparity")), 6).alias("vertical"))


def _grown(source: str, allowed: str, out: str) -> str:
    """Two growing steps as common table expressions."""
    return f"""{out}_h AS (SELECT DISTINCT s.x + d AS x, s.y FROM {source} s, (SELECT unnest([-1, 0, 1]) AS d) SEMI JOIN {allowed} o ON o.x = s.x + d AND o.y = s.y),
{out} AS (SELECT DISTINCT s.x, s.y + d AS y FROM {out}_h s, (SELECT unnest([-1, 0, 1]) AS d) SEMI JOIN {allowed} o ON o.x = s.x AND o.y = s.y + d)"""


_CLOSED = f"""{TILE}, few AS (SELECT x, y FROM tile WHERE strength >= 0.79), {_grown('few', 'tile', 'g')}, rest AS (SELECT x, y FROM tile ANTI JOIN g USING (x, y)), {_grown('rest', 'tile', 'r')},
filled AS (SELECT x, y FROM g ANTI JOIN r USING (x, y) UNION SELECT x, y FROM few)"""


@query(f"WITH {_CLOSED} SELECT x, y FROM filled")
def closed_selection(spark, sf_dir):
    """A selection with its small gaps filled."""
    t = tile(spark, sf_dir)
    return grid.closed(t.where("strength >= 0.79"), 2, t)


@query(f"""WITH {_CLOSED}, gaps AS (SELECT x, y FROM filled ANTI JOIN few USING (x, y)), bad AS (SELECT x, y FROM gaps SEMI JOIN (SELECT x, y FROM tile WHERE disparity < 46) USING (x, y)), {_grown('bad', 'gaps', 'spoilt')}
SELECT x, y FROM filled ANTI JOIN spoilt USING (x, y)""")
def closed_around_poison(spark, sf_dir):
    """The same, but for gaps near tiles that forbid it."""
    t = tile(spark, sf_dir)
    return grid.closed(t.where("strength >= 0.79"), 2, t, t.where("disparity < 46"))


@query(f"""WITH RECURSIVE {TILE}, c AS (SELECT x, y, disparity AS v FROM tile WHERE weakest <= 0.05), reach AS (SELECT x, y, v FROM c WHERE v >= 50 AND x % 3 = 0
UNION SELECT n.x, n.y, n.v FROM reach r JOIN c n ON abs(n.x - r.x) <= 1 AND abs(n.y - r.y) <= 1 AND (n.x, n.y) <> (r.x, r.y) AND abs(r.v - n.v) <= 0.4 + 0.01 * r.v) SELECT x, y FROM reach""")
def trusted_by_hysteresis(spark, sf_dir):
    """Tiles that trust reaches from sure ones over neighbours of like disparity."""
    c = tile(spark, sf_dir).where("weakest <= 0.05").select("x", "y", F.col("disparity").alias("value"))
    return grid.spread(c.where("value >= 50 and x % 3 = 0"), c, 0.4, 0.01)


@query(f"""WITH RECURSIVE {_SEL}, reach AS (SELECT x, y, x AS tx, y AS ty FROM sel UNION SELECT r.x, r.y, n.x, n.y FROM reach r JOIN sel n ON abs(n.x - r.tx) + abs(n.y - r.ty) = 1),
lab AS (SELECT x, y, min(ty * 4294967296 + tx) AS cluster FROM reach GROUP BY x, y), w AS (SELECT lab.*, resid + 0.05 AS weight FROM lab JOIN tile USING (x, y)),
good AS (SELECT cluster FROM w GROUP BY cluster HAVING count(*) >= 2 AND sum(round(weight, 4)) >= 0 AND max(weight) >= 0) SELECT x, y, round(weight, 4) AS weight FROM w SEMI JOIN good USING (cluster)""")
def clusters_of_weight(spark, sf_dir):
    """Tiles of clusters of enough tiles and weight."""
    t = tile(spark, sf_dir).where("disparity >= 50 and strength >= 0.8").select("x", "y", F.round(F.col("resid") + 0.05, 4).alias("weight"))
    return grid.without_small_clusters(t, 2)


def _bigger(flag: str, least: int, out: str) -> str:
    """Tiles of eight-way clusters of a flag with enough tiles."""
    return f"""{out}_r AS (SELECT x, y, x AS tx, y AS ty FROM mark WHERE {flag} UNION SELECT r.x, r.y, n.x, n.y FROM {out}_r r JOIN mark n ON n.{flag} AND abs(n.x - r.tx) <= 1 AND abs(n.y - r.ty) <= 1),
{out} AS (SELECT x, y FROM {out}_r GROUP BY x, y HAVING count(*) >= {least})"""


@query(f"""WITH RECURSIVE {TILE}, mark AS (SELECT x, y, abs(disparity - 47) < 2 AND round(strength + resid, 4) >= 0.75 AS seed, disparity - 47 >= 2 AND round(strength + resid, 4) > 0.75 AS front,
  list_sort([resid + 0.05, strength - weakest, (disparity * 7 + n_tile) % 11 / 11, (n * 5 + n_tile) % 13 / 13], 'DESC')[2] > 0.72 AS block FROM tile),
{_bigger('seed', 3, 'seeds')}, {_bigger('front', 2, 'fronts')},
room AS (SELECT m.x, m.y FROM mark m LEFT JOIN fronts f USING (x, y) LEFT JOIN seeds s USING (x, y) WHERE s.x IS NOT NULL OR NOT (f.x IS NOT NULL OR m.block)),
reach AS (SELECT x, y FROM seeds UNION SELECT n.x, n.y FROM reach r JOIN room n ON abs(n.x - r.x) + abs(n.y - r.y) = 1) SELECT x, y FROM reach""")
def background_mask(spark, sf_dir):
    """Tiles that the background reaches from sure tiles, between foreground and what two channels deny."""
    t = tile(spark, sf_dir)
    differences = F.array(F.col("resid") + 0.05, F.col("strength") - F.col("weakest"), (F.col("disparity") * 7 + F.col("n_tile")) % 11 / 11, (F.col("n") * 5 + F.col("n_tile")) % 13 / 13)
    seen = t.select("x", "y", (F.col("disparity") - 47).alias("disparity"), F.round(F.col("strength") + F.col("resid"), 4).alias("strength"), differences.alias("differences"))
    return grid.background(seen, 2.0, 0.75, 0.75, 0.72, 3, 2)
