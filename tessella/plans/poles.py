"""Queries on poles and periods: each pass of the stand-in is a scene of its own for poles; periods go over all passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import periods, poles
from ..shared import written
from .views import MEAS, meas

Q: dict = {}
SQL: dict[str, str] = {}

_SEEDS = f"""{MEAS}, t AS (SELECT pass_id AS scene, n_tile AS tile, x, y, max(target) AS disparity, max(strength) AS strength FROM meas GROUP BY ALL),
s AS (SELECT *, avg(disparity) OVER (PARTITION BY scene, x ORDER BY y ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS below FROM t),
seed AS (SELECT * FROM s WHERE strength > 0.2 AND disparity > 20 AND disparity >= below + 2 + 0.05 * disparity)"""


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _tiles(spark, sf_dir) -> DataFrame:
    keys = (F.col("pass_id").cast("long").alias("scene"), F.col("n_tile").alias("tile"), "x", "y")
    return meas(spark, sf_dir).groupBy(*keys).agg(F.max("target").alias("disparity"), F.max("strength").alias("strength"))


def seeds(tiles: DataFrame) -> DataFrame:
    below = F.avg("disparity").over(Window.partitionBy("scene", "x").orderBy("y").rowsBetween(1, 3))
    return tiles.withColumn("below", below).where("strength > 0.2 and disparity > 20 and disparity >= below + 2 + 0.05 * disparity").drop("below")


def _clusters(spark, sf_dir) -> DataFrame:
    found = written(seeds(_tiles(spark, sf_dir)))
    return poles.boxes(found, poles.first_fit(found, 1.5, 4.0, 3.0), side=1, up=1, down=6)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("disparity", "x", "y", "strength")})


@query(None)
def pole_clusters(spark, sf_dir):
    """Seeds of poles gathered first fit, in raster order, by running means across, along and in disparity."""
    return _rounded(_clusters(spark, sf_dir))


@query(None)
def merged_poles(spark, sf_dir):
    """Clusters of poles whose extended boxes cross at about one disparity, merged in order of disparity."""
    return _rounded(poles.merged(_clusters(spark, sf_dir), 1.5))


@query(None)
def pole_layers(spark, sf_dir):
    """A layer for each cluster of poles, so that boxes of a layer never cross."""
    return poles.layered(_clusters(spark, sf_dir))


@query(f"""WITH {_SEEDS}, c AS (SELECT scene, tile AS cluster, y, x - 3 AS edge, unnest(range(x - 3, x + 4)) AS cx FROM seed),
p AS (SELECT c.scene, c.cluster, cx - edge AS pos, round(coalesce(sum(t.strength), 0), 9) AS h FROM c LEFT JOIN t ON t.scene = c.scene AND t.x = c.cx AND t.y BETWEEN c.y - 1 AND c.y + 6 GROUP BY ALL),
m AS (SELECT *, CASE WHEN h > 0 AND h >= coalesce(lag(h) OVER w, h) AND h >= coalesce(lead(h) OVER w, h) THEN pos END AS peak FROM p WINDOW w AS (PARTITION BY scene, cluster ORDER BY pos)),
g AS (SELECT *, max(peak) OVER (w ROWS UNBOUNDED PRECEDING) AS l, min(peak) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM m WINDOW w AS (PARTITION BY scene, cluster ORDER BY pos)),
gap AS (SELECT scene, cluster, l, r, count(*) AS n, arg_min(pos, h * 1000 + pos / 1000.0) AS low, min(h) AS least FROM g WHERE peak IS NULL AND l IS NOT NULL AND r IS NOT NULL GROUP BY ALL),
good AS (SELECT * FROM gap WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY scene, cluster ORDER BY l) = 1)
SELECT b.scene::BIGINT AS scene, b.cluster, ((low + coalesce(min(pos) FILTER (WHERE pos > low AND pos < r AND h > least), r) + 1) // 2)::BIGINT AS cut
FROM good b JOIN p ON p.scene = b.scene AND p.cluster = b.cluster GROUP BY b.scene, b.cluster, low, r""")
def pole_cuts(spark, sf_dir):
    """Where boxes around seeds fall into two by their profile of strengths across."""
    t = written(_tiles(spark, sf_dir))
    box = seeds(t).select("scene", F.col("tile").alias("cluster"), (F.col("x") - 3).alias("left"), (F.col("x") + 3).alias("right"), (F.col("y") - 1).alias("top"), (F.col("y") + 6).alias("bottom"))
    return poles.cuts(box, t.select("scene", "x", "y", "strength"), 2, False)


@query(None)
def periodic_tiles(spark, sf_dir):
    """Tiles whose maxima of disparity over all passes and neighbours repeat at equal distances."""
    found = periods.periods(meas(spark, sf_dir), trusted=0.05, floor=0.1, over=0.3, join=1.0, apart=4.0, repeats=2, tolerance=1.0)
    return found.withColumns({c: F.round(c, 6) for c in ("base", "period", "strength")})
