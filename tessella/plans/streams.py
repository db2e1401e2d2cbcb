"""Queries that run as streams over their whole input, and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import sinks
from ..streaming import frames
from .views import TILE, tile

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query("SELECT date_trunc('day', ts) AS since, user_id AS channel, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY ALL")
def stream_window_average(spark, sf_dir):
    """Daily averages per channel, as a stream."""
    out = frames.windowed_average(frames.read_frames(spark, sf_dir))
    return frames.drained(out, "averages", "complete").withColumn("since", F.col("since").cast("timestamp_ntz"))


@query("SELECT DISTINCT user_id AS channel, event_id AS frame_id, value FROM events")
def stream_without_repeats(spark, sf_dir):
    """Each frame once, as a stream that reads its input twice over."""
    f = frames.read_frames(spark, sf_dir)
    return frames.drained(frames.without_repeats(f.union(f), frames.span(spark, sf_dir)).select("channel", "frame_id", "value"), "once")


@query("""SELECT a.user_id AS channel, a.event_id AS frame, b.event_id AS other FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'click' AND b.event_type = 'view'""")
def stream_alignment(spark, sf_dir):
    """Pairs of frames of two streams that lie near in time."""
    f = frames.read_frames(spark, sf_dir)
    g = frames.read_frames(spark, sf_dir)
    return frames.drained(frames.aligned(f.where("kind = 'click'"), g.where("kind = 'view'"), late=frames.span(spark, sf_dir)), "pairs")


@query(f"""WITH {TILE}, v AS (SELECT x // 10 AS cluster, (row_number() OVER (PARTITION BY x // 10 ORDER BY y, x) - 1) AS k, x, y, disparity FROM tile),
b AS (SELECT cluster, coalesce(sum(count(*)) OVER (ORDER BY cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v GROUP BY cluster)
SELECT cluster, 0 AS part, (before + k + 1)::BIGINT AS number, printf('v %.5f %.5f %.5f', x::DOUBLE, y::DOUBLE, disparity) AS line FROM v JOIN b USING (cluster)
UNION ALL SELECT cluster, 1, (before + k + 1)::BIGINT, printf('f %d %d %d', (before + k + 1)::BIGINT, (before + k + 2)::BIGINT, (before + k + 3)::BIGINT) FROM v JOIN b USING (cluster) WHERE k % 3 = 0 AND k + 2 < (SELECT count(*) FROM v w WHERE w.cluster = v.cluster)""")
def mesh_export(spark, sf_dir):
    """Lines of a mesh file whose vertices are counted across clusters."""
    from pyspark.sql import Window

    c = F.floor(F.col("x") / 10)
    v = tile(spark, sf_dir).withColumn("cluster", c).withColumn("k", F.row_number().over(Window.partitionBy("cluster").orderBy("y", "x")) - 1)
    v = v.withColumn("n", F.count("*").over(Window.partitionBy("cluster")))
    faces = v.where("k % 3 = 0 and k + 2 < n").select("cluster", F.col("k").alias("a"), (F.col("k") + 1).alias("b"), (F.col("k") + 2).alias("c"))
    double = lambda name: F.col(name).cast("double").alias(name)
    return sinks.mesh_lines(v.select("cluster", "k", double("x"), double("y"), F.col("disparity").alias("z")), faces)


@query(f"WITH {TILE} SELECT n_tile, CASE WHEN disparity >= 50 THEN NULL ELSE disparity END AS disparity, CASE WHEN disparity >= 50 THEN 0 ELSE (1 + least(greatest(floor((disparity - 10) / 38.0 * 254 + 0.5), 0), 254))::INT END AS level FROM tile")
def quantised_layer(spark, sf_dir):
    """A layer in 8 bits, clipped to a range, 0 for none."""
    d = F.when(F.col("disparity") < 50, F.col("disparity"))
    return tile(spark, sf_dir).select("n_tile", d.alias("disparity"), sinks.quantised(d, F.lit(10.0), F.lit(48.0)).alias("level"))
