"""Writers: meshes as text, tables as delimited files, training layers as quantised columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import checkpointed


def mesh_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(cluster, part, number, line) of a Wavefront mesh.

    vertices (cluster, k, x, y, z) and faces (cluster, a, b, c) count vertices from 0 within their
    cluster; the file counts all from 1. Clusters are counted within ranges, each a task's own; only the
    ranges' totals, as many as shuffle partitions, meet in one running total.
    """
    sizes = vertices.groupBy("cluster").agg(F.count("*").alias("n")).repartitionByRange("cluster")
    sizes = checkpointed(sizes.withColumn("range", F.spark_partition_id()))
    so_far = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sizes.groupBy("range").agg(F.sum("n").alias("n")).select("range", so_far(Window.orderBy("range")).alias("ahead"))
    within = sizes.withColumn("own", so_far(Window.partitionBy("range").orderBy("cluster")))
    before = within.join(F.broadcast(ranges), "range").select("cluster", (F.col("own") + F.col("ahead")).alias("before"))
    v = vertices.join(before, "cluster").select("cluster", F.lit(0).alias("part"), (F.col("before") + F.col("k") + 1).alias("number"), F.format_string("v %.5f %.5f %.5f", "x", "y", "z").alias("line"))
    at = lambda c: F.col("before") + F.col(c) + 1
    f = faces.join(before, "cluster").select("cluster", F.lit(1).alias("part"), at("a").alias("number"), F.format_string("f %d %d %d", at("a"), at("b"), at("c")).alias("line"))
    return v.union(f)


def write_mesh(lines: DataFrame, path: str, partitions: int = 8) -> None:
    """The lines as text files in order: vertices before faces, clusters in turn."""
    lines.repartitionByRange(partitions, "part", "cluster", "number").sortWithinPartitions("part", "cluster", "number").select("line").write.text(path)


def placemark(name: Column, lat: Column, lon: Column, alt: Column) -> Column:
    """A KML placemark of a position."""
    return F.concat(F.lit("<Placemark><name>"), name, F.lit("</name><Point><coordinates>"), F.format_string("%.7f,%.7f,%.3f", lon, lat, alt), F.lit("</coordinates></Point></Placemark>"))


def quantised(v: Column, low: Column, high: Column, levels: int = 254) -> Column:
    """1..levels + 1 of a value within [low, high], clipped; 0 where there is none."""
    return F.when(v.isNull(), 0).otherwise(1 + F.least(F.greatest(F.floor((v - low) / (high - low) * levels + 0.5), F.lit(0)), F.lit(levels))).cast("int")


def write_table(df: DataFrame, path: str) -> None:
    """Tab-separated with a header; nulls as ---."""
    df.write.option("sep", "\t").option("header", True).option("nullValue", "---").csv(path)


def write_calibration_xml(df: DataFrame, path: str, row: str, root: str) -> None:
    df.write.format("xml").option("rowTag", row).option("rootTag", root).save(path)
