"""Tables as the operators see them: measurements of tiles in passes, frames of channels, 8x8 tiles.

A measurement pass gives each tile a target disparity, the residual found there and its strength. Rows
carry src, so that ties break the same way everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 50

MEAS = f"""meas AS (
  SELECT l_linenumber AS pass_id, l_partkey AS n_tile, l_partkey % {WIDTH} AS x, l_partkey // {WIDTH} AS y, l_quantity AS target,
    round(l_discount - 0.05, 4) AS resid, round(l_tax * 10, 4) AS strength, l_orderkey AS src, l_extendedprice AS price FROM lineitem)"""
TILE = f"""{MEAS}, tile AS (
  SELECT n_tile, x, y, max(target) AS disparity, max(strength) AS strength, min(strength) AS weakest, min(resid) AS resid, count(*) AS n
  FROM meas GROUP BY n_tile, x, y)"""
FRAME = "frame AS (SELECT event_id AS frame_id, user_id AS channel, ts, event_type AS kind, value FROM events)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def meas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("pass_id"), F.col("l_partkey").alias("n_tile"), (F.col("l_partkey") % WIDTH).alias("x"), F.expr(f"l_partkey div {WIDTH}").alias("y"),
        F.col("l_quantity").alias("target"), F.round(F.col("l_discount") - 0.05, 4).alias("resid"), F.round(F.col("l_tax") * 10, 4).alias("strength"),
        F.col("l_orderkey").alias("src"), F.col("l_extendedprice").alias("price"),
    )


def tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meas(spark, sf_dir).groupBy("n_tile", "x", "y").agg(
        F.max("target").alias("disparity"), F.max("strength").alias("strength"), F.min("strength").alias("weakest"), F.min("resid").alias("resid"), F.count("*").alias("n")
    )


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("frame_id"), F.col("user_id").alias("channel"), "ts", F.col("event_type").alias("kind"), "value")


def clt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("n_tile"), F.col("embedding").cast("array<double>").alias("tile"), F.col("label").alias("sensor"))
