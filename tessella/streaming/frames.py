"""Frames as streams: windowed averages, deduplication, alignment of two streams in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir


def read_frames(spark: SparkSession, folder: str, files: str = "events.parquet", per_trigger: int = 1) -> DataFrame:
    """The event files of a folder as a stream of frames (frame_id, channel, ts, kind, value). `files` names
    one file or a folder of part files."""
    path = f"{folder}/{files}"
    schema = spark.read.parquet(path).schema
    # a stream takes a folder or a glob, not a file's own name: the last letter as a class makes it a glob
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")
    return events.select(F.col("event_id").alias("frame_id"), F.col("user_id").alias("channel"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), "value")


def windowed_average(frames: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Count, mean and extremes per channel and window; what comes later than `late` is left out and the
    window's state goes."""
    return frames.withWatermark("ts", late).groupBy(F.window("ts", width), "channel").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")
    ).select(F.col("window.start").alias("since"), "channel", "n", "mean", "low", "high")


def without_repeats(frames: DataFrame, late: str = "1 day") -> DataFrame:
    """Each frame once; ids are kept no longer than the watermark."""
    return frames.withWatermark("ts", late).dropDuplicatesWithinWatermark(["channel", "frame_id"])


def aligned(left: DataFrame, right: DataFrame, within: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Pairs of frames of one channel at most `within` apart, from two streams."""
    l = left.withWatermark("ts", late).select(F.col("channel").alias("c"), F.col("frame_id").alias("frame"), F.col("ts").alias("t"))  # noqa: E741
    r = right.withWatermark("ts", late).select("channel", F.col("frame_id").alias("other"), "ts")
    near = F.expr(f"c = channel AND ts >= t - INTERVAL {within} AND ts <= t + INTERVAL {within}")
    return l.join(r, near).select("channel", "frame", "other")


def span(spark: SparkSession, folder: str, files: str = "events.parquet") -> str:
    """A watermark delay that covers all frames of a finite table, however its files are ordered."""
    ts = F.col("ts").cast("timestamp")
    lo, hi = spark.read.parquet(f"{folder}/{files}").agg(F.unix_micros(F.min(ts)), F.unix_micros(F.max(ts))).first()
    return f"{0 if lo is None else (hi - lo) // 1_000_000 + 1} seconds"


def drained(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream gives for all its present input, written as Parquet batch by batch in the shared
    folder; a batch that is run again replaces its own files."""
    import uuid

    spark = df.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{'all' if mode == 'complete' else f'batch={k}'}")

    df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out/{'all' if mode == 'complete' else '*'}")
