"""Choosing among the passes that measured a tile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The found residual as a share of the true one.
GAIN = 0.85


def first_by(order: list[Column], value: Column, when: Column) -> Column:
    """value of the row that is least by order among those where `when` holds."""
    return F.min_by(F.when(when, value), F.when(when, F.struct(*order)))


def composite(meas: DataFrame, strong: float) -> DataFrame:
    """Per tile the best pass: of the strong ones that with the smallest residual, else the strongest;
    its disparity is target + residual / GAIN. Ties go to the earlier pass, then the smaller src."""
    row = F.struct("pass_id", (F.col("target") + F.col("resid") / GAIN).alias("disparity"), "strength")
    is_strong = F.col("strength") >= strong
    best = meas.groupBy("n_tile").agg(
        first_by([F.abs("resid"), F.col("pass_id"), F.col("src"), F.col("target")], row, is_strong).alias("a"),
        first_by([-F.col("strength"), F.col("pass_id"), F.col("src"), F.col("target")], row, F.lit(True)).alias("b"),
    )
    return best.select("n_tile", F.col("a").isNotNull().alias("is_strong"), F.coalesce("a", "b").alias("r")).select("n_tile", "is_strong", "r.pass_id", "r.disparity", "r.strength")


def unique(candidates: DataFrame, measured: DataFrame, tolerance: float, most: float) -> DataFrame:
    """Candidates (n_tile, target) in (0, most] that no measured pass of the tile has tried, nor closer
    than the tolerance; a tile with an unknown target is done with."""
    tried = measured.select(F.col("n_tile").alias("t"), F.col("target").alias("d"))
    near = (F.col("n_tile") == F.col("t")) & (F.col("d").isNull() | (F.abs(F.col("target") - F.col("d")) < tolerance))
    return candidates.where((F.col("target") > 0) & (F.col("target") <= most)).join(tried, near, "left_anti")


def next_free(candidates: DataFrame, measured: DataFrame, step: float, tries: int, tolerance: float, most: float) -> DataFrame:
    """Per candidate the nearest untried disparity at multiples of the step: upwards first, then down;
    null where none of the tries is free and in (0, most]."""
    k = F.explode(F.array(*(F.lit(i) for i in (*range(0, tries + 1), *range(-1, -tries - 1, -1)))))
    order = F.when(F.col("k") >= 0, F.col("k")).otherwise(tries - F.col("k"))
    options = candidates.select("n_tile", F.col("target").alias("wanted"), k.alias("k")).withColumn("target", F.col("wanted") + F.col("k") * step)
    free = unique(options, measured, tolerance, most).groupBy("n_tile", "wanted").agg(F.min_by("target", order).alias("free"))
    return candidates.select("n_tile", F.col("target").alias("wanted")).join(free, ["n_tile", "wanted"], "left")
