"""Operators along an order: stencils, runs, alignment in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sharpened(value: Column, k: float, window) -> Column:
    """-k, 1 + 2k, -k along the window's order; the ends keep their value."""
    before, after = F.lag(value).over(window), F.lead(value).over(window)
    return F.when(before.isNull() | after.isNull(), value).otherwise(value * (1 + 2 * k) - k * (before + after))


def runs(df: DataFrame, key: list[str], order: list[str], state: Column, name: str = "run") -> DataFrame:
    """df with the number of each maximal run of equal states within a key (from 0), by order."""
    w = Window.partitionBy(*key).orderBy(*order)
    changed = F.coalesce((~state.eqNullSafe(F.lag(state).over(w))).cast("int"), F.lit(1))
    marked = df.withColumn("_new", F.when(F.row_number().over(w) == 1, 0).otherwise(changed))
    return marked.withColumn(name, F.sum("_new").over(w).cast("long")).drop("_new")


def latest_before(left: DataFrame, right: DataFrame, key: list[str], at: str, values: list[str], order: list[str]) -> DataFrame:
    """As-of join: each left row with the values of the last right row of its key at or before its time.

    Both sides meet in one sorted stream per key, so neither is broadcast and no pair is made; ties on
    time among right rows go to the largest `order`. `order` are columns of both sides.
    """
    l = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_v"))  # noqa: E741
    pad = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in {*key, at, *order} else F.col(f.name) for f in left.schema]
    r = right.select(*pad, F.lit(0).alias("_side"), F.struct(*values).alias("_v"))
    w = Window.partitionBy(*key).orderBy(at, "_side", *order).rowsBetween(Window.unboundedPreceding, 0)
    seen = l.unionByName(r).withColumn("_v", F.last("_v", ignorenulls=True).over(w))
    return seen.where("_side = 1").select(*left.columns, "_v.*")
