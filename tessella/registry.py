"""Queries of the library's own operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import candidates, estimates, fitting, lapping, layered, optics, pixels, poles, selection, series, shapes, signals, streams, surfaces

FLAGSHIP = "dsi_histogram"
_ALL = (candidates, estimates, fitting, lapping, layered, optics, pixels, poles, selection, series, shapes, signals, streams, surfaces)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for plan in _ALL for name, f in plan.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in _ALL for name, sql in plan.SQL.items()}
