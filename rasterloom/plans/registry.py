"""All queries of the raster engine by operator ID, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from rasterloom.plans import base

for _module in ("scans", "projections", "joins", "aggregates", "windows", "geo", "streams"):
    import_module(f"rasterloom.plans.{_module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.QUERIES["B29_confidence"](spark, sf_dir)
