"""Registered queries of the library and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.plans import blocks, elementwise, large, layers, signals, tables  # noqa: F401  they register their queries
from sparkloom.plans.base import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.robust_numeric_features(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
