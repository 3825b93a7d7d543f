"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name; ``sql`` is its DuckDB twin."""

    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(x: Column, digits: int = 6) -> Column:
    """Rounded, with zero unsigned, so that engines agree on the last digits."""
    return F.round(x, digits) + 0.0


def named(**columns: Column) -> list[Column]:
    return [c.alias(k) for k, c in columns.items()]
