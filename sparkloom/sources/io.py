"""Typed scans, bounded warehouse-style queries and sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_csv(spark: SparkSession, path: str, schema: str | None = None, datetimes: list[str] | None = None, header: bool = True, header_file: str | None = None) -> DataFrame:
    """A CSV file or folder, also gzipped.  Types are given, or inferred in a second scan; ``datetimes`` become timestamps.

    ``header_file`` has the columns' names, separated by commas or lines, for files without.
    """
    reader = spark.read.option("header", header and not header_file)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    if header_file:
        lines = [r[0] for r in spark.read.text(header_file).limit(10_000).collect()]  # names of columns, not data
        df = df.toDF(*[n.strip() for x in lines for n in x.split(",") if n.strip()])
    return df.withColumns({c: F.try_to_timestamp(F.col(c).cast("string")) for c in datetimes or []})


def scan(df: DataFrame, columns: list[str] | None = None, where: str | None = None, limit: int | None = None, offset: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Columns and rows of a table; limits need an order to be repeatable, so one is asked for."""
    if (limit or offset) and not order:
        raise ValueError("a limit or offset needs an order")
    out = df.where(where) if where else df
    out = out.orderBy(*order) if order else out
    out = out.offset(offset) if offset else out
    out = out.limit(limit) if limit else out
    return out.select(*columns) if columns else out


def row_count(df: DataFrame, where: str | None = None) -> int:
    return (df.where(where) if where else df).count()


def query(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """SQL over the given tables, named in braces: ``SELECT count(*) FROM {t}``."""
    return spark.sql(sql, **tables)


def json_fields(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON text column's fields as columns ``{column}_{field}``."""
    parsed = df.withColumn("__j", F.from_json(column, schema))
    return parsed.select(*df.columns, *[F.col(f"__j.{f}").alias(f"{column}_{f}") for f in parsed.schema["__j"].dataType.names])


def save_tensor(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_tensor(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_model(spark: SparkSession, path: str, params: dict) -> None:
    """Parameters as one JSON line, through Spark's writer, so any file system works."""
    spark.createDataFrame([(json.dumps(params),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
