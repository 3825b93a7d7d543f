"""Tensor algebra on coordinate tables.

A matrix is rows ``i, j, v`` and a vector ``i, v``.  Products are joins with a partial
aggregate, scatters are grouped aggregates, reshapes are arithmetic on coordinates, so
nothing is ever gathered in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def matvec(a: DataFrame, x: DataFrame) -> DataFrame:
    right = x.select(F.col("i").alias("j"), F.col("v").alias("y"))
    return a.join(right, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("y")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def reshape(a: DataFrame, cols: int, new_cols: int) -> DataFrame:
    """Row-major, from ``cols`` to ``new_cols`` columns."""
    flat = F.col("i") * cols + F.col("j")
    return a.select(F.expr(f"(i * {cols} + j) div {new_cols}").alias("i"), (flat % new_cols).alias("j"), "v")


def diagonal(a: DataFrame, offset: int = 0) -> DataFrame:
    return a.where(F.col("j") - F.col("i") == offset).select(F.least("i", "j").alias("i"), "v")


def diag(x: DataFrame, offset: int = 0) -> DataFrame:
    """A matrix with the vector on its diagonal."""
    return x.select((F.col("i") + max(0, -offset)).alias("i"), (F.col("i") + max(0, offset)).alias("j"), "v")


def frobenius(a: DataFrame) -> DataFrame:
    return a.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def norm_1(a: DataFrame) -> DataFrame:
    """Largest column sum of absolute values."""
    return a.groupBy("j").agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s").alias("norm"))


def norm_inf(a: DataFrame) -> DataFrame:
    return norm_1(transpose(a))


def scatter(rows: DataFrame, how: str = "add", size: int | None = None, index: str = "index", value: str = "v") -> DataFrame:
    """Values aggregated by index; with ``size`` every index below it, empty ones at the neutral value."""
    fn, empty = {
        "add": (F.sum, 0.0), "sum": (F.sum, 0.0), "mean": (F.avg, 0.0), "max": (F.max, float("-inf")), "min": (F.min, float("inf")),
    }[how]
    out = rows.groupBy(index).agg(fn(F.col(value).cast("double")).alias("v"))
    if size is None:
        return out
    slots = rows.sparkSession.range(size).withColumnRenamed("id", index)
    return slots.join(out, index, "left").select(index, F.coalesce("v", F.lit(empty)).alias("v"))


def scatter_softmax(rows: DataFrame, index: str = "index", value: str = "v") -> DataFrame:
    """Each row's share of its index by softmax: two small aggregates joined back, so that a hot index is no hot task."""
    top = rows.groupBy(index).agg(F.max(value).alias("__m"))
    e = rows.join(top, index).withColumn("__e", F.exp(F.col(value) - F.col("__m")))
    sums = e.groupBy(index).agg(F.sum("__e").alias("__s"))
    return e.join(sums, index).withColumn("softmax", F.col("__e") / F.col("__s")).drop("__m", "__e", "__s")


def take(rows: DataFrame, places: DataFrame, key: str = "i") -> DataFrame:
    """The rows at ``places`` (columns ``pos``, ``key``), in their order of ``pos``."""
    return places.join(rows, key)


def scatter_update(a: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Values replaced where ``updates`` (keys, ``n``, ``v``) says so; of repeats, the largest ``n``."""
    last = updates.groupBy(*keys).agg(F.max_by("v", "n").alias("__new"))
    return a.join(last, keys, "left").withColumn("v", F.coalesce("__new", "v")).drop("__new")


def nonzero(a: DataFrame) -> DataFrame:
    return a.where("v <> 0").select("i", "j")


def eye(spark: SparkSession, n: int, m: int | None = None) -> DataFrame:
    """Every cell; only the diagonal is 1."""
    m = m or n
    return spark.range(n * m).select(F.expr(f"id div {m}").alias("i"), (F.col("id") % m).alias("j"), (F.expr(f"id div {m}") == F.col("id") % m).cast("double").alias("v"))


def full(spark: SparkSession, n: int, m: int, value: float = 0.0) -> DataFrame:
    return spark.range(n * m).select(F.expr(f"id div {m}").alias("i"), (F.col("id") % m).alias("j"), F.lit(float(value)).alias("v"))


def linspace(spark: SparkSession, start: float, stop: float, num: int) -> DataFrame:
    step = (stop - start) / (num - 1) if num > 1 else 0.0
    return spark.range(num).select(F.col("id").alias("i"), (F.lit(start) + F.col("id") * step).alias("v"))


def arange(spark: SparkSession, start: float, stop: float, step: float = 1.0) -> DataFrame:
    n = max(0, -int(-(stop - start) // step))
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(float(start)) + F.col("id") * float(step)).alias("v"))


def meshgrid(spark: SparkSession, xs: list[float], ys: list[float]) -> DataFrame:
    """All pairs of two literal axes, by arithmetic on one range."""
    ax, ay = F.array(*map(F.lit, map(float, xs))), F.array(*map(F.lit, map(float, ys)))
    place = spark.range(len(xs) * len(ys)).select(F.expr(f"cast(id div {len(xs)} as int)").alias("i"), (F.col("id") % len(xs)).cast("int").alias("j"))
    return place.select("i", "j", F.element_at(ax, F.col("j") + 1).alias("x"), F.element_at(ay, F.col("i") + 1).alias("y"))


def concatenate(parts: list[DataFrame], sizes: list[int], axis: int = 0) -> DataFrame:
    """Matrices one after the other; ``sizes`` are their lengths along the axis."""
    key, at, out = "ij"[axis], 0, []
    for part, n in zip(parts, sizes):
        out.append(part.withColumn(key, F.col(key) + at))
        at += n
    return reduce(DataFrame.unionByName, out)


def split(a: DataFrame, cuts: list[int], axis: int = 0) -> list[DataFrame]:
    """Parts of the given sizes along an axis."""
    key, at, out = "ij"[axis], 0, []
    for n in cuts:
        out.append(a.where((F.col(key) >= at) & (F.col(key) < at + n)).withColumn(key, F.col(key) - at))
        at += n
    return out


def slice_update(a: DataFrame, inside: Column, value: Column) -> DataFrame:
    return a.withColumn("v", F.when(inside, value).otherwise(F.col("v")))


def sort_within(rows: DataFrame, by: str, value: str, tie: str, descending: bool = False) -> DataFrame:
    """Adds ``rank`` from 0 along each ``by``; ties go by ``tie``."""
    order = F.desc(value) if descending else F.asc(value)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order, tie)) - 1)


def argmax_by(rows: DataFrame, by: list[str], value: str, index: str) -> DataFrame:
    """The smallest index of the largest value of each group, by one aggregate."""
    return rows.groupBy(*by).agg(F.min_by(index, F.struct(-F.col(value).cast("double"), F.col(index))).alias("argmax"), F.max(value).alias("max"))
