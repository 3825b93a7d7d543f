"""Ordered windows over series: rolling features, strided sequences, gradients, rules.

Every window is partitioned by a series key; a series is the unit that one task orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.vector import total


def rolling(df: DataFrame, key: list[str], order: list[str], value: str, width: int = 5, stride: int = 1) -> DataFrame:
    """Mean, population deviation, least, greatest and slope of each window of ``width`` rows, named by its last row.

    Slopes use places inside the window, so they are as exact at the end of a long series as at its beginning; nulls count as 0 there.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    frame, x = w.rowsBetween(-(width - 1), 0), F.col(value).cast("double")
    n = df.withColumn("__n", F.row_number().over(w))
    mid, spread = (width - 1) / 2, (width**3 - width) / 12
    out = n.select(
        "*",
        F.avg(x).over(frame).alias("mean"), F.stddev_pop(x).over(frame).alias("std"), F.min(x).over(frame).alias("min"), F.max(x).over(frame).alias("max"),
        (total(F.transform(F.collect_list(F.coalesce(x, F.lit(0.0))).over(frame), lambda v, i: v * (i - mid))) / spread).alias("slope"),
    )
    return out.where((F.col("__n") >= width) & ((F.col("__n") - width) % stride == 0)).drop("__n")


def strided(df: DataFrame, key: list[str], order: list[str], value: str, width: int, strides: list[int]) -> DataFrame:
    """Whole windows of ``width`` values that start at multiples of each stride: ``start``, ``stride``, ``window``."""
    w = Window.partitionBy(*key).orderBy(*order)
    rows = df.select(*key, (F.row_number().over(w) - 1).alias("start"), F.collect_list(F.col(value).cast("double")).over(w.rowsBetween(0, width - 1)).alias("window"))
    whole = rows.where(F.size("window") == width)
    tagged = whole.withColumn("stride", F.explode(F.array(*map(F.lit, strides))))
    return tagged.where(F.col("start") % F.col("stride") == 0).select(*key, "stride", "start", "window")


def gradient(df: DataFrame, key: list[str], order: list[str], value: str, edge_order: int = 1) -> DataFrame:
    """Central differences inside a series, one-sided ones of order 1 or 2 at its ends.

    Null for a single point; ends of a series too short for order 2 take order 1.
    """
    w, x = Window.partitionBy(*key).orderBy(*order), F.col(value).cast("double")
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    first, last = after - x, x - before
    if edge_order == 2:
        first = F.coalesce((4 * after - 3 * x - F.lead(x, 2).over(w)) / 2, first)
        last = F.coalesce((3 * x - 4 * before + F.lag(x, 2).over(w)) / 2, last)
    return df.withColumn("gradient", F.when(before.isNull(), first).when(after.isNull(), last).otherwise((after - before) / 2))


def energy_stability(df: DataFrame, key: list[str], order: list[str], value: str, width: int = 100) -> DataFrame:
    """1 / (1 + variance over mean) of the energies of whole windows; 1 where there are fewer than two."""
    n = df.withColumn("__b", F.expr(f"(row_number() over (partition by {', '.join(key)} order by {', '.join(order)}) - 1) div {width}"))
    energies = n.groupBy(*key, "__b").agg(F.sum(F.pow(F.col(value).cast("double"), F.lit(2.0))).alias("__e"), F.count("*").alias("__c"))
    full = F.when(F.col("__c") == width, F.col("__e"))
    got = energies.groupBy(*key).agg(F.avg(full).alias("__m"), F.var_pop(full).alias("__v"), F.count(full).alias("__k"))
    return got.select(*key, F.when((F.col("__k") < 2) | (F.col("__m") == 0), F.lit(1.0)).otherwise(1 / (1 + F.col("__v") / F.col("__m"))).alias("stability"))


def cumulative(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    frame = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cumsum", F.sum(F.col(value).cast("double")).over(frame))


def incident_labels(df: DataFrame, key: list[str], order: list[str], severity: str, message: str, place: str, width: int = 10) -> DataFrame:
    """1 for windows of ``width`` events that start at a row and have two critical ones, or a
    critical one and a repeated message, or one place, three high ones and a repeat."""
    w = Window.partitionBy(*key).orderBy(*order)
    frame = w.rowsBetween(0, width - 1)

    def count(level: str) -> Column:
        return F.sum((F.col(severity) == level).cast("int")).over(frame)

    whole = F.count("*").over(frame) == width
    repeat = F.size(F.collect_set(message).over(frame)) < width
    alone = F.size(F.collect_set(place).over(frame)) == 1
    bad = (count("critical") >= 2) | ((count("critical") >= 1) & repeat) | (alone & (count("high") >= 3) & repeat)
    return df.withColumn("__whole", whole).withColumn("label", bad.cast("int")).where("__whole").drop("__whole")


#: Weights of severities (fixed values).
SEVERITIES = {"Low": 0.25, "Medium": 0.5, "High": 0.75, "Critical": 1.0}


def log_features(df: DataFrame, severity: str, places: list, messages: list, place: str = "location", message: str = "message") -> DataFrame:
    """Adds 0/1 columns for the listed places and messages and ``severity_weight``; unknown severities are null."""
    weight = F.lit(None).cast("double")
    for name, w in SEVERITIES.items():
        weight = F.when(F.col(severity) == name, w).otherwise(weight)
    hot = {f"{c}_{i}": F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for c, values in ((place, places), (message, messages)) for i, v in enumerate(values)}
    return df.withColumns({**hot, "severity_weight": weight})


def over_threshold(score: Column, threshold: float = 0.8) -> Column:
    return score > threshold
