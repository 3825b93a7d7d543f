"""Numbers and scans along an order, without a task that holds a whole table or series.

Rows are dealt to ranges of the order, sorted inside each, and written to the shared folder
with the number of their range and their place in it.  What a range passes on (its rows, its
sum, the least of its running sums, its last known value) is one small row for each series and range; windows over these give what stands before each range.  So a series of all rows
is scanned by as many tasks as there are ranges, and there are as many ranges as it takes that none has much more than ``ROWS``.

Defined cases: rows that tie in the order are ordered by a hash of all columns; rows that
are alike in all columns stand in any order, and may lie in several ranges.  Nulls come first,
as Spark orders them; null keys are one series.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.ieee import dbl
from sparkloom.sources.shared import drop, stored

#: A range that one task sorts has about as many rows, however long the table is.
ROWS = 1 << 18
#: Multiples of a step that are made at once.
BLOCK = 4096


def ranges(df: DataFrame) -> int:
    """The number of ranges for the rows: as many as there are shuffle partitions, or more, so that none is long."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS))


def placed(df: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """The rows in the shared folder with ``__part``, the range of the order, and ``__at``, the place in it (from 0)."""
    parts = parts or ranges(df)
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t and "variant" not in t])
    rows = df.withColumn("__hash", hashed).withColumn("__deal", F.rand(17))
    dealt = rows.repartitionByRange(parts, *order, "__hash", "__deal").sortWithinPartitions(*order, "__hash", "__deal").drop("__hash", "__deal")
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return stored(dealt.withColumns({"__part": F.spark_partition_id(), "__at": at}), "placed")


def row_numbers(df: DataFrame, order: list[Column], name: str = "row_number", parts: int | None = None) -> DataFrame:
    """Adds the number of each row (from 1) in the order of the whole table."""
    rows = placed(df, order, parts)
    before, n = [], 0
    sizes = {r["__part"]: r["count"] for r in rows.groupBy("__part").count().collect()}  # a row for each range
    for part in range(max(sizes, default=-1) + 1):
        before.append(n)
        n += sizes.get(part, 0)
    start = F.element_at(F.lit(before or [0]).cast("array<long>"), F.col("__part") + 1)
    return rows.withColumn(name, start + F.col("__at") + 1).drop("__part", "__at")


def dense_ranks(df: DataFrame, columns: list[str], name: str = "dense_rank", parts: int | None = None) -> DataFrame:
    """Adds the number of each row's values among the different ones of the table, in ascending order (nulls first)."""
    values = row_numbers(df.select(*columns).distinct(), [F.col(c) for c in columns], "__rank", parts)
    right = values.select(*[F.col(c).alias(f"__v{k}") for k, c in enumerate(columns)], F.col("__rank").alias(name))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__v{k}")) for k, c in enumerate(columns)])
    return df.join(right, same).drop(*[f"__v{k}" for k in range(len(columns))])


def shuffled_key(columns: list[str], seed: int = 0) -> Column:
    """An md5 of the seed and the columns as text, a null as nothing."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).cast("binary"))


def permutation(df: DataFrame, columns: list[str], seed: int = 0, name: str = "place", parts: int | None = None) -> DataFrame:
    """Adds the place (from 0) of each row in a random order, the same for every run: that of an md5 of seed and columns, then the columns."""
    rows = row_numbers(df, [shuffled_key(columns, seed), *[F.col(c) for c in columns]], "__n", parts)
    return rows.withColumn(name, F.col("__n") - 1).drop("__n")


def permuted_range(spark, n: int, seed: int = 0, parts: int | None = None) -> DataFrame:
    """``i, place``: a permutation of the numbers from 0 to ``n`` - 1."""
    return permutation(spark.range(n).withColumnRenamed("id", "i"), ["i"], seed, parts=parts)


# Scans along a series


def _series(df: DataFrame, key: list[str], order: list[str], parts: int | None):
    """The placed rows, the same with each range in a task of its own, and windows inside a range and over the ranges of a series."""
    parts = parts or ranges(df)
    rows = placed(df, [F.col(c) for c in [*key, *order]], parts)
    inside = Window.partitionBy(*key, "__part").orderBy("__at")
    across = Window.partitionBy(*key).orderBy("__part")
    return rows, rows.repartitionById(parts, F.col("__part")), inside, across


def _same(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(columns)])


def _passed(rows: DataFrame, placed_rows: DataFrame, key: list[str], *totals: Column) -> DataFrame:
    """What ranges pass on: totals by series and range, for the series that begin a range, as all that lie in several ranges do.

    A range shares only its first and its last series with others, so these are a few rows for each range.
    """
    if key:
        begun = placed_rows.where("__at = 0").select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(key)]).distinct()
        rows = rows.join(F.broadcast(begun), _same(key), "left_semi")
    return rows.groupBy(*key, "__part").agg(*totals)


def _carried(rows: DataFrame, key: list[str], passed: DataFrame, *carried: dict[str, Column]) -> DataFrame:
    """``rows`` with columns taken from what the ranges of a series pass on; null for a series that passes nothing on."""
    passed = reduce(lambda d, c: d.withColumns(c), carried, passed)
    right = passed.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate([*key, "__part"])], *[n for c in carried for n in c])
    return rows.join(F.broadcast(right), _same([*key, "__part"]), "left").drop(*[f"__k{i}" for i in range(len(key) + 1)])


def cumulative(df: DataFrame, key: list[str], order: list[str], value: str, name: str = "cumsum", parts: int | None = None) -> DataFrame:
    """Adds the running sum of each series; a null adds nothing."""
    rows, dealt, inside, across = _series(df, key, order, parts)
    x = F.coalesce(dbl(F.col(value)), F.lit(0.0))
    passed = _passed(rows, rows, key, F.sum(x).alias("__sum"))
    dealt = dealt.withColumn("__x", F.sum(x).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    out = _carried(dealt, key, passed, {"__before": F.sum("__sum").over(across.rowsBetween(Window.unboundedPreceding, -1))})
    return out.withColumn(name, F.coalesce("__before", F.lit(0.0)) + F.col("__x")).drop("__before", "__x", "__part", "__at")


def gathered_bits(df: DataFrame, key: list[str], order: list[str], bits: Column, name: str = "bits", first: Column | None = None, parts: int | None = None) -> DataFrame:
    """Adds the bits met so far along each series (a long); a null has none.

    ``first`` are bits that only the first row of a series adds, for all its rows.
    """
    made = {"__c": F.coalesce(bits.cast("long"), F.lit(0)), "__f": F.lit(0).cast("long") if first is None else F.coalesce(first.cast("long"), F.lit(0))}
    rows, dealt, inside, across = _series(df.withColumns(made), key, order, parts)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    passed = _passed(rows, rows, key, F.bit_or("__c").alias("__all"), F.min_by("__f", "__at").alias("__head"))
    out = _carried(dealt.withColumns({"__x": F.bit_or("__c").over(upto), "__own": F.first("__f").over(upto)}), key, passed, {
        "__before": F.bit_or("__all").over(across.rowsBetween(Window.unboundedPreceding, -1)),
        "__start": F.first("__head").over(across.rowsBetween(Window.unboundedPreceding, 0)),
    })
    start, before = F.coalesce("__start", "__own"), F.coalesce("__before", F.lit(0))
    return out.withColumn(name, start.bitwiseOR(before).bitwiseOR(F.col("__x"))).drop("__c", "__f", "__x", "__own", "__before", "__start", "__part", "__at")


def level(df: DataFrame, key: list[str], order: list[str], change: Column, name: str = "level", start: float = 0.0, least: float = 0.0, parts: int | None = None) -> DataFrame:
    """Adds ``max(least, level before + change)`` along each series, beginning at ``start``.

    A step maps x to max(least, x + change), and so do several steps together:
    with s the running sum of changes and m the least s so far, the level is
    max(start + s, least + s - m).  Sums and least sums of ranges chain in the same way.
    """
    rows, dealt, inside, across = _series(df.withColumn("__c", F.coalesce(dbl(change), F.lit(0.0))), key, order, parts)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumn("__s", F.sum("__c").over(upto))
    dealt = dealt.withColumn("__m", F.min("__s").over(upto))
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    passed = _passed(dealt, rows, key, F.sum("__c").alias("__sum"), F.min("__m").alias("__min"))
    # the least running sum of each earlier range counts from the series' beginning
    before = {"__before": F.coalesce(F.sum("__sum").over(earlier), F.lit(0.0))}
    out = _carried(dealt, key, passed, before, {"__low": F.col("__before") + F.col("__min")}, {"__least": F.min("__low").over(earlier)})
    s = F.coalesce("__before", F.lit(0.0)) + F.col("__s")
    m = F.least("__least", F.coalesce("__before", F.lit(0.0)) + F.col("__m"))  # a null stands for no earlier range
    return out.withColumn(name, F.greatest(start + s, least + s - m)).drop("__c", "__s", "__m", "__before", "__low", "__least", "__part", "__at")


def dopamine(df: DataFrame, key: list[str], order: list[str], strength: str, increase: float = 0.05, decay: float = 0.01, dt: float = 0.1, start: float = 0.0, parts: int | None = None) -> DataFrame:
    """Adds ``level``: it rises by what the strength has above 0.5 and decays with time, never below 0."""
    x = dbl(F.col(strength))
    return level(df, key, order, F.when(x > 0.5, increase * (x - 0.5)).otherwise(0.0) - decay * dt, start=start, parts=parts)


def interpolated(df: DataFrame, key: list[str], time: str, value: str, name: str = "interpolated", parts: int | None = None) -> DataFrame:
    """Adds the value, or where it is null the straight line between the known ones before and after in time.

    Before the first and after the last known value of a series that value holds; a series without any stays null.
    """
    rows, dealt, inside, across = _series(df, key, [time], parts)
    known = F.when(F.col(value).isNotNull(), F.struct(dbl(F.col(time)).alias("t"), dbl(F.col(value)).alias("v")))
    dealt = dealt.withColumns({
        "__a": F.last(known, True).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        "__b": F.first(known, True).over(inside.rowsBetween(0, Window.unboundedFollowing)),
    })
    by_time = F.when(F.col(value).isNotNull(), F.col("__at"))
    # a number for each total, as a struct in one would have its rows sorted
    met = lambda f, g: F.when(f(by_time).isNotNull(), F.struct(g(dbl(F.col(time)), by_time).alias("t"), g(dbl(F.col(value)), by_time).alias("v")))
    passed = _passed(rows, rows, key, met(F.max, F.max_by).alias("__end"), met(F.min, F.min_by).alias("__begin"))
    out = _carried(dealt, key, passed, {
        "__before": F.last("__end", True).over(across.rowsBetween(Window.unboundedPreceding, -1)),
        "__after": F.first("__begin", True).over(across.rowsBetween(1, Window.unboundedFollowing)),
    })
    a, b, t = F.coalesce("__a", "__before"), F.coalesce("__b", "__after"), dbl(F.col(time))
    line = a["v"] + (b["v"] - a["v"]) * F.when(b["t"] > a["t"], (t - a["t"]) / (b["t"] - a["t"])).otherwise(0.0)
    return out.withColumn(name, F.coalesce(dbl(F.col(value)), line, a["v"], b["v"])).drop("__a", "__b", "__before", "__after", "__part", "__at")


def resampled(df: DataFrame, key: list[str], time: str, value: str, step: int, parts: int | None = None) -> DataFrame:
    """``key, time, value`` at the multiples of ``step`` between the ends of each series, on straight lines between its points.

    ``time`` is a long; points of one time count as their mean, those without a time or value not at all.  Only points are
    ordered; each makes the multiples from its own time to before that of the next one.
    """
    known = df.where(F.col(time).isNotNull() & F.col(value).isNotNull())
    points = stored(known.groupBy(*key, F.col(time).alias("__t")).agg(F.avg(dbl(F.col(value))).alias("__v")), "points")
    rows, dealt, inside, across = _series(points, key, ["__t"], parts)
    drop(points)
    point = F.struct(F.col("__t").alias("t"), F.col("__v").alias("v"))
    passed = _passed(rows, rows, key, F.struct(F.min("__t").alias("t"), F.min_by("__v", "__at").alias("v")).alias("__head"))
    out = _carried(dealt.withColumn("__b", F.lead(point).over(inside)), key, passed, {"__after": F.lead("__head").over(across)})
    out = out.select(*key, "__t", "__v", F.coalesce("__b", "__after").alias("__b"))
    # the last point of a series makes its own time, if that is a multiple
    low = f"__t div {step} + if(__t % {step} > 0, 1, 0)"
    high = f"if(__b is null, __t div {step} - if(__t % {step} < 0, 1, 0), __b.t div {step} - if(__b.t % {step} > 0, 0, 1))"
    out = out.withColumns({"__from": F.expr(low), "__to": F.expr(high)}).where("__from <= __to")
    # in blocks, as the array of a long gap can be large
    out = out.withColumn("__k", F.explode(F.sequence("__from", "__to", F.lit(BLOCK).cast("long"))))
    out = out.withColumn("__k", F.explode(F.sequence("__k", F.col("__k") + F.least(F.col("__to") - F.col("__k"), F.lit(BLOCK - 1)))))
    t = F.col("__k") * F.lit(step)
    since = lambda x: F.coalesce(F.try_subtract(x, F.col("__t")).cast("double"), dbl(x) - dbl(F.col("__t")))
    line = F.col("__v") + (F.col("__b.v") - F.col("__v")) * since(t) / since(F.col("__b.t"))
    return out.select(*key, t.alias(time), F.when(t == F.col("__t"), F.col("__v")).otherwise(line).alias(value))
