"""Attention of rows over the rows before them, for series of any length.

Places of a series are cut into blocks.  A row meets the blocks that its window can reach, by
an equi-join, so a long series is as many tasks as it has blocks.  Of each block a row keeps three
things: the largest score, the sum of weights and the weighted sum of values.  These merge like
counts, so no task holds a series, and a group holds one block's values at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.ieee import dbl
from sparkloom.functions.vector import dot, total


def scaled(q: Column, k: Column) -> Column:
    """The inner product over the root of the length."""
    return dot(q, k) / F.sqrt(F.size(q))


def additive(weights: list[float]) -> Callable[[Column, Column], Column]:
    """Scores of the sum of query and key through tanh, with one weight for each component."""
    return lambda q, k: dot(F.transform(F.zip_with(q, k, lambda a, b: dbl(a) + dbl(b)), F.tanh), F.lit([float(w) for w in weights]))


def masked(
    df: DataFrame, key: list[str], place: str, query: str, keys: str, values: str, width: int,
    score: Callable[[Column, Column], Column] = scaled, known: str | None = None, ahead: int = 0, block: int | None = None,
) -> DataFrame:
    """``key, place, attended, n``: the mean of the values of a window, weighted by the softmax of the scores.

    A row sees the ``width`` places up to its own, and ``ahead`` places after it (0: causal).  Rows that are not
    ``known`` (padding) look but are not seen, nor are those with a null score.  ``place`` is a whole number, different for each
    row of a series; gaps count as places.  A row that sees nothing has null and ``n`` 0.
    """
    size = block or width + ahead
    own = F.floor(F.col(place) / size)
    asks = df.select(*key, F.col(place).alias("__t"), F.col(query).alias("__q"))
    first, last = F.floor((F.col("__t") - (width - 1)) / size), F.floor((F.col("__t") + ahead) / size)
    asks = asks.withColumn("__b", F.explode_outer(F.sequence(first, last)))
    seen = df.where(F.col(known)) if known else df
    seen = seen.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(key)], F.col(place).alias("__u"), own.alias("__c"), F.col(keys).alias("__k"), F.col(values).alias("__v"))
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(key)]
    inside = (F.col("__u") > F.col("__t") - width) & (F.col("__u") <= F.col("__t") + ahead)
    met = asks.join(seen, [F.col("__b") == F.col("__c"), *same, inside], "left").withColumn("__s", dbl(score(F.col("__q"), F.col("__k"))))
    held = met.groupBy(*key, "__t", "__b").agg(F.collect_list(F.when(F.col("__s").isNotNull(), F.struct(F.col("__s").alias("s"), F.col("__v").alias("v")))).alias("__l"))  # a block at most
    parts = held.select(*key, "__t", _merged("__l", lambda m: F.struct(m["s"].alias("s"), F.lit(1.0).alias("z"), F.transform(m["v"], dbl).alias("y"), F.lit(1).cast("long").alias("n"))).alias("__p"))
    both = parts.groupBy(*key, "__t").agg(F.collect_list("__p").alias("__l"))  # one for each block that the window touches
    got = both.select(*key, F.col("__t").alias(place), _merged("__l", lambda m: m).alias("__p"))
    return got.select(*key, place, F.transform("__p.y", lambda y: y / F.col("__p.z")).alias("attended"), F.coalesce("__p.n", F.lit(0)).cast("long").alias("n"))


def _merged(parts: str, as_part: Callable[[Column], Column]) -> Column:
    """Largest score, sum of weights relative to it, weighted values and count of several parts; null for none."""
    rows = F.transform(parts, as_part)
    top = F.array_max(F.transform(rows, lambda p: p["s"]))

    def summed(rows: Column, top: Column) -> Column:
        def weight(p: Column) -> Column:
            return F.exp(p["s"] - top)

        d = F.size(rows[0]["y"])
        y = F.transform(F.sequence(F.lit(0), d - 1), lambda j: total(F.transform(rows, lambda p: weight(p) * F.get(p["y"], j))))
        return F.struct(top.alias("s"), total(F.transform(rows, lambda p: weight(p) * p["z"])).alias("z"), y.alias("y"), F.aggregate(rows, F.lit(0).cast("long"), lambda a, p: a + p["n"]).alias("n"))

    return F.when(F.size(parts) > 0, F.transform(F.array(F.struct(rows.alias("r"), top.alias("t"))), lambda x: summed(x["r"], x["t"]))[0])
