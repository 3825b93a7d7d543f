"""Measures over all pairs of a group, and joins by closeness, without writing out pairs.

A measure that is a sum over pairs follows from sums over rows where it can.  Where it
can't, rows are dealt to blocks of bounded size and a task multiplies two blocks; it
passes on two numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sparkloom.functions.ieee import dbl
from sparkloom.functions.vector import phase_angle
from sparkloom.sources.shared import stored


def coherence(df: DataFrame, key: list[str], xs: str) -> DataFrame:
    """``key, coherence``: the mean cosine of the phase differences of all pairs of vectors; 1 below two.

    The squared length of the sum of unit vectors holds every pair twice and each row once, so two
    sums are enough.  Null and empty vectors are left out.
    """
    rows = df.where(F.size(xs) > 0).select(*key, phase_angle(F.col(xs)).alias("__p"))
    sums = rows.groupBy(*key).agg(F.count("__p").alias("n"), F.sum(F.cos("__p")).alias("c"), F.sum(F.sin("__p")).alias("s"))
    n = F.col("n")
    return sums.select(*key, F.when(n < 2, 1.0).otherwise((F.col("c") * F.col("c") + F.col("s") * F.col("s") - n) / F.when(n > 1, n * (n - 1))).alias("coherence"))


def interference(df: DataFrame, key: list[str], xs: str, tile: int = 1024) -> DataFrame:
    """``key, strength``: the mean of the absolute inner products of all pairs that are not 0; 0 where there are none.

    An absolute value has no sum over rows, so the work is that of all pairs, ``tile`` by ``tile`` of
    them in one matrix product; a task holds two blocks.  Null vectors are left out, missing entries count as 0.
    """
    spark = df.sparkSession
    rows = stored(df.where(F.col(xs).isNotNull()).select(*key, F.transform(F.col(xs), lambda x: F.coalesce(dbl(x), F.lit(0.0))).alias("__x"), F.rand(3).alias("__u")), "vectors")
    sizes = rows.groupBy(*[F.col(c).alias(f"__{c}") for c in key]).agg(F.ceil(F.count("*") / tile).cast("int").alias("__parts"))
    same = [rows[c].eqNullSafe(sizes[f"__{c}"]) for c in key] or [F.lit(True)]
    dealt = rows.join(sizes, same).select(*key, "__x", "__parts", F.floor(F.col("__u") * F.col("__parts")).cast("int").alias("__own"))
    met = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__with"))
    cell = [*key, "__a", "__b"]
    rows = met.select(*key, F.least("__own", "__with").alias("__a"), F.greatest("__own", "__with").alias("__b"), (F.col("__own") > F.col("__with")).alias("__second"), "__x")
    out = rows.select(*key, F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("pairs")).schema
    arrow = to_arrow_schema(out)

    def run(batches):
        last, held = None, ([], [])

        def close():
            if last is None:
                return
            d = max((len(x) for side in held for x in side), default=0)
            x, y = (np.array([np.pad(v, (0, d - len(v))) for v in side]).reshape(-1, d) for side in held)
            within = last[-1] == last[-2]
            p = np.abs(x @ (x if within else y).T)
            p = p[np.triu_indices(len(x), 1)] if within else p
            values = [*last[:-2], float(p.sum()), int(np.count_nonzero(p))]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow)], schema=arrow)

        for batch in batches:
            names = zip(*(batch.column(c).to_pylist() for c in cell))
            for here, second, x in zip(names, batch.column("__second").to_pylist(), batch.column("__x")):
                if here != last:
                    yield from close()
                    last, held = here, ([], [])
                held[second].append(x.values.to_numpy())
        yield from close()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = rows.repartition(parts, *cell).sortWithinPartitions(*cell).mapInArrow(run, out)
    got = sums.groupBy(*key).agg(F.sum("total").alias("t"), F.sum("pairs").alias("n"))
    return got.select(*key, F.when(F.col("n") > 0, F.col("t") / F.col("n")).otherwise(0.0).alias("strength"))


def near_values(df: DataFrame, value: str, kept: DataFrame, kept_value: str, tolerance: float, key: list[str] | None = None) -> DataFrame:
    """The rows whose ``value`` lies within ``tolerance`` of some ``kept_value`` (of the same ``key``, whose columns both have).

    Both sides fall into buckets of twice the tolerance; the distinct kept values also stand in the two
    buckets beside theirs, so the join is one on equality, which Spark can split where a bucket is crowded.  Nulls and NaN are near nothing.
    """
    key = key or []
    if not tolerance >= 0:
        raise ValueError("a tolerance is 0 or more")
    width = 2 * tolerance or 1.0

    def bucket(x):
        return F.floor(x / width)

    k = dbl(F.col(kept_value))
    wanted = kept.where(k.isNotNull() & ~F.isnan(k)).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(key)], k.alias("__kept")).distinct()
    wanted = wanted.withColumn("__near", F.explode(F.array(*[bucket(F.col("__kept")) + i for i in (-1, 0, 1)])))
    x = dbl(F.col(value))
    same = [F.col(c) == F.col(f"__k{i}") for i, c in enumerate(key)]
    rows = df.withColumn("__bucket", bucket(x))
    return rows.join(wanted, [F.col("__bucket") == F.col("__near"), F.abs(x - F.col("__kept")) <= tolerance, *same], "left_semi").drop("__bucket")
