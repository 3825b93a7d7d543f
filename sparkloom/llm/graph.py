"""Connected components by alternating large and small stars (Kiveris et al., 2014).

Every step is a join with an aggregate of one row per node; no list of neighbours is
ever gathered.  Each round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """``u`` and ``root``, the least node of its component, for every node but the roots.

    ``edges`` has two orderable columns ``u`` and ``v``; repeats and self-links are
    harmless.  Raises if ``rounds`` do not suffice, rather than return partial answers.
    """
    now = scratch.write(edges.where("u <> v").select("u", "v").distinct())
    mark = _mark(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        new = scratch.write(_small_star(_large_star(now)))
        scratch.drop(now)
        old, mark, now = mark, _mark(new), new
        if mark == old:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select("u", F.col("v").alias("root"))
