"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions alone.

A tree of levels (here domain, language, source) ends in leaves.  A leaf's capacity is
its tokens times the number of epochs allowed; a node's is the sum below it.  From the
root down, a node's budget is dealt to its children by weight, none above its capacity:
what one child can't use goes to its siblings by weight.  As a node never gets more than
its whole subtree can hold, shortages are settled among siblings before any ancestor's.

Sharing out is the water level of each parent in closed form: children sorted by
capacity over weight, running sums of capacity before and weight after, all in integers.
A leaf takes whole seeded epochs and then a prefix of the next: documents in order of
md5(seed, epoch, id) while their running sum of tokens stays within the rest.  The
running sum has levels: over 4,096 ranges of the hash, in leaves of over 16 million rows
over 4,096 parts of each range, and inside one of them.  So a leaf with a third of all
rows is spread over as many window groups, of some thousand rows however large it is.

Defined cases: null levels are ``unknown``; documents without tokens are never taken;
a weight of zero takes nothing; a budget above all capacity takes all of it; rows with
the same id are adjacent, by their tokens and then by a hash of their other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD, Scratch

PREFIX = 3  # hexadecimal digits of the hash that name a range, and as many a part of it
DEEP = 1 << 24  # rows of a leaf from which on its ranges have parts


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1).cast("long")
    for value, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, F.lit(w).cast("long")).otherwise(out)
    return out


def share_out(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Adds ``alloc`` to children with ``w``, ``cap`` and their parent's ``budget``; its sum is the least of budget and capacity."""
    by = Window.partitionBy(*parent)
    order = by.orderBy(F.try_divide(F.col("cap").cast("double"), F.col("w").cast("double")).asc_nulls_last(), child)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    full = nodes.withColumn("before", before).withColumn("rest", rest).withColumn("full", F.col("cap") * F.col("rest") <= F.col("w") * (F.col("budget") - F.col("before")))
    open_w = F.when(F.col("full"), 0).otherwise(F.col("w"))
    level = full.withColumn("left", F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(by)).withColumn("open", F.sum(open_w).over(by))
    part = F.when(F.col("full"), F.col("cap")).when(F.col("w") == 0, 0).otherwise(F.expr("(w * left) div greatest(open, 1)"))
    parts = level.withColumn("part", part.cast("long"))
    odd = F.when((F.col("open") > 0), F.col("left") - F.sum(F.when(F.col("full"), 0).otherwise(F.col("part"))).over(by)).otherwise(0)
    turn = F.sum(F.when(F.col("full") | (F.col("w") == 0), 0).otherwise(1)).over(by.orderBy(child).rowsBetween(Window.unboundedPreceding, 0))
    dealt = parts.withColumn("odd", odd).withColumn("turn", turn)
    extra = F.when(~F.col("full") & (F.col("w") > 0) & (F.col("turn") <= F.col("odd")), 1).otherwise(0)
    return dealt.withColumn("alloc", (F.col("part") + extra).cast("long")).drop("before", "rest", "full", "left", "open", "part", "odd", "turn")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], share: tuple[int, int], epochs: int) -> DataFrame:
    """``levels``, ``tokens`` and ``alloc`` of every leaf; ``leaves`` has levels and tokens."""
    allowed = F.lit(True)
    for x in levels:
        allowed = allowed & (_weight(x, weights) > 0)
    tree = leaves.withColumn("cap", F.when(allowed, F.col("tokens") * epochs).otherwise(0).cast("long")).withColumn("all", F.lit(0))
    top = Window.partitionBy("all")
    given, parent = None, ["all"]
    for depth, level in enumerate(levels):
        nodes = tree.groupBy("all", *levels[: depth + 1]).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("w", _weight(level, weights))
        if given is None:
            whole = F.floor(F.sum("tokens").over(top) * share[0] / share[1]).cast("long") if share[1] != 1 else F.lit(share[0]).cast("long")
            nodes = nodes.withColumn("budget", F.least(whole, F.sum("cap").over(top)))
        else:
            nodes = nodes.join(given, parent)
        dealt = share_out(nodes, parent, level)
        parent = ["all", *levels[: depth + 1]]
        given = dealt.select(*parent, F.col("alloc").alias("budget"))
    return dealt.select(*levels, "tokens", "alloc")


def mix(rows: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], share: tuple[int, int] = (1, 2), epochs: int = 2, seed: int = 0, narrow: DataFrame | None = None, deep: int = DEEP) -> DataFrame:
    """Adds ``alloc``, its leaf's budget, and ``copies``, how often the epochs take the row.

    ``rows`` has ``doc_id``, the columns ``levels``, ``tokens`` and any others, of which
    those named like what is added give way.  ``narrow`` may hold the same rows without the others, already
    written: sums are then read from it.  ``share`` is the part of all tokens to take, or
    (tokens, 1) for a fixed number.
    """
    scratch = Scratch(rows.sparkSession, "mixing")
    slim = (narrow if narrow is not None else rows).select("doc_id", *levels, "tokens")
    extra = [c for c in rows.columns if c not in ("doc_id", "tokens", *levels)]
    packed = rows.select("doc_id", *levels, "tokens", *([F.struct(*[F.col(f"`{c}`") for c in extra]).alias("__row")] if extra else []))
    leaves = scratch.write(slim.groupBy(*levels).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("many")))
    dealt = scratch.write(
        budgets(leaves.drop("many"), levels, weights, share, epochs)
        .join(leaves.select(*levels, (F.col("many") > deep).alias("deep")), levels)
        .withColumn("whole", F.when(F.col("tokens") > 0, F.expr("alloc div greatest(tokens, 1)")).otherwise(0))
        .withColumn("rest", F.col("alloc") - F.col("whole") * F.col("tokens"))
        .drop("tokens")
    )

    def placed(df: DataFrame) -> DataFrame:
        key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
        out = df.join(dealt, levels).withColumn("place", key).withColumn("range", F.substring("place", 1, PREFIX))
        return out.withColumn("part", F.when(F.col("deep"), F.substring("place", 1 + PREFIX, PREFIX)).otherwise(F.lit("")))

    cells = placed(slim).groupBy(*levels, "range", "part").agg(F.sum("tokens").alias("sum"))
    unbounded = Window.unboundedPreceding
    ranges = cells.groupBy(*levels, "range").agg(F.sum("sum").alias("sum"))
    along = Window.partitionBy(*levels).orderBy("range").rowsBetween(unbounded, -1)
    within = Window.partitionBy(*levels, "range").orderBy("part").rowsBetween(unbounded, -1)
    first = ranges.select(*levels, "range", F.coalesce(F.sum("sum").over(along), F.lit(0)).alias("before"))
    parts = cells.select(*levels, "range", "part", F.coalesce(F.sum("sum").over(within), F.lit(0)).alias("inner"))
    starts = scratch.write(first.join(parts, [*levels, "range"]).select(*levels, "range", "part", (F.col("before") + F.col("inner")).alias("before")))
    hashable = [F.col(f"__row.`{c}`") for c, t in rows.dtypes if c in extra and "map<" not in t and "variant" not in t]
    inside = Window.partitionBy(*levels, "range", "part").orderBy("place", "doc_id", "tokens", *([F.xxhash64(*hashable)] if hashable else [])).rowsBetween(unbounded, 0)
    taken = placed(packed).join(starts, [*levels, "range", "part"]).withColumn("upto", F.col("before") + F.sum("tokens").over(inside))
    copies = F.when(F.col("tokens") <= 0, 0).otherwise(F.col("whole") + F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0))
    return taken.select("doc_id", *levels, "tokens", *[F.col(f"__row.`{c}`") for c in extra if c not in ("alloc", "copies")], "alloc", copies.cast("long").alias("copies"))
