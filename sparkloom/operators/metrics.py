"""Evaluation metrics from score and label columns.

Curves first reduce rows to one per distinct score.  Their running sums go over ranges of
the score with offsets, so that no single task sorts the whole curve.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.ieee import dbl


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(F.try_divide(dbl(a), dbl(b)))


def confusion(df: DataFrame, y: str, p: str, normalize: bool = False) -> DataFrame:
    """``y, p, n``: pairs that occur; with ``normalize`` the share of each true class."""
    out = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))
    if not normalize:
        return out
    return out.join(out.groupBy("y").agg(F.sum("n").alias("all")), "y").select("y", "p", (F.col("n") / F.col("all")).alias("n"))


def confusion_matrix(df: DataFrame, y: str, p: str, classes: int) -> DataFrame:
    """``y, p, n`` for all pairs of ``classes`` numbered classes, absent ones 0."""
    n = classes * classes
    grid = df.sparkSession.range(n).select(F.floor(F.col("id") / classes).cast("int").alias("y"), (F.col("id") % classes).cast("int").alias("p"))
    cells = confusion(df.select(F.col(y).cast("int").alias("y"), F.col(p).cast("int").alias("p")), "y", "p")
    return grid.join(cells, ["y", "p"], "left").select("y", "p", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(df: DataFrame, y: str, p: str) -> DataFrame:
    """Precision, recall, F1 and support of every class, from the confusion counts."""
    cells = confusion(df, y, p)
    both = cells.select(F.explode(F.array(F.struct(F.col("y").alias("c"), F.col("n").alias("real"), F.lit(0).cast("long").alias("said")), F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("real"), F.col("n").alias("said")))).alias("x"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit"))
    sums = both.groupBy(F.col("x.c").alias("class")).agg(F.sum("x.real").alias("support"), F.sum("x.said").alias("said"), (F.sum("hit") / 2).alias("tp"))
    got = sums.withColumn("precision", _ratio(F.col("tp"), F.col("said"))).withColumn("recall", _ratio(F.col("tp"), F.col("support")))
    return got.select("class", "support", "precision", "recall", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))


def classification(df: DataFrame, y: str, p: str) -> DataFrame:
    """Accuracy and macro averages, one row."""
    return per_class(df, y, p).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"))


def binary(df: DataFrame, y: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Counts and rates where a score strictly above the threshold says 1."""
    said, real = F.col(score) > threshold, F.col(y) == 1
    c = df.agg(*[F.count_if(x).alias(n) for n, x in (("tp", said & real), ("fp", said & ~real), ("fn", ~said & real), ("tn", ~said & ~real))])
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    out = c.select("*", _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(tn, tn + fp).alias("specificity"))
    return out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def regression(df: DataFrame, y: str, p: str) -> DataFrame:
    """mse, rmse, mae and r2 (1 less the residual over the total sum of squares), one row."""
    e, t = dbl(F.col(p)) - dbl(F.col(y)), dbl(F.col(y))
    out = df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(F.when(e.isNotNull(), t)).alias("v"))
    return out.select("mse", F.sqrt("mse").alias("rmse"), "mae", F.when(F.col("v") == 0, 0.0).otherwise(1 - F.try_divide(F.col("mse"), F.col("v"))).alias("r2"))


def curve(df: DataFrame, y: str, score: str, buckets: int = 256) -> DataFrame:
    """``score, pos, neg, tp, fp``: one row for each distinct score, with counts at or above it.

    Two levels: sums of ranges of the score, whose running total starts each range.  Ranges end
    at estimated quantiles, so skewed scores spread over them as well.  Rows without a label or score are left out.
    """
    df = df.where(F.col(y).isNotNull() & F.col(score).isNotNull())
    points = df.groupBy(dbl(F.col(score)).alias("score")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg")).where("score IS NOT NULL")
    cuts = df.agg(F.percentile_approx(dbl(F.col(score)), [i / buckets for i in range(1, buckets)], 20 * buckets)).first()[0] or []
    ends = F.array(*[F.lit(x) for x in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    placed = points.withColumn("b", F.size(F.filter(ends, lambda e: e < F.col("score"))))
    sums = placed.groupBy("b").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))  # at most ``buckets`` rows
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("b", F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("n0"))
    w = Window.partitionBy("b").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(starts, "b").select("score", "pos", "neg", (F.col("p0") + F.sum("pos").over(w)).alias("tp"), (F.col("n0") + F.sum("neg").over(w)).alias("fp"))


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the ROC curve: pairs in the right order, ties as halves; one row."""
    c = curve(df, y, score)
    right = F.col("neg") * (F.col("tp") - F.col("pos") / 2)
    return c.agg(F.sum(right).alias("pairs"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(_ratio(F.col("pairs"), F.col("p") * F.col("n")).alias("auc"))


def precision_recall(df: DataFrame, y: str, score: str) -> DataFrame:
    total = df.agg(F.count_if((F.col(y) == 1) & F.col(score).isNotNull())).first()[0]
    return curve(df, y, score).select("score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), _ratio(F.col("tp"), F.lit(total)).alias("recall"))


def average_precision(df: DataFrame, y: str, score: str) -> DataFrame:
    """Sum of precision over the steps of recall; one row."""
    c = curve(df, y, score)
    return c.agg(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("s"), F.sum("pos").alias("p")).select(_ratio(F.col("s"), F.col("p")).alias("average_precision"))
