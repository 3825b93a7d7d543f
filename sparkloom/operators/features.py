"""Feature engineering on tables: fit in one aggregate, transform in one select.

``fit_*`` runs a single aggregate over the table and returns plain numbers, a row for
the whole table; ``*_expr`` turns them into Column expressions with literals, so that a
pipeline of features is one projection that Catalyst can fuse and prune.  Encodings by
category join a grouped table, or use literals where the number of categories was
checked against a bound.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.ieee import clip, dbl

#: More categories than this are hashed, not spread over columns.
MAX_CATEGORIES = 100


def _agg(df: DataFrame, **columns: Column):
    return df.agg(*[c.alias(k) for k, c in columns.items()]).first()


# Numbers


def order_statistics(df: DataFrame, x: Column, places: list[int], most: int = 1 << 14, buckets: int = 4096) -> dict[int, float]:
    """The values at ``places`` (from 0) of ``x`` in order, nulls left out and NaN last; exact.

    Rows are counted by value range, and each range that holds a place is split again until it
    has ``most`` rows or one value; only those are counted by value.  One aggregate for all
    places of a round; what comes to the driver is bounded by the number of ranges.
    """
    inf = float("inf")
    rows = df.select(dbl(x).alias("x"))  # no filter: it would be pushed below with a copy of the expression
    inner = (F.col("x") > -inf) & (F.col("x") < inf)
    below, n, above, lo, hi = rows.agg(F.count_if(F.col("x") == -inf), F.count_if(inner), F.count_if(F.col("x") == inf), F.min(F.when(inner, F.col("x"))), F.max(F.when(inner, F.col("x")))).first()
    out, todo = {}, {}  # todo: (lo, hi, rows) with the places inside it, counted from its first row
    for p in places:
        if p < below or p >= below + n:
            out[p] = -inf if p < below else inf if p < below + n + above else math.nan
        else:
            todo.setdefault((lo, hi, n), []).append((p, p - below))
    while todo:
        spans = [k for k in todo if k[0] < k[1]]
        out |= {p: k[0] for k in todo if k not in spans for p, _ in todo[k]}
        if not spans:
            break
        part, by = F.lit(None).cast("int"), F.lit(None).cast("double")
        for i, (lo, hi, n) in reversed(list(enumerate(spans))):
            inside, width = F.col("x").between(lo, hi), hi / 2 - lo / 2  # halves can't overflow
            cut = F.col("x") if n <= most or not width else F.least(F.floor((F.col("x") / 2 - lo / 2) / width * buckets), F.lit(buckets - 1)).cast("double")
            part, by = F.when(inside, F.lit(i)).otherwise(part), F.when(inside, cut).otherwise(by)
        found = rows.select("x", part.alias("part"), by.alias("b")).groupBy("part", "b").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).where("part IS NOT NULL")
        new = {}
        counted = sorted(found.collect(), key=lambda r: (r["part"], r["b"]))
        for i, span in enumerate(spans):
            start = 0
            for r in (r for r in counted if r["part"] == i):
                new_places = [(p, k - start) for p, k in todo[span] if start <= k < start + r["n"]]
                if new_places:
                    new[r["lo"], r["hi"], r["n"]] = new_places
                start += r["n"]
        todo = new
    return out


def _between(n: int, share: float) -> tuple[int, int, float]:
    """The places around a quantile of ``n`` values, and how far it lies from the first to the second."""
    at = share * (n - 1)
    return math.floor(at), math.ceil(at), at - math.floor(at)


def quantiles(df: DataFrame, column: str | Column, shares: list[float]) -> list[float | None]:
    """Exact, with linear interpolation, NaN last; None for each if there are no values.

    No task holds the column: values are found by counts over ranges.
    """
    x = F.col(column) if isinstance(column, str) else column
    n = df.agg(F.count(x)).first()[0]
    if not n:
        return [None] * len(shares)
    ends = [_between(n, s) for s in shares]
    v = order_statistics(df, x, sorted({p for a, b, _ in ends for p in (a, b)}))
    return [v[a] if a == b else v[a] + (v[b] - v[a]) * w for a, b, w in ends]


def _small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """The table for a broadcast if it has at most ``most`` rows, which the driver then holds; else as it is."""
    rows = df.limit(most + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= most else df


def grouped_quantiles(df: DataFrame, by: list[str], columns: dict[str, tuple[str, float]], accuracy: int = 20_000) -> DataFrame:
    """``by`` and, for each name in ``columns``, the exact quantile (column, share) of each group, interpolated.

    Nulls and NaN are left out.  Approximate quantiles on both sides of the wanted one, whose
    rank is known to one part in ``accuracy``, bound where it lies; what is below is counted,
    and only the values between are ranked.  Groups of up to four times ``accuracy`` rows are
    ranked whole.
    """

    def joined(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        """By equal keys, nulls included; the right side's keys go."""
        other = right.withColumnsRenamed({c: f"__{c}" for c in by})
        same = [F.col(f"`{c}`").eqNullSafe(F.col(f"`__{c}`")) for c in by]
        return left.join(other, same, how).drop(*[f"__{c}" for c in by])

    out = None
    for name, (column, share) in columns.items():
        x = dbl(F.col(column))
        rows = df.select(*by, x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
        around = [max(0.0, share - 2 / accuracy), min(1.0, share + 2 / accuracy)]
        found = rows.groupBy(*by).agg(F.percentile_approx("x", around, accuracy).alias("e"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("all"))
        few = F.col("all") <= 4 * accuracy
        ends = _small(found.select(*by, "all", F.when(few, F.col("lo")).otherwise(F.col("e")[0]).alias("lo"), F.when(few, F.col("hi")).otherwise(F.col("e")[1]).alias("hi")))
        near = joined(rows, ends).where("x <= hi").groupBy(*by, "all", F.when(F.col("x") >= F.col("lo"), F.col("x")).alias("x")).agg(F.count("*").alias("n"))  # all below as one null
        at = share * (F.col("all") - 1)
        upto = near.withColumn("upto", F.sum("n").over(Window.partitionBy(*by).orderBy(F.col("x").asc_nulls_first())))
        value = [F.min(F.when(F.col("upto") > place(at), F.col("x"))) for place in (F.floor, F.ceil)]
        got = upto.groupBy(*by, "all").agg(value[0].alias("a"), value[1].alias("b"))
        one = got.select(*by, F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (at - F.floor(at))).alias(name))
        out = one if out is None else joined(out, one, "left")
    return out


def fit_median(df: DataFrame, column: str, zero_filled: bool = False) -> float | None:
    """Of the values there are, or of all rows with missing ones as 0; None if there are none."""
    x = dbl(F.col(column))
    x = F.when(F.isnan(x), None).otherwise(x)
    return quantiles(df, F.coalesce(x, F.lit(0.0)) if zero_filled else x, [0.5])[0]


def impute_expr(column: str | Column, value: float) -> Column:
    x = dbl(F.col(column) if isinstance(column, str) else column)
    return F.when(x.isNull() | F.isnan(x), F.lit(value)).otherwise(x)


def fit_iqr(df: DataFrame, column: str, factor: float = 1.5) -> tuple[float | None, float | None]:
    """The fences of interpolated quartiles; None for both if there are no values."""
    lo, hi = quantiles(df, column, [0.25, 0.75])
    return (None, None) if lo is None else (lo - factor * (hi - lo), hi + factor * (hi - lo))


def fit_order_iqr(df: DataFrame, column: str, factor: float = 1.5) -> tuple[float, float]:
    """The same fences from order statistics: the values at places n // 4 and 3 n // 4."""
    x = dbl(F.col(column))
    n = df.where(x.isNotNull()).count()
    if not n:
        return None, None
    v = order_statistics(df, x, [n // 4, 3 * n // 4])
    lo, hi = v[n // 4], v[3 * n // 4]
    return lo - factor * (hi - lo), hi + factor * (hi - lo)


def fit_order_scale(df: DataFrame, column: str) -> tuple[float | None, float | None]:
    """Ends for scaling from order statistics: the values at places n // 20 and 19 n // 20."""
    x = dbl(F.col(column))
    n = df.where(x.isNotNull()).count()
    v = order_statistics(df, x, [n // 20, 19 * n // 20]) if n else {}
    return v.get(n // 20), v.get(19 * n // 20)


def robust_expr(x: Column, low: float, high: float) -> Column:
    return clip((x - low) / max(high - low, 1e-8), 0.0, 1.0)


def fit_standard(df: DataFrame, columns: list[str], least_variance: float = 1e-6) -> dict[str, tuple[float, float]]:
    """Mean and deviation of each column, in one pass."""
    row = df.agg(*[F.avg(dbl(F.col(c))) for c in columns], *[F.var_pop(dbl(F.col(c))) for c in columns]).first()
    return {c: (row[i], math.sqrt(max(row[len(columns) + i], least_variance))) for i, c in enumerate(columns)}


def standard_expr(x: Column, mean: float, std: float) -> Column:
    return (dbl(x) - mean) / std


def standard_inverse(x: Column, mean: float, std: float) -> Column:
    return dbl(x) * std + mean


def minmax_expr(x: Column, low: float, high: float) -> Column:
    return (dbl(x) - low) / (high - low if high > low else 1e-8)


def robust_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Impute by the median, winsorise at 1.5 IQR, scale by the 5th and 95th percentile.

    Each step's numbers are of the step before.  As winsorising keeps the order, its
    percentiles are those of the imputed values, clipped.  A column without values is 0.
    """
    out = {}
    for c in columns:
        name, m = f"{c}_scaled", fit_median(df, c)
        if m is None:
            out[name] = F.lit(0.0)
            continue
        x = impute_expr(c, m)
        n = df.count()
        ends = [_between(n, s) for s in (0.25, 0.75, 0.05, 0.95)]
        v = order_statistics(df, x, sorted({p for a, b, _ in ends for p in (a, b)}))
        q1, q3 = (v[a] + (v[b] - v[a]) * w for a, b, w in ends[:2])
        fence = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        v = {p: min(max(y, fence[0]), fence[1]) for p, y in v.items()}
        low, high = (v[a] + (v[b] - v[a]) * w for a, b, w in ends[2:])
        out[name] = robust_expr(clip(x, *fence), low, high)
    return df.withColumns(out)


def binarise_expr(x: Column, threshold: float = 0.5) -> Column:
    """1 above the threshold, else 0; null stays null."""
    return (dbl(x) > threshold).cast("double")


# Categories


def safe_name(value) -> str:
    return re.sub(r"[^0-9a-zA-Z_]", "_", str(value))


def categories(df: DataFrame, column: str, most: int = MAX_CATEGORIES) -> list | None:
    """Sorted categories, or None if there are more than ``most``: the list never grows with the data."""
    found = df.where(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).collect()
    return None if len(found) > most else sorted(r[0] for r in found)


def one_hot_exprs(column: str, values: list) -> dict[str, Column]:
    """A null is in no category."""
    return {f"{column}_{safe_name(v)}": F.coalesce(F.col(column) == F.lit(v), F.lit(False)).cast("double") for v in values}


def ordinal_expr(column: str, values: list) -> Column:
    """The place in the sorted categories; -1 for others."""
    out = F.lit(-1)
    for i, v in reversed(list(enumerate(values))):
        out = F.when(F.col(column) == F.lit(v), F.lit(i)).otherwise(out)
    return out


def hash_expr(column: str, component: int, seed: int = 42) -> Column:
    """A number in [0, 1) from an md5 of value and seed, the same in every process; 0 for null."""
    digits = F.substring(F.md5(F.concat(F.col(column).cast("string"), F.lit(str(seed + component))).cast("binary")), 1, 7)
    return F.coalesce((F.conv(digits, 16, 10).cast("long") % 10000) / 10000.0, F.lit(0.0))


def hash_exprs(column: str, n: int = 16, seed: int = 42) -> dict[str, Column]:
    return {f"{column}_hash_{j}": hash_expr(column, j, seed) for j in range(n)}


def target_encode(df: DataFrame, column: str, target: str, smoothing: float = 10.0) -> DataFrame:
    """Adds ``{column}_target``: the category's mean drawn towards the overall mean; that mean for null.

    The grouped table is joined by key; Spark broadcasts it only if its size allows.  Without
    any target the code is null.
    """
    overall = F.lit(df.agg(F.avg(dbl(F.col(target)))).first()[0]).cast("double")
    stats = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.avg(dbl(F.col(target))).alias("__m"), F.count(F.col(target)).alias("__n"))
    code = (F.coalesce("__m", overall) * F.col("__n") + overall * smoothing) / (F.col("__n") + smoothing)
    out = df.join(stats.withColumn("__c", code).select(column, "__c"), column, "left")
    return out.withColumn(f"{column}_target", F.coalesce("__c", overall)).drop("__c")


# Times


def cyclical_exprs(column: str) -> dict[str, Column]:
    """Zero-based parts over their largest value: hour/23, weekday/6 from Monday, day/30, month/11."""
    c = F.col(column)
    parts = {"hour": F.hour(c) / 23, "dayofweek": F.weekday(c) / 6, "day": (F.dayofmonth(c) - 1) / 30, "month": (F.month(c) - 1) / 11}
    return {f"{column}_{fn}_{k}": (F.sin if fn == "sin" else F.cos)(2 * math.pi * p) for k, p in parts.items() for fn in ("sin", "cos")}


def warehouse_cyclical_exprs(column: str, pi: float = 3.14159) -> dict[str, Column]:
    """The other convention: month/12, weekday/7 and hour/24, with pi to five places (a fixed value)."""
    c = F.col(column)
    parts = {"month": F.month(c) / 12, "dayofweek": F.weekday(c) / 7, "hour": F.hour(c) / 24}
    return {f"{column}_{fn}_{k}": (F.sin if fn == "sin" else F.cos)(2 * pi * p) for k, p in parts.items() for fn in ("sin", "cos")}


def component_exprs(column: str) -> dict[str, Column]:
    c = F.col(column)
    fns = {"year": F.year, "month": F.month, "day": F.dayofmonth, "dayofweek": F.weekday, "hour": F.hour, "minute": F.minute, "quarter": F.quarter}
    return {f"{column}_{k}": f(c).cast("int") for k, f in fns.items()} | {f"{column}_epoch": F.unix_timestamp(c.cast("timestamp"))}


# Texts


def text_exprs(column: str) -> dict[str, Column]:
    """Length, words, mean word length and shares of capitals, digits and other signs."""
    t = F.coalesce(F.col(column), F.lit(""))
    words, length = F.regexp_count(t, F.lit(r"\S+")), F.length(t)

    def share(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern)) / (length + 1)

    return {
        f"{column}_length": length.cast("double"), f"{column}_word_count": words.cast("double"), f"{column}_avg_word_length": length / (words + 1),
        f"{column}_upper_ratio": share("[A-Z]"), f"{column}_digit_ratio": share("[0-9]"), f"{column}_special_ratio": share("[^a-zA-Z0-9 \\t\\n\\r]"),
    }


def vocabulary(df: DataFrame, column: str, most: int = 100) -> list[tuple[str, int]]:
    """The terms (of two letters or more, lower case) with the most occurrences, and their document counts."""
    terms = df.select(F.explode(F.array_distinct(_terms(column))).alias("term"))
    counts = df.select(F.explode(_terms(column)).alias("term")).groupBy("term").agg(F.count("*").alias("tf"))
    top = counts.orderBy(F.desc("tf"), "term").limit(most)
    return sorted((r["term"], r["df"]) for r in terms.join(F.broadcast(top), "term").groupBy("term").agg(F.count("*").alias("df")).collect())  # at most ``most`` rows


def _terms(column: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(r"([a-z0-9_]{2,})"), F.lit(1))


def tfidf(df: DataFrame, key: str, column: str, most: int = 100) -> DataFrame:
    """``key, term, weight`` for the ``most`` commonest terms: counts times smooth idf, of length 1 for each row.

    The commonest terms are counted first, which moves a number for each term and task; only their counts are then kept by row,
    ``most`` at most for each.
    """
    n_docs = df.count()
    terms = df.select(key, F.explode(_terms(column)).alias("term"))
    top = terms.groupBy("term").agg(F.count("*").alias("tf")).orderBy(F.desc("tf"), "term").limit(most).select("term")
    counts = terms.join(F.broadcast(top), "term").groupBy(key, "term").agg(F.count("*").alias("n"))  # ``most`` rows are broadcast
    found = counts.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.broadcast(found.select("term", (F.ln((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1).alias("idf")))  # at most ``most`` rows
    raw = counts.join(idf, "term").select(key, "term", (F.col("n") * F.col("idf")).alias("w"))
    return raw.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))).drop("w")


# Structure


def flatten_struct(df: DataFrame, column: str) -> DataFrame:
    """A struct column's fields as columns ``{column}_{field}``, nested ones included."""

    def leaves(path: str, kind: T.DataType) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [x for f in kind for x in leaves(f"{path}.{f.name}", f.dataType)]
        return [F.col(path).alias(path.replace(".", "_"))]

    return df.select(*[c for c in df.columns if c != column], *leaves(column, df.schema[column].dataType))


def profile(df: DataFrame) -> DataFrame:
    """One row for each column: type, null share, distinct values, mean text length and mean words.

    Distinct values are counted exactly at any size, each column by an aggregate of its own over a scan of that column alone.
    """
    plain = [n for n, k in df.dtypes if not k.startswith(("array", "map", "struct", "variant"))]
    each = [df.select(F.col(f"`{c}`").alias("v")).agg(F.lit(c).alias("column"), F.count_distinct("v").alias("n")) for c in plain]
    counted = {r["column"]: r["n"] for r in reduce(DataFrame.unionByName, each).collect()} if each else {}  # a row for each column
    aggs = []
    for name, kind in df.dtypes:
        c, none = F.col(f"`{name}`"), F.lit(None).cast("double")
        aggs.append(F.struct(
            F.lit(name).alias("column"), F.lit(kind).alias("type"), F.avg(c.isNull().cast("int")).alias("null_ratio"), F.lit(counted.get(name)).cast("long").alias("n_distinct"),
            (F.avg(F.length(c)) if kind == "string" else none).alias("avg_length"), (F.avg(F.regexp_count(c, F.lit(r"\S+"))) if kind == "string" else none).alias("avg_words"),
        ))
    return df.agg(F.array(*aggs).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


#: Parts of names that tell an identifier (fixed values).
ID_PARTS = ("id", "identifier", "uuid", "guid", "key", "num", "code")


def type_table(df: DataFrame, few: int = 10, many: int = 100, null_ratio: float = 0.2) -> DataFrame:
    """``column, kind, strategy, null_ratio, n_distinct``: what each column is and how to encode it.

    A string column is text if its values have 0.3 words or more on average over all rows
    (three in ten values); lengths then decide how.  All rows count, not a sample.
    """
    out = []
    for r in profile(df).collect():  # a row for each column
        kind, n = r["type"], r["n_distinct"] or 0
        one_hot = ("categorical", "one_hot_encoding")
        if kind.startswith(("timestamp", "date")):
            said = "datetime", "cyclical_encoding"
        elif kind == "boolean":
            said = "boolean", "direct"
        elif kind.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")):
            said = one_hot if n <= few else ("numeric", "robust_scaling_with_imputation" if (r["null_ratio"] or 0) > null_ratio else "robust_scaling")
        elif kind.startswith("struct"):
            said = "struct", "recursive_flatten"
        elif kind != "string":
            said = one_hot
        elif (r["avg_words"] or 0) >= 0.3:
            length = r["avg_length"] or 0
            said = ("text", "embeddings") if length > 100 else ("text", "tfidf") if length > 20 else ("text", "hash_encoding") if n > many else one_hot
        elif n > many:
            said = ("identifier" if any(p in r["column"].lower() for p in ID_PARTS) else "categorical"), "hash_encoding"
        else:
            said = ("categorical", "target_encoding") if n > few else one_hot
        out.append((r["column"], *said, r["null_ratio"], r["n_distinct"]))
    return df.sparkSession.createDataFrame(out, "column string, kind string, strategy string, null_ratio double, n_distinct long")


def detect_types(df: DataFrame) -> dict[str, str]:
    """Column kinds: boolean, datetime, numeric, struct, identifier, categorical or text."""
    out, n = {}, df.count()
    stats = {r["column"]: r for r in profile(df).collect()}  # a row for each column
    for name, kind in df.dtypes:
        r = stats[name]
        if kind == "boolean":
            out[name] = "boolean"
        elif kind.startswith(("timestamp", "date")):
            out[name] = "datetime"
        elif kind.startswith("struct"):
            out[name] = "struct"
        elif re.search(r"(^id$|^id_|_id$|uuid|guid)", name.lower()) and (r["n_distinct"] or 0) > 0.9 * n:
            out[name] = "identifier"
        elif kind.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")):
            few = n and r["n_distinct"] / n < 0.05 and r["n_distinct"] < 20
            out[name] = "categorical" if few else "numeric"
        elif kind == "string":
            out[name] = "categorical" if r["n_distinct"] <= MAX_CATEGORIES else "text"
        else:
            out[name] = "other"
    return out


def temporal_split(df: DataFrame, column: str, train: float = 0.8) -> DataFrame:
    """Adds ``split``: train up to the quantile of time, then halves of the rest; rows without a time are test."""
    t = F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    a, b = quantiles(df, t, [train, (1 + train) / 2])
    return df.withColumn("split", F.when(t <= a, "train").when(t <= b, "validation").otherwise("test"))


def hash_split(df: DataFrame, key: str, train: int = 80, validation: int = 10) -> DataFrame:
    """Adds ``split`` by a hash of the key: stable under reruns, new rows and lost executors."""
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 7), 16, 10).cast("long") % 100
    return df.withColumn("split", F.when(bucket < train, "train").when(bucket < train + validation, "validation").otherwise("test"))


#: What stands for null where it is a category of its own.
MISSING = "MISSING"


@dataclass
class Extractor:
    """Statistics of a table, and the projection they make of it or of any other with its columns.

    Numbers are standardised (nulls as the mean), times become cycles, texts measures, flags
    numbers.  Categories are one-hot columns, in which null may be one of its own; those with
    more than ``MAX_CATEGORIES`` values are hashed.  ``target`` codes replace them where asked.
    """

    kinds: dict[str, str]
    scales: dict[str, tuple[float, float]]
    values: dict[str, list | None]
    missing: bool = False
    codes: dict[str, DataFrame] = field(default_factory=dict)
    overall: float = 0.0

    def exprs(self) -> dict[str, Column]:
        new: dict[str, Column] = {}
        for c, k in self.kinds.items():
            if k == "numeric":
                new[f"{c}_scaled"] = standard_expr(F.coalesce(dbl(F.col(c)), F.lit(self.scales[c][0])), *self.scales[c])
            elif k == "datetime":
                new |= cyclical_exprs(c)
            elif c in self.codes:
                new[f"{c}_target"] = F.coalesce(F.col(f"__{c}"), F.lit(self.overall))
            elif k == "categorical" and self.values[c] is None:
                new |= hash_exprs(c)
            elif k == "categorical":
                new |= one_hot_exprs(c, self.values[c]) | ({f"{c}_{MISSING}": dbl(F.col(c).isNull())} if self.missing else {})
            elif k == "text":
                new |= text_exprs(c)
            elif k == "boolean":
                new[f"{c}_flag"] = dbl(F.col(c))
        return new

    def transform(self, df: DataFrame, drop_original: bool = True) -> DataFrame:
        """One projection; a target code is a join with a table of one row for each category."""
        new, rows = self.exprs(), df
        for c, codes in self.codes.items():
            rows = rows.join(codes.withColumnsRenamed({c: f"__k_{c}"}), F.col(c) == F.col(f"__k_{c}"), "left")
        rest = [F.col(c) for c in df.columns if not drop_original or not any(n.startswith(f"{c}_") for n in new)]
        return rows.select(*rest, *[e.alias(n) for n, e in new.items()])


def fit_extractor(df: DataFrame, kinds: dict[str, str], target: str | None = None, missing: bool = False, smoothing: float = 10.0) -> Extractor:
    """Learn from ``df``; with a ``target`` column, categories are coded by its smoothed mean."""
    kinds = {c: k for c, k in kinds.items() if c != target}
    numbers, named = ([c for c, k in kinds.items() if k == kind] for kind in ("numeric", "categorical"))
    scales = fit_standard(df, numbers) if numbers else {}
    if target is None:
        return Extractor(kinds, scales, {c: categories(df, c) for c in named}, missing)
    y, out = dbl(F.col(target)), Extractor(kinds, scales, {}, missing)
    out.overall = df.agg(F.avg(y)).first()[0] or 0.0
    for c in named:
        code = (F.coalesce(F.avg(y), F.lit(out.overall)) * F.count(y) + out.overall * smoothing) / (F.count(y) + smoothing)
        out.codes[c] = df.where(F.col(c).isNotNull()).groupBy(c).agg(code.alias(f"__{c}"))
    return out


def engineer(df: DataFrame, kinds: dict[str, str], drop_original: bool = True) -> DataFrame:
    """Fit and transform in one step."""
    return fit_extractor(df, kinds).transform(df, drop_original)


def prepare(df: DataFrame, key: str, kinds: dict[str, str] | None = None, target: str | None = None, force_categorical: tuple = (), drop: tuple = (), force: dict[str, str] | None = None, high_null: float = 0.9, time: str | None = None) -> tuple[DataFrame, Extractor]:
    """The whole way to features: ``key``, the target, ``split`` and the features of every row, and what was learned.

    Named columns are dropped, as are those with a larger share of nulls than ``high_null``;
    forced ones are categorical, or of the kind that ``force`` names, whatever they hold.  The split is by quantiles of ``time``, or
    by a hash of the key.  Statistics are of the training rows alone.
    """
    nulls = {r["column"]: r["null_ratio"] or 0.0 for r in profile(df).select("column", "null_ratio").collect()}
    kept = [c for c in df.columns if c not in drop and (c in (key, target, time) or nulls[c] <= high_null)]
    found = kinds or detect_types(df.select(kept))
    found |= {c: k for c, k in (force or {}).items() if c in found}
    found = {c: "categorical" if c in force_categorical else k for c, k in found.items() if c in kept and c not in (key, target)}
    rows = df.select(kept)
    rows = temporal_split(rows, time) if time else hash_split(rows, key)
    learned = fit_extractor(rows.where("split = 'train'"), found, target)
    out = learned.transform(rows)
    return out.select(key, *([target] if target else []), "split", *[c for c in out.columns if c in learned.exprs()]), learned


def quantile_rank(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Adds ``percent_rank`` inside each key."""
    return df.withColumn("percent_rank", F.percent_rank().over(Window.partitionBy(*key).orderBy(value)))
