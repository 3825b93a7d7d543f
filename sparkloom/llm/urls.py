"""URL filters against dated lists: a temporal list join.

A list is a log of dated entries: a domain is added or removed.  Entries become validity
intervals, and each capture is held against those active on the day it was fetched, for
its host and every parent domain.

The as-of join is an equi-join: intervals are spread over those months they touch in
which something was fetched, and meet captures on (domain, month); inside a key an
interval test decides.  Captures are
reduced to distinct (host, day) pairs first, so a host with a third of all pages sends
one row a day into the join.  Only parent domains with as many labels as some entry has
are asked for: hosts of many labels stay cheap, and a bare ``com`` that no list holds is
no hot key.

Defined cases: a host is what follows ``//`` and the last ``@`` up to a port, path, query
or fragment, in small letters and without trailing dots; an IPv6 address keeps its
brackets.  Leading blanks and control characters are skipped, a scheme may be absent
before ``//``.  A null URL or one without ``//`` after its scheme has the empty host,
which no entry matches.  Entries may have blanks around and trailing dots.  A null day
matches nothing; any day Spark holds is good.  Of an addition and a removal of the same
day the addition holds.  Repeated rows each get their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[\x00-\x20]*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    return F.coalesce(F.rtrim(F.regexp_extract(F.lower(url), HOST, 1), F.lit(".")), F.lit(""))


def _entry(domain: Column) -> Column:
    return F.rtrim(F.trim(F.lower(domain)), F.lit("."))


def suffixes(host: Column, least: int, most: int) -> Column:
    """The host and its parent domains (a.b.c, b.c and c), of ``least`` to ``most`` labels."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    starts = F.sequence(F.greatest(n - most + 1, F.lit(1)), n - least + 1)
    return F.when(n >= least, F.transform(starts, lambda i: F.array_join(F.slice(parts, i, n), ".")))


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def intervals(entries: DataFrame) -> DataFrame:
    """``list, domain, valid_from, valid_to`` (exclusive) from ``list, domain, day, action``."""
    daily = entries.where("day IS NOT NULL AND domain IS NOT NULL").groupBy("list", _entry(F.col("domain")).alias("domain"), "day").agg(F.max(F.col("action") == "add").alias("on"))
    nxt = F.lead("day").over(Window.partitionBy("list", "domain").orderBy("day"))
    return daily.withColumn("valid_to", F.coalesce(nxt, F.lit(FOREVER).cast("date"))).where("on").select("list", "domain", F.col("day").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "fetched_on") -> DataFrame:
    """``captures`` with ``host``, ``blocked`` and the entry that decided: of the longest
    matching domain, then the first list by name."""
    given = captures.select(*[c for c in captures.columns if c not in ("host", "blocked", "list", "domain", "valid_from")]).withColumn("host", host_of(F.col(url_col)))
    keys = given.where("host <> ''").select("host", F.col(day_col).alias("day")).where("day IS NOT NULL").distinct()
    held = intervals(entries)
    # Months are at most 12 for each year that a date can have: a bound for the driver.
    months = sorted(r[0] for r in keys.select(_month(F.col("day"))).distinct().collect())
    occurring = F.filter(F.split(F.lit(",".join(map(str, months))), ","), lambda m: m != "").cast("array<int>")  # one literal
    touched = F.filter(occurring, lambda m: m.between(_month(F.col("valid_from")), _month(F.col("valid_to"))))
    spread = held.withColumn("month", F.explode(touched))
    labels = F.size(F.split("domain", r"\."))
    least, most = held.agg(F.min(labels), F.max(labels)).first()  # two numbers
    asked = keys.select("host", "day", F.explode(suffixes(F.col("host"), least or 1, most or 1)).alias("domain")).withColumn("month", _month(F.col("day")))
    met = asked.join(spread, ["domain", "month"]).where((F.col("valid_from") <= F.col("day")) & (F.col("day") < F.col("valid_to")))
    best = met.groupBy("host", "day").agg(F.min_by(F.struct("list", "domain", "valid_from"), F.struct(-F.length("domain"), "list", "valid_from")).alias("__hit"))
    out = given.join(best.withColumnRenamed("day", day_col), ["host", day_col], "left")
    return out.withColumn("blocked", F.col("__hit").isNotNull()).select("*", "__hit.list", "__hit.domain", "__hit.valid_from").drop("__hit")
