"""Source divergence audit with late string materialization.

How far do the sources of a language speak alike?  Each language keeps its common terms;
each source gets a smoothed probability of every kept term; pairs of sources, and single
terms that a source prefers, are scored by a symmetric chi-square term.  All of it is
integer arithmetic.

Terms move as 64-bit digests.  The tasks count them; one shuffle brings the counts of a
digest together.  A second table holds the least and the greatest string of each digest:
where these differ, several terms share the digest, and its counts are made anew by the
terms themselves (``split``).  Texts of terms are joined back only for the terms that can be
among the first ``top`` of a source.

Pairs of sources: every kept term of a language is a vector over its sources, dealt by its
digest to ``BUCKETS`` parts.  A task walks through its terms with a matrix of ``WIDE`` by
``WIDE`` sources at most, and sums for each pair what the term adds beyond a term that
neither has; what such terms give is added once for the number of kept terms.  No two rows
of a term are joined with each other.

Defined cases: null text, language and source count as empty strings; groups without
terms have a row for each other source; a language of one source has no pairs; repeated
rows count as often as they stand.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch, slices

#: A to Z become small letters; all other signs up to DEL separate.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
LEAST_DOCS, ONE, TOP, BITS = 10, 1_000_000_000, 10, 64
#: Parts that the terms of a language are dealt to, sources side by side in one matrix, terms in one step, entries a task counts before it passes them on.
BUCKETS, WIDE, STEP, HELD = 256, 256, 1024, 500_000


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LETTERS).split()


def digests(words, bits: int = BITS) -> np.ndarray:
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
    return (h >> np.uint64(64 - bits)).view(np.int64)


def _plain(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])


def _strings(words) -> pa.Array:
    return pa.array(list(words), pa.binary()).cast(pa.string())


def counts(plain: DataFrame, bits: int, with_term: bool = False) -> DataFrame:
    """``lang, source, digest, n, df`` as far as one task has counted; the ``term`` itself on request."""
    names = ["lang", "source", "digest", "n", "df"] + ["term"] * with_term
    schema = pa.schema([(c, pa.string() if c in ("lang", "source", "term") else pa.int64()) for c in names])

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in held.items():
            same = [pa.array([x] * len(n), pa.string()) for x in (lang, source)]
            own = [pa.array(digests(n, bits)), pa.array(n.values(), pa.int64()), pa.array([df[w] for w in n], pa.int64())]
            yield pa.RecordBatch.from_arrays([*same, *own, *[_strings(n)] * with_term], schema=schema)

    def run(batches):
        held, size = {}, 0
        for whole in batches:
            for part in slices(whole):
                for key in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), part.column("text").to_pylist()):
                    if words := terms(key[2]):
                        n, df = held.setdefault(key[:2], (Counter(), Counter()))
                        size -= len(n)
                        n.update(words)
                        df.update(set(words))
                        size += len(n)
                        if size >= HELD:
                            yield from rows(held)
                            held, size = {}, 0
        yield from rows(held)

    kinds = ", ".join(f"{c} {'string' if c in ('lang', 'source', 'term') else 'long'}" for c in names)
    return plain.mapInArrow(run, kinds)


def dictionary(plain: DataFrame, bits: int) -> DataFrame:
    """``digest`` with its least and greatest string."""
    schema = pa.schema([("digest", pa.int64()), ("term", pa.string())])

    def rows(held: set) -> pa.RecordBatch:
        words = list(held)
        return pa.RecordBatch.from_arrays([pa.array(digests(words, bits)), _strings(words)], schema=schema)

    def run(batches):
        held: set[bytes] = set()
        for whole in batches:
            for part in slices(whole):
                for text in part.column("text").to_pylist():
                    held.update(terms(text))
                    if len(held) >= HELD:
                        yield rows(held)
                        held = set()
        yield rows(held)

    return plain.select("text").mapInArrow(run, "digest long, term string").groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high"))


def _times(n: str, total: str, kept: str = "vocabulary") -> Column:
    """1 + floor(ONE * (n + 2) / (total + 2 * kept)); null where nothing is kept."""
    return F.lit(1).cast("long") + F.expr(f"CASE WHEN {kept} > 0 THEN cast({ONE} as decimal(10,0)) * cast({n} + 2 as decimal(20,0)) div cast({total} + 2 * {kept} as decimal(20,0)) END")


def _apart(p, q):
    return (p - q) * (p - q) // (p + q)


def _kept(plain: DataFrame, found: DataFrame, least: int, bits: int) -> DataFrame:
    """``lang, source, digest, split, n`` of the kept terms, their ``lang_n``, and ``leads``: one row of each term of a language."""

    def summed(rows: DataFrame) -> DataFrame:  # dealt by language and digest at once, for what follows
        return rows.repartition("lang", "digest").groupBy("lang", "source", "digest", "split").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))

    shared = found.where("low <> high").select("digest")
    all_ = counts(plain, bits).withColumn("split", F.lit(""))
    if shared.head(1):
        exact = counts(plain, bits, with_term=True).join(shared, "digest", "left_semi").withColumnRenamed("term", "split")
        all_ = all_.join(shared, "digest", "left_anti").unionByName(exact)
    term = Window.partitionBy("lang", "digest", "split")
    rows = summed(all_).withColumns({"docs": F.sum("df").over(term), "lang_n": F.sum("n").over(term), "leads": F.row_number().over(term.orderBy("source")) == 1})
    return rows.where(F.col("docs") >= least).drop("docs", "df")


def _groups(plain: DataFrame, kept: DataFrame) -> DataFrame:
    """``lang, source, place, sources, total, lang_total, vocabulary`` of every group that occurs."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.when(F.col("leads"), 1)).alias("leads"))
    rows = plain.select("lang", "source").distinct().join(own, ["lang", "source"], "left").fillna(0, ["total", "leads"])
    lang = Window.partitionBy("lang")
    return rows.select(
        "lang", "source", (F.row_number().over(lang.orderBy("source")) - 1).alias("place"), F.count("*").over(lang).alias("sources"),
        "total", F.sum("total").over(lang).alias("lang_total"), F.sum("leads").over(lang).alias("vocabulary"),
    )


CELL = ["lang", "a", "b", "bucket"]


def _pair_sums(batches):
    """Sorted rows of cells: the sources of a cell (kind 0), then its terms."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    cell = None

    def close() -> Iterator[pa.RecordBatch]:
        if cell is None:
            return
        step()
        lang, a, b, bucket = cell
        i, j = np.nonzero(np.triu(np.ones(sums.shape, dtype=bool), 1) if a == b else np.ones(sums.shape, dtype=bool))
        value = sums[i, j] + (rest[i, j] * kept if bucket == 0 else 0)
        some = value != 0 if bucket else np.ones(len(value), dtype=bool)
        x, y = [names[0][k] for k in i[some]], [names[a != b][k] for k in j[some]]
        for s, t in ((x, y), (y, x)):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(s), pa.string()), pa.array(s, pa.string()), pa.array(t, pa.string()), pa.array(value[some])], schema=schema)

    def step() -> None:
        """Add the waiting terms to the sums."""
        nonlocal waiting
        if not waiting:
            return
        k, side, place, p = (np.array(x) for x in zip(*waiting))
        k -= k[0]
        both = []
        for s in (0, 1):
            both.append(np.tile(base[s], (k[-1] + 1, 1)))
            mine = side == s
            both[s][k[mine], place[mine]] = p[mine]
        x, y = both[0], both[0] if same else both[1]
        for i in range(x.shape[1]):
            j = i + 1 if same else 0
            sums[i, j:] += (_apart(x[:, i : i + 1], y[:, j:]) - rest[i, j:]).sum(axis=0)
        waiting = []

    names, base, sums, rest, kept, waiting, ordinal, term, same = [], [], None, None, 0, [], 0, None, True
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            here, (kind, digest, split, side, place, source, p, vocabulary) = r[:4], r[4:]
            if here != cell:
                yield from close()
                cell, names, base, sums, waiting, ordinal, term, same = here, [[], []], [[], []], None, [], 0, None, here[1] == here[2]
            if kind == 0:
                names[side].append(source)
                base[side].append(p)
                kept = vocabulary
                continue
            if sums is None:
                base = [np.array(x, dtype=np.int64) for x in base]
                y = base[0] if same else base[1]
                rest = _apart(base[0][:, None], y[None, :])
                sums = np.zeros(rest.shape, dtype=np.int64)
            if kind == 1:  # ends the list of sources
                continue
            if (digest, split) != term:
                if len(waiting) >= STEP * 8:
                    step()
                term, ordinal = (digest, split), ordinal + 1
            waiting.append((ordinal, side, place, p))
    yield from close()


def _pairs(scored: DataFrame, groups: DataFrame, wide: int, buckets: int) -> DataFrame:
    """``lang, source, item, value`` of all pairs of sources of a language."""
    blocks = F.ceil(F.col("sources") / wide).cast("int")
    own = F.floor(F.col("place") / wide).cast("int")

    def met(rows: DataFrame) -> DataFrame:
        each = rows.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
        return each.select(
            "lang", F.least("own", "with").alias("a"), F.greatest("own", "with").alias("b"), "bucket", "kind", "digest", "split",
            (F.col("own") > F.col("with")).cast("int").alias("side"), F.pmod("place", F.lit(wide)).cast("int").alias("place"), "source", "p", "vocabulary",
        )

    none = F.coalesce(_times("0", "total"), F.lit(1))
    everywhere = groups.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    listed = everywhere.select("*", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("digest"), F.lit("").alias("split"), none.alias("p"))
    ended = listed.where(F.col("place") % wide == 0).withColumn("kind", F.lit(1))
    found = scored.select("lang", "source", "place", "sources", "vocabulary", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket"), F.lit(2).alias("kind"), "digest", "split", "p")
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = met(listed).unionByName(met(ended)).unionByName(met(found))
    dealt = rows.repartition(parts, *CELL).sortWithinPartitions(*CELL, "kind", "digest", "split", "side", "place")
    return dealt.mapInArrow(_pair_sums, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _preferred(scored: DataFrame, found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` terms of every group; ties at the end wait for their texts."""
    apart = F.expr("(p - q) * (p - q) div (p + q)")
    rows = scored.where("p > q").select("lang", "source", "digest", "split", apart.alias("value"))
    salted = Window.partitionBy("lang", "source", F.pmod(F.xxhash64("digest"), F.lit(16))).orderBy(F.desc("value"))
    group = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    some = rows.withColumn("k", F.rank().over(salted)).where(F.col("k") <= top).withColumn("k", F.rank().over(group)).where(F.col("k") <= top)
    named = some.join(found.select("digest", "low"), "digest").withColumn("item", F.when(F.col("split") == "", F.col("low")).otherwise(F.col("split")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCS, top: int = TOP, bits: int = BITS, wide: int = WIDE, buckets: int = BUCKETS) -> DataFrame:
    """``lang, source, part, item, value, rank``: every other source of the language, and the terms a source prefers."""
    scratch = Scratch(docs.sparkSession, "divergence")
    plain = _plain(docs, text_col, lang_col, source_col)
    found = scratch.write(dictionary(plain, bits))
    kept = scratch.write(_kept(plain, found, least, bits))
    groups = scratch.write(_groups(plain, kept))
    joined = kept.join(groups, ["lang", "source"])
    scored = joined.withColumns({"p": _times("n", "total"), "q": _times("lang_n", "lang_total")})
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pairs(scored, groups, wide, buckets).withColumn("rank", F.row_number().over(order))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(_preferred(scored, found, top))
