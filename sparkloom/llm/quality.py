"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a document.  The ledger stores the measurements and
one long whose bit ``i`` says that rule ``i`` failed; :class:`Ledger` writes it as a
table.  Policies are named, versioned sets of rules: applying one is a single AND with
its mask, so a policy can change without touching a text again.  Ablations (what would each rule, left out, give back?)
are counts over masked bit patterns, of which there are at most ``2 ** len(RULES)``.

Defined cases: a null or empty text has no words, measures 0 everywhere and fails
``few_words``.  Rows are independent, so repeated rows and null ids stay as they are;
columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch, map_rows, texts

SYMBOLS = "#*$%&|<>"
SEPARATORS = " \t\n\x0b\x0c\r"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_bullet_lines", "n_ellipsis_lines"]

#: Name and failure test, over the measurements.  A rule's place is its bit: append only.
RULES: list[tuple[str, Callable[[], Column]]] = [
    ("few_words", lambda: F.col("n_words") < 50),
    ("repeated_words", lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    ("symbols", lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    ("short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
    ("long_words", lambda: F.col("word_chars") > 15 * F.col("n_words")),
    ("dup_lines", lambda: 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
    ("bullets", lambda: 10 * F.col("n_bullet_lines") > 9 * F.col("n_lines")),
    ("ellipses", lambda: 10 * F.col("n_ellipsis_lines") > 3 * F.col("n_lines")),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = ("few_words", "repeated_words")

#: Versioned policies: a document is kept if none of the named rules failed.
POLICIES = {
    "v1-base": BASE,
    "v2-symbols": (*BASE, "symbols", "dup_lines"),
    "v3-full": tuple(BIT),
    # Of the labelled documents, repeated lines alone mark only good ones: measured still, but no longer decisive.
    "v4-no-dup-lines": tuple(r for r in BIT if r != "dup_lines"),
}
PRODUCTION = "v4-no-dup-lines"


def mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def measure_text(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # splits at exactly the six ASCII separators
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(SEPARATORS)]
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < n - 2:
            seen, end = Counter(windows), 0
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeated += i + 3 - max(end, i)
                    end = i + 3
    return (
        n,
        len(text) - sum(map(text.count, SEPARATORS)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated,
        sum(x.lstrip(SEPARATORS)[0] in "-*•" for x in lines),
        sum(x.rstrip(SEPARATORS).endswith(("...", "…")) for x in lines),
    )


def _measure(batch: pa.RecordBatch) -> list:
    rows = [measure_text(t) for t in batch.column("text").to_pylist()]
    return [batch.column("doc_id"), *(zip(*rows) if rows else [()] * len(MEASURES))]


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: ``doc_id``, the measurements and ``fail_bits``.

    One pass over whole texts and no shuffle.
    """
    rows = map_rows(texts(docs, id_col, text_col), _measure, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = F.lit(0).cast("long")
    for i, (_, failed) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(failed(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return rows.withColumn("fail_bits", bits)


class Ledger:
    """The ledger of ``docs``, measured and written once; whatever is asked of it reads that table."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.rows = Scratch(docs.sparkSession, "quality").write(ledger(docs, id_col, text_col))

    def apply(self, policy: str = PRODUCTION) -> DataFrame:
        return apply_policy(self.rows, policy)

    def ablations(self, policy: str = PRODUCTION) -> DataFrame:
        return ablations(self.rows, policy)

    def compare(self) -> DataFrame:
        """``policy, n_docs, n_kept`` for every policy, from counts of bit patterns."""
        patterns = self.rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
        masks = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(mask(p)).cast("long").alias("mask")) for p in POLICIES])
        each = patterns.select("fail_bits", "n", F.explode(masks).alias("p"))
        good = F.col("fail_bits").bitwiseAND(F.col("p.mask")) == 0
        return each.groupBy("p.policy").agg(F.sum("n").alias("n_docs"), F.sum(F.when(good, F.col("n")).otherwise(0)).alias("n_kept"))


def apply_policy(rows: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """Adds ``policy`` and ``kept``."""
    return rows.withColumn("policy", F.lit(policy)).withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(rows: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """For each rule of a policy: how many documents fail it, and how many only it drops.

    The ledger is first reduced to counts of masked bit patterns, so what is exploded
    per rule is bounded by the number of patterns, not by the corpus.
    """
    m = mask(policy)
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in POLICIES[policy]])
    each = patterns.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
