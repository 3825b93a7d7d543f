"""Secret scans: fixed patterns, and a token-efficiency test.

Three base patterns find assignments, access keys and long hexadecimal runs.  The
method adds random-looking strings: a vocabulary learned on ordinary text covers words
with few tokens and random strings with many, so a run, or a stretch of it between
separators, with few characters per token is flagged, once numbers, known digests and
identifiers are set aside.  An identifier is made of parts whose letters are words by the
same measure; capitals may be words in small letters.

Defined cases: a null text is empty and has no spans.  Offsets count code points, ends
are exclusive.  Rows are independent.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.bpe import encoder
from sparkloom.llm.common import file_bytes, map_rows, texts

KINDS = ("assign", "access", "hex", "random")
BASE_KINDS = KINDS[:3]
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # greedy and leftmost: exactly the runs of 16 and more
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
PART = re.compile(r"[+/_-]+")
PIECE = re.compile(r"[^+/_-]+")
LEAST_LENGTH = 16
#: Letters of a part that are too few to tell words from random ones.
SHORT = 3
#: Letters, then digits; one way to match each, as nested repeats would take exponential time.
NAME = re.compile(r"[A-Za-z]*[0-9]*")
#: Characters for each token, below which a run counts as random.
LEAST_RATIO = 2.2
#: What the limit is less for letters in one case, as long words of little known languages come near it.
LESS_IN_ONE_CASE = 0.2
ONE_CASE = re.compile("[A-Za-z]?[a-z]*|[A-Z]*")
MARK = "[SECRET]"


def ordinary(run: str, wordy: Callable[[str], bool] = lambda letters: True) -> bool:
    """Whether a run is a number, a known digest or an identifier: parts of words by ``wordy``, then digits."""
    if not re.search("[A-Za-z]", run):
        return True
    if len(run) in DIGEST_LENGTHS and re.fullmatch("[0-9a-f]+|[0-9A-F]+", run) and re.search("[0-9]", run) or UUID.fullmatch(run):
        return True
    return all(NAME.fullmatch(p) and wordy(p.rstrip("0123456789")) for p in PART.split(run.rstrip("=")))


def random_spans(run: str, enc, least_ratio: float) -> list[tuple[int, int]]:
    """The whole run if it is random, else the stretches of it that are.

    A stretch is parts in a row none of which is ordinary, so words around can't dilute it.
    """

    def dense(x: str) -> bool:
        return len(x) < (least_ratio - LESS_IN_ONE_CASE * bool(ONE_CASE.fullmatch(x))) * len(enc.encode_ordinary(x))

    def wordy(letters: str) -> bool:
        return len(letters) <= SHORT or not dense(letters) or letters.isupper() and not dense(letters.lower())

    if ordinary(run, wordy):
        return []
    if dense(run):
        return [(0, len(run))]
    found, start, end = [], None, 0
    for m in [*PIECE.finditer(run), None]:
        if m and dense(m[0]) and not ordinary(m[0], wordy):
            start, end = m.start() if start is None else start, m.end()
            continue
        if start is not None and end - start >= LEAST_LENGTH and dense(run[start:end]):
            found.append((start, end))
        start = None
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def spans_of(text: str | None, enc, least_ratio: float = LEAST_RATIO) -> list[tuple[str, int, int]]:
    """All spans, by start and then by kind as listed in ``KINDS``."""
    if not text:
        return []
    found = base_spans(text)
    for m in RUN.finditer(text):
        found += [("random", m.start() + a, m.start() + b) for a, b in random_spans(m[0], enc, least_ratio)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact_text(text: str | None, spans: list[tuple[str, int, int]], mark: str = MARK) -> str | None:
    """The text with overlapping spans merged and each replaced by a mark."""
    if not spans:
        return text
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, rank_path: str, pattern: str, least_ratio: float = LEAST_RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``spans``, an array of (kind, start, end); one pass, no shuffle."""
    ranks = docs.sparkSession.sparkContext.broadcast(file_bytes(rank_path))

    def run(batch: pa.RecordBatch) -> list:
        enc = encoder(ranks.value, pattern)
        found = [spans_of(t, enc, least_ratio) for t in batch.column("text").to_pylist()]
        return [batch.column("doc_id"), [[dict(zip(("kind", "start", "end"), s)) for s in x] for x in found]]

    return map_rows(texts(docs, id_col, text_col), run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, rank_path: str, pattern: str, least_ratio: float = LEAST_RATIO, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents with every span replaced by ``MARK``; all rows and columns stay.

    ``length_col``, where the table has it, gets the new length in code points.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(file_bytes(rank_path))
    names = docs.columns

    def run(batch: pa.RecordBatch) -> list:
        enc = encoder(ranks.value, pattern)
        new = [redact_text(t, spans_of(t, enc, least_ratio)) for t in batch.column(names.index(text_col)).to_pylist()]
        return [new if c == text_col else batch.column(i) for i, c in enumerate(names)]

    out = map_rows(docs, run, docs.schema)
    if length_col and names.count(length_col) == 1:
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(docs.schema[length_col].dataType))
    return out


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
