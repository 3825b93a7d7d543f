"""Byte-level BPE encoding and decoding by a local rank file.

The driver reads the rank file (under a megabyte for 50,000 tokens) and ships its
bytes; each Python worker builds one encoder from them.  Long texts are cut at safe
boundaries first, which bounds what the splitting pattern sees at once without
changing a token: see :func:`pieces`.  Decoding joins raw bytes, so tokens that end
inside a code point are no special case.

Defined cases: a null text encodes as an empty one; a null list of ids decodes to null;
rows are independent, so repeated rows and null ids stay as they are.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from sparkloom.llm.common import file_bytes, map_rows, texts

LONG = 1 << 16
#: A blank after a letter or digit.  No match of the pattern holds a character that is not
#: white space followed by one that is, and no alternative looks ahead from there except
#: from within white space; so a match always ends here and what follows matches alike.
SAFE = re.compile(r"(?<=[A-Za-z0-9.,])[ \n]")
#: Runs of white space as the splitting pattern knows it.  Whole runs, whatever their length: a
#: least length in the pattern would have each shorter run read again from all its places.
BLANKS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


def pieces(text: str, most: int = LONG) -> Iterator[str]:
    """The text in parts that encode to the same ids as the whole.

    Each part ends at the first safe boundary after ``most`` characters; a text without
    one stays whole.
    """
    at = 0
    while len(text) - at > most and (m := SAFE.search(text, at + most)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


@functools.lru_cache(maxsize=4)
def encoder(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def encode_piece(enc: tiktoken.Encoding, text: str) -> list[int]:
    """The ids of a piece; its long runs of white space are encoded as the one match they are.

    The library's splitter remembers every place in a run that it may go back to and fails
    beyond a million of them.  No match before a run reaches into it.  The run is one match,
    but for its last sign where something follows, which the pattern leaves to the next match.
    """
    ids, at = [], 0
    for m in BLANKS.finditer(text):
        if m.end() - m.start() < LONG:
            continue
        end = m.end() if m.end() == len(text) else m.end() - 1
        ids += enc.encode_ordinary(text[at : m.start()])
        ids += enc._encode_single_piece(text[m.start() : end])
        at = end
    return ids + enc.encode_ordinary(text[at:])


def encode_text(enc: tiktoken.Encoding, text: str | None) -> list[int]:
    if not text:
        return []
    if len(text) <= LONG:
        return enc.encode_ordinary(text)
    return [i for part in pieces(text) for i in encode_piece(enc, part)]


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every whole text; no shuffle."""
    ranks = docs.sparkSession.sparkContext.broadcast(file_bytes(rank_path))

    def run(batch: pa.RecordBatch) -> list:
        enc = encoder(ranks.value, pattern)
        return [batch.column("doc_id"), [encode_text(enc, t) for t in batch.column("text").to_pylist()]]

    return map_rows(texts(docs, id_col, text_col), run, "doc_id long, ids array<int>", 2 << 20)


def decode(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Adds ``bytes`` (binary), the raw bytes of ``ids``, to ``doc_id`` and ``ids``."""
    ranks = encoded.sparkSession.sparkContext.broadcast(file_bytes(rank_path))

    def run(batch: pa.RecordBatch) -> list:
        enc = encoder(ranks.value, pattern)
        ids = batch.column("ids")
        return [batch.column("doc_id"), ids, [None if x is None else enc.decode_bytes(x) for x in ids.to_pylist()]]

    return map_rows(encoded.select("doc_id", "ids"), run, "doc_id long, ids array<int>, bytes binary", 2 << 20)
