"""Benchmark decontamination by suffix arrays over the training texts.

Training documents are taken in shards of about ``SHARD`` words.  Words that no benchmark
text has become one unknown word, at which every match ends.  A shard's suffix array orders
all places that hold a known word by the words from there on, as deep as the longest
benchmark text goes: several words make one sort key, then places that still tie are
ordered by the rank of what follows them, twice as deep each time.  Every suffix of a
benchmark text is looked up by binary search, word by word, to the end of its longest match.
The range of the array at a window's depth holds all places of that window; the range at the
end holds the places of the longest verbatim match.

Documents are read once and nothing is shuffled.  The benchmark is dealt by hash to blocks
of about ``BLOCK`` characters; each is sent to the tasks by itself and a task holds one at a
time, so neither side has to fit in memory as a whole.

Defined cases: a null text, or one without words, is never hit and hits nothing.  A text of
fewer than ``window`` words is one window.  Benchmark rows that share an id are texts of one
item; a null id counts as the empty string.  Repeated documents each get their row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sparkloom.llm.common import slices

WINDOW = 10
SHARD = 1 << 19
BLOCK = 1 << 22
#: A to Z become small letters; digits, small letters and all bytes beyond ASCII stay; the rest separates.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LETTERS).split()


def suffix_array(ids: np.ndarray, top: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the known words (ids 1 to ``top``) by what follows up to the next 0, ``depth`` words at least, and their first sort key."""
    bits = max(1, top.bit_length())
    per, n = max(1, 63 // bits), len(ids)
    ahead = np.concatenate([ids, np.zeros(per, dtype=ids.dtype)])
    key, alive = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for k in range(per):
        word = ahead[k : k + n]
        alive &= word > 0
        key = (key << bits) | np.where(alive, word, 0)
    order = np.flatnonzero(ids)
    order = order[np.argsort(key[order], kind="stable")]
    first = key[order]
    rank = np.zeros(n + 1, dtype=np.int64)  # 0: unknown; else one more than where the group of ties begins
    begins = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(first) else np.zeros(0, dtype=np.int64)
    rank[order] = np.repeat(begins, np.diff(np.append(begins, len(order)))) + 1
    ends = np.append(np.flatnonzero(ids == 0), n)
    run = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # known words from here on
    place = np.flatnonzero(np.repeat(np.diff(np.append(begins, len(order))) > 1, np.diff(np.append(begins, len(order)))))
    while per < depth and len(place):
        place = place[run[order[place]] >= per]
        at = order[place]
        both = rank[at] * (n + 2) + rank[at + per]
        by = np.argsort(both, kind="stable")
        at, both = at[by], both[by]
        order[place] = at
        new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.append(new, len(at)))
        rank[at] = np.repeat(place[new], size) + 1
        place, per = place[np.repeat(size > 1, size)], 2 * per
    return order, first


class Benchmark:
    """Distinct texts of one block as numbers of words, one after the other with a 0 behind each."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        held: dict[tuple, set] = {}
        for item, text in items:
            if w := tuple(words(text)):
                held.setdefault(w, set()).add(item)
        self.texts = [sorted(x) for x in held.values()]
        known = dict.fromkeys(x for w in held for x in w)
        self.number = dict(zip(known, range(1, len(known) + 1)))
        self.top, self.depth = len(known), max(map(len, held), default=0)
        size = np.fromiter(map(len, held), dtype=np.int64, count=len(held))
        self.ids = np.fromiter((x for w in held for x in (*map(self.number.get, w), 0)), dtype=np.int64, count=int((size + 1).sum()))
        starts = np.cumsum(size + 1) - size - 1
        width = np.minimum(size, window)  # of the windows of a text
        #: Of every suffix that a window begins: its text, place in ``ids``, place in its text, words, and window width.
        n = size - width + 1
        self.text = np.repeat(np.arange(len(size)), n)
        self.within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.place = starts[self.text] + self.within
        self.length, self.width = size[self.text] - self.within, width[self.text]
        same: dict[bytes, int] = {}
        self.window = np.fromiter((same.setdefault(self.ids[p : p + w].tobytes(), len(same)) for p, w in zip(self.place, self.width)), dtype=np.int64, count=len(self.place))
        self.held_by: list[set] = [set() for _ in same]
        for u, t in zip(self.window.tolist(), self.text.tolist()):
            self.held_by[u].update(self.texts[t])

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """The suffix array of ``ids``; for every suffix the range of its window, the length of its longest match and the range of that (0 where the window is nowhere)."""
        order, first = suffix_array(ids, self.top, self.depth)
        bits = max(1, self.top.bit_length())
        per = max(1, 63 // bits)
        key, some = np.zeros(len(self.place), dtype=np.int64), np.minimum(self.width, per)
        for k in range(per):
            key = (key << bits) | np.where(k < some, self.ids[np.minimum(self.place + k, len(self.ids) - 1)], 0)
        low = np.searchsorted(first, key)
        high = np.searchsorted(first, key + (np.int64(1) << (bits * (per - some))) - 1, side="right")
        ahead = np.concatenate([ids, np.zeros(self.depth + 1, dtype=ids.dtype)])
        found, length = (np.where(some == self.width, x, 0) for x in (low, high)), np.where(high > low, some, 0)
        left, right = found
        live = np.flatnonzero((high > low) & (self.length > some))
        while len(live):  # one word further each time; what has no such place ends here
            want, depth = self.ids[self.place[live] + length[live]], length[live]
            a = _bound(order, ahead, depth, want, low[live], high[live], False)
            b = _bound(order, ahead, depth, want, a, high[live], True)
            met = b > a
            live, depth = live[met], depth[met] + 1
            low[live], high[live], length[live] = a[met], b[met], depth
            done = live[depth == self.width[live]]
            left[done], right[done] = low[done], high[done]
            live = live[depth < self.length[live]]
        full = length >= self.width
        return order, left, np.where(full, right, left), np.where(full, length, 0), low, high


def _bound(order, ahead, depth, want, low, high, after: bool) -> np.ndarray:
    """Binary search of all at once: the first place in [low, high) whose word at ``depth`` is not below ``want``, or is above it (``after``)."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        word = ahead[order[np.minimum(middle, len(order) - 1)] + depth]
        go = open_ & ((word <= want) if after else (word < want))
        low, high = np.where(go, middle + 1, low), np.where(open_ & ~go, middle, high)
    return low


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and to which range each belongs."""
    n = high - low
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[of], of


class _Shard:
    """Words of some documents, each followed by an unknown one."""

    def __init__(self, texts: list[list[bytes]]):
        self.size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.starts = np.cumsum(self.size + 1) - self.size - 1
        self.texts = texts

    def ids(self, block: Benchmark) -> np.ndarray:
        get = block.number.get
        return np.fromiter((x for t in self.texts for x in (*map(get, t, repeat(0)), 0)), dtype=np.int32, count=int((self.size + 1).sum()))

    def of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1


def _judged(shard: _Shard, blocks) -> tuple[np.ndarray, list[set]]:
    """Hit words and items of every document."""
    n = int((shard.size + 1).sum())
    change, items = np.zeros(n + 1, dtype=np.int64), [set() for _ in shard.texts]
    for block in blocks:
        if not block.top:
            continue
        order, left, right, _, _, _ = block.find(shard.ids(block))
        _, once = np.unique(block.window, return_index=True)  # a window that many texts share is expanded once
        once = once[right[once] > left[once]]
        place, of = _ranges(left[once], right[once])
        at, which = order[place], once[of]
        np.add.at(change, at, 1)
        np.add.at(change, at + block.width[which], -1)
        for d, u in np.unique(np.stack([shard.of(at), block.window[which]], axis=1), axis=0).tolist():
            items[d] |= block.held_by[u]
    total = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
    return total[shard.starts + shard.size] - total[shard.starts], items


def _shards(batches, text: int) -> Iterator[tuple[pa.RecordBatch, _Shard]]:
    """Rows of one partition with their words, about ``SHARD`` words at a time."""
    rows, found, n = [], [], 0
    for batch in batches:
        for part in slices(batch, 1 << 22):
            rows.append(part)
            found += map(words, part.column(text).to_pylist())
            n += sum(map(len, found[-part.num_rows :]))
            if n >= SHARD:
                yield pa.Table.from_batches(rows).combine_chunks().to_batches()[0], _Shard(found)
                rows, found, n = [], [], 0
    if rows:
        yield pa.Table.from_batches(rows).combine_chunks().to_batches()[0], _Shard(found)


def _blocks(bench: DataFrame, id_col: str, text_col: str, window: int) -> list:
    """The benchmark as broadcast lists of (item, text), about ``BLOCK`` characters each."""
    spark = bench.sparkSession
    items = bench.select(F.coalesce(bench[id_col].cast("string"), F.lit("")).alias("item"), bench[text_col].cast("string").alias("text")).where("text IS NOT NULL").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // BLOCK)
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(max(1, n))))
    return [spark.sparkContext.broadcast([tuple(r) for r in dealt.where(F.col("block") == b).select("item", "text").collect()]) for b in range(n)]


class _Held:
    """The blocks one after the other; of several, only the present one is held prepared."""

    def __init__(self, sent: list, window: int):
        self.sent, self.window, self.last = sent, window, None

    def __iter__(self) -> Iterator[Benchmark]:
        for k, b in enumerate(self.sent):
            if self.last is None or self.last[0] != k:
                self.last = None
                self.last = k, Benchmark(b.value, self.window)
            yield self.last[1]


def scan(docs: DataFrame, bench: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``row`` (all columns of the document), ``doc_id``, ``n_words``, ``n_hit`` and ``items`` (ids with occurring windows, sorted)."""
    held = _blocks(bench, item_col, item_text, window)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    out = rows.select("row", "doc_id", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array(F.lit("")).alias("items")).schema
    arrow = to_arrow_schema(out)

    def run(batches):
        blocks = _Held(held, window)
        for batch, shard in _shards(batches, 2):
            hit, items = _judged(shard, blocks)
            made = [pa.array(shard.size), pa.array(hit), pa.array([sorted(x) for x in items], type=pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([batch.column(0), batch.column(1), *made], arrow)], schema=arrow)

    return rows.mapInArrow(run, out)


def remove(docs: DataFrame, bench: DataFrame, window: int = WINDOW, **columns: str) -> DataFrame:
    """The documents, as they came, that hold no window of the benchmark."""
    return scan(docs, bench, window, **columns).where("n_hit = 0").select("row.*")


MATCH = "item_id string, n_words long, item_start long, doc_id long, doc_start long"


def longest(docs: DataFrame, bench: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The longest verbatim match of every item, of a window at least, with all its places (in words)."""
    held = _blocks(bench, item_col, item_text, window)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = pa.schema([("item_id", pa.string()), *((c, pa.int64()) for c in ("n_words", "item_start", "doc_id", "doc_start"))])

    def run(batches):
        blocks = _Held(held, window)
        for batch, shard in _shards(batches, 1):
            ids = batch.column(0)
            for block in blocks:
                if not block.top:
                    continue
                order, _, _, length, low, high = block.find(shard.ids(block))
                best = np.zeros(len(block.texts), dtype=np.int64)
                np.maximum.at(best, block.text, length)
                for j in np.flatnonzero((length > 0) & (length == best[block.text])):
                    at = order[low[j] : high[j]]
                    doc = shard.of(at)
                    for item in block.texts[block.text[j]]:
                        same = [pa.array([x] * len(at)) for x in (item, int(length[j]), int(block.within[j]))]
                        yield pa.RecordBatch.from_arrays([*same, ids.take(pa.array(doc)), pa.array(at - shard.starts[doc])], schema=schema)

    found = rows.mapInArrow(run, MATCH)
    most = found.groupBy("item_id").agg(F.max("n_words").alias("n_words"))
    return found.join(most, ["item_id", "n_words"], "left_semi").select(*schema.names)
