"""Spelling variants by blocked Gram matrices over letter counts.

A word is the vector of its letter counts.  One edit changes one count by one (a letter
more or less) or two counts by one (a letter replaced), so words one edit apart have a
squared distance of one or two.  Distances of a block come from one NumPy product:
``|x|^2 + |y|^2 - 2 x.y``.

Which words form a block: the letters are dealt to four groups, and one edit touches two
of them at most.  Two words one edit apart hence agree in all counts of some two groups; each
word stands under the six pairs of groups, and a pair counts only under the first pair
of groups in which its words agree.  Inside a block, words of one length meet those of the same
and of the next length.  Blocks of more than ``CELL`` words are dealt to parts, and every
two parts meet in a task of their own, so a task holds two parts at most and no pair is lost.
Pairs at the right distance are verified letter by letter.

Defined cases: a null text has no words; a null id counts as the empty string; documents
that stand twice count twice.  A word without near words is its own root.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch, slices, texts

#: Latin-1 letters; A to Z become small, everything else separates.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))
SHORTEST, LEAST, TIMES, ERRS = 7, 2, 10, 31
GROUPS = 4
SUBSETS = list(combinations(range(GROUPS), GROUPS - 2))
#: Words of a part of a block, words that are compared at once, and words that a task counts before it passes them on.
CELL, TILE, HELD = 1 << 12, 256, 400_000


def _utf8(word: bytes) -> bytes:
    return word if word.isascii() else word.decode("latin-1").encode()


def runs(text: str | None, doc_id: int | None, shortest: int = SHORTEST) -> Iterator[tuple[bytes, int]]:
    """Words of a text in Latin-1 with their counts, those that the checksum picks with one letter less."""
    found = (text or "").encode("latin-1", "replace").translate(LETTERS).split()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for w, n in Counter([w for w in found if len(w) >= shortest]).items():
        h = zlib.crc32(_utf8(w), start)
        if h % ERRS == 0:
            at = h % len(w)
            w = w[:at] + w[at + 1 :]
            if len(w) < shortest:
                continue
        yield w, n


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """``word``, ``n``: distinct words and their occurrences, counted in each task before they move."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def batch(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], schema=schema)

    def run(batches):
        held: dict[bytes, int] = {}
        for whole in batches:
            for part in slices(whole):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    for w, n in runs(text, doc_id, shortest):
                        held[w] = held.get(w, 0) + n
                    if len(held) >= HELD:
                        yield batch(held)
                        held = {}
        yield batch(held)

    return texts(docs, id_col, text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def letter_groups(words: DataFrame) -> list[list[int]]:
    """The letters (Latin-1 numbers, at most 116) in groups that tell words apart equally well, by how evenly each letter parts the words."""
    held = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).where("letter <> ''").groupBy("letter").count().collect()
    n = words.count()

    def told(k: int) -> float:
        return -sum(x * math.log(x) for x in (k / n, 1 - k / n) if x > 0)

    groups, weight = [[] for _ in range(GROUPS)], [0.0] * GROUPS
    for r in sorted(held, key=lambda r: (-told(r["count"]), r["letter"])):
        g = weight.index(min(weight))
        groups[g].append(ord(r["letter"]))
        weight[g] += told(r["count"])
    return groups


class Letters:
    """Letter counts of words, and which groups of letters two words share."""

    def __init__(self, groups: list[list[int]]):
        flat = [x for g in groups for x in g]
        self.n = max(1, len(flat))
        self.column = np.zeros(256, dtype=np.int64)
        self.column[flat] = np.arange(len(flat))
        self.edges = np.cumsum([0, *map(len, groups)])
        rng = np.random.default_rng(12)
        self.mix = rng.integers(1, 1 << 63, self.n, dtype=np.uint64) | np.uint64(1)
        self.salt = rng.integers(1, 1 << 63, (len(SUBSETS), 2), dtype=np.uint64) | np.uint64(1)

    def count(self, words: list[bytes], size: np.ndarray) -> np.ndarray:
        flat = self.column[np.frombuffer(b"".join(words), dtype=np.uint8)]
        row = np.repeat(np.arange(len(words)), size)
        return np.bincount(row * self.n + flat, minlength=len(words) * self.n).reshape(len(words), self.n)

    def keys(self, words: list[bytes]) -> list[np.ndarray]:
        """A number for the counts of each two groups; unequal counts may share one, which costs time only."""
        c = self.count(words, np.fromiter(map(len, words), dtype=np.int64, count=len(words))).astype(np.uint64) * self.mix
        sums = [c[:, a:b].sum(axis=1, dtype=np.uint64) for a, b in zip(self.edges, self.edges[1:])]
        return [((sums[a] + np.uint64(s)) * self.salt[s, 0] ^ (sums[b] * self.salt[s, 1])).view(np.int64) for s, (a, b) in enumerate(SUBSETS)]

    def first_shared(self, differ: np.ndarray) -> np.ndarray:
        """Of rows of unequal counts, the first two groups that have none."""
        same = [~differ[:, a:b].any(axis=1) for a, b in zip(self.edges, self.edges[1:])]
        out = np.full(len(differ), -1)
        for s in range(len(SUBSETS) - 1, -1, -1):
            out[np.logical_and.reduce([same[g] for g in SUBSETS[s]])] = s
        return out


def _padded(words: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(len(words), width)


def one_edit(words: list[bytes], size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether words i and j (equally long, or j one letter longer) are one edit apart."""
    out, by = np.zeros(len(i), dtype=bool), np.argsort(size[j], kind="stable")
    at = 0
    while at < len(by):
        step = max(1, min(len(by) - at, (1 << 20) // (int(size[j[by[at]]]) + 2)))
        some = by[at : at + step]
        some = some[size[j[some]] <= 2 * size[j[by[at]]] + 64]  # of about one length, so that padding stays small
        at += len(some)
        width = int(size[j[some[-1]]]) + 1
        x, y = _padded([words[k] for k in i[some]], width), _padded([words[k] for k in j[some]], width)
        differ = x != y
        start = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        moved = (x[:, :-1] != y[:, 1:]) & (np.arange(width - 1) >= start[:, None])
        out[some] = np.where(size[i[some]] == size[j[some]], differ.sum(axis=1) == 1, ~moved.any(axis=1))
    return out


def _product(x: np.ndarray, y: np.ndarray, kind) -> np.ndarray:
    x, y = x.astype(kind), y.astype(kind)
    return (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T)


def near(letters: Letters, words: list[bytes], cell: np.ndarray, subset: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of words one edit apart, each under the first two groups of letters that it shares.

    ``cell`` numbers the blocks; words of side 1 meet those of side 0 only, words of side 2 meet each other.
    """
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(size, kind="stable")
    bounds = np.append(np.flatnonzero(np.diff(size[order], prepend=-1)), len(order))
    kind = np.float32 if len(size) and size.max() < 1 << 11 else np.float64  # in which squares of counts are exact
    small = len(words) <= TILE
    for k, low in enumerate(bounds[:-1]):
        high = len(order) if small else bounds[k + 1]  # a small tile is one product over all lengths
        upto = high if small or k + 2 >= len(bounds) or size[order[high]] != size[order[low]] + 1 else bounds[k + 2]
        for a in range(low, high, TILE):
            x = order[a : min(a + TILE, high)]
            cx = letters.count([words[i] for i in x], size[x])
            for b in range(a, upto, 4 * TILE):
                y = order[b : min(b + 4 * TILE, upto)]
                cy = cx if len(x) == len(y) and a == b else letters.count([words[i] for i in y], size[y])
                d = _product(cx, cy, kind)
                p, q = np.nonzero((d == 1) | (d == 2))
                i, j = x[p], y[q]
                grown = size[j] - size[i]
                ok = (cell[i] == cell[j]) & np.where(side[i] == 2, True, side[i] != side[j]) & (p + a < q + b) & np.where(d[p, q] == 1, grown == 1, grown == 0)
                p, q, i, j = p[ok], q[ok], i[ok], j[ok]
                ok = letters.first_shared(cx[p] != cy[q]) == subset[i]
                i, j = i[ok], j[ok]
                ok = one_edit(words, size, i, j)
                if ok.any():
                    yield i[ok], j[ok]
        if small:
            break


LINK = pa.schema([("word", pa.string()), ("n", pa.int64()), ("other", pa.string()), ("other_n", pa.int64())])


def _keyed(counted: DataFrame, letters: Letters) -> DataFrame:
    schema = pa.schema([("key", pa.int64()), ("subset", pa.int32()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 1 << 20):
                words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
                for s, key in enumerate(letters.keys(words)):
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), s, dtype=np.int32)), batch.column("word"), batch.column("n")], schema=schema)

    return counted.select("word", "n").mapInArrow(run, "key long, subset int, word string, n long")


def _cells(keyed: DataFrame, most: int) -> DataFrame:
    """Adds the parts ``a``, ``b`` that meet and ``side``; blocks of up to ``most`` words have one part."""
    big = keyed.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > most)
    parts = F.coalesce(F.ceil(F.col("size") / most), F.lit(1)).cast("int")
    dealt = keyed.join(big, "key", "left").select("*", parts.alias("parts"), F.pmod(F.xxhash64("word"), parts).cast("int").alias("own"))
    met = dealt.select("key", "subset", "word", "n", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    side = F.when(F.col("own") == F.col("with"), 2).otherwise((F.col("own") > F.col("with")).cast("int"))
    return met.select("key", F.least("own", "with").alias("a"), F.greatest("own", "with").alias("b"), side.alias("side"), "subset", "word", "n")


def links(counted: DataFrame, letters: Letters, most: int = CELL) -> DataFrame:
    """``word``, ``n``, ``other``, ``other_n`` for every word and each of its near words."""

    def run(batches):
        held, total, last = [], 0, None

        def meet(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(rows)
            words, n = [w.encode("latin-1") for w in t.column("word").to_pylist()], t.column("n").to_numpy()
            ids = np.stack([t.column(c).to_numpy() for c in ("key", "a", "b")], axis=1)
            cell = np.cumsum(np.any(ids != np.concatenate([ids[:1], ids[:-1]]), axis=1))
            names = t.column("word").combine_chunks()
            for i, j in near(letters, words, cell, t.column("subset").to_numpy(), t.column("side").to_numpy()):
                for x, y in ((i, j), (j, i)):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(x)), pa.array(n[x]), names.take(pa.array(y)), pa.array(n[y])], schema=LINK)

        for batch in batches:  # sorted: whole blocks are held until a tile is full
            ids = np.stack([batch.column(c).to_numpy() for c in ("key", "a", "b")], axis=1)
            cut = np.flatnonzero(np.any(ids[1:] != ids[:-1], axis=1)) + 1
            if len(ids) and last is not None and (ids[0] != last).any():
                cut = np.insert(cut, 0, 0)
            at = 0
            for begin, end in zip(cut.tolist(), [*cut[1:].tolist(), batch.num_rows]):
                if total + begin - at + end - begin > TILE:
                    if begin > at:
                        held.append(batch.slice(at, begin - at))
                    if held:
                        yield from meet(held)
                    held, total, at = [], 0, begin
            held.append(batch.slice(at))
            total += batch.num_rows - at
            last = ids[-1] if len(ids) else last
        if held:
            yield from meet(held)

    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = _cells(_keyed(counted, letters), most).repartition(parts, "key", "a", "b").sortWithinPartitions("key", "a", "b")
    return cells.mapInArrow(run, "word string, n long, other string, other_n long")


def forms(counted: DataFrame, found: DataFrame, times: int = TIMES) -> DataFrame:
    """``word, n, form, n_near, form_n``: the commonest near word, where it is ``times`` as common."""
    best = F.min(F.struct((-F.col("other_n")).alias("least"), F.col("other").alias("other"))).alias("best")
    near_by = found.groupBy("word").agg(F.count("*").alias("n_near"), best)
    form_n = -F.col("best.least")
    is_form = form_n >= times * F.col("n")
    rows = counted.join(near_by, "word", "left")
    return rows.select("word", "n", F.when(is_form, F.col("best.other")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, form_n).alias("form_n"))


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = CELL) -> DataFrame:
    """``word, n, form, n_near, form_n, root`` of every distinct word.

    Roots come by doubling: each round puts the root of the root in its place.  A form is
    ``TIMES`` as common as its word, so a few rounds reach the end of every chain.
    """
    scratch = Scratch(docs.sparkSession, "variants")
    counted = scratch.write(counts(docs, id_col, text_col))
    letters = Letters(letter_groups(counted))
    rows = scratch.write(forms(counted, links(counted, letters, most)))
    roots = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    longest = math.log(max(TIMES, rows.agg(F.max("n")).first()[0] or 1), TIMES)
    for _ in range(math.ceil(math.log2(longest + 1))):
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("up"))
        roots = scratch.write(roots.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root")))
    return rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
