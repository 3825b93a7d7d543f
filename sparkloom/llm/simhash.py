"""SimHash near-duplicates, linked through one Gray-order hierarchical index.

All distinct fingerprints are put in Gray order, in which neighbours differ in few bits,
and cut into blocks of at most ``BLOCK``.  Distances don't depend on the order of bits, so
those that split the fingerprints evenly and independently of each other lead the order.  The index is a tree over that order.  A node
holds the mask of the bits that everything below it shares, and their pattern; these are
factored upwards, ``FAN`` children at a time inside a block and ``SPREAD`` above it.
Going down, the tree is held against itself: two groups differ at least in the bits that
both masks fix and the patterns contradict.  These differences add up from level to level
as the masks widen, and a pair of groups with more than two is dropped whole.

Above the blocks a level is a small table, made by bitwise aggregates, and going down it
is two equi-joins on the parent.  Pairs of blocks that stay are compared in one task each,
in bounded slices, and yield a forest: one link for each linked fingerprint.  A block keeps
as many partners as there are ways to change two of the leading bits that tell blocks apart:
the square of the logarithm of the blocks, while there are as many even, independent bits.

Defined cases: a text without words has fingerprint zero and is linked like any other;
fewer than three words hash as one sequence.  A null id is no candidate for a
component's id; a component of null ids alone has a null id.  Repeated rows each get
their row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch, map_rows, slices, texts
from sparkloom.llm.graph import components

SEED = 42
DISTANCE = 2
FAN = 4
#: Fingerprints in a block, 64 KB of them, and levels above them until one node is left.
BLOCK, HEIGHT = 1 << 13, 7
#: Bits of a node's number that tell it from others of its parent, above the blocks.
SPREAD = 6
ALL = ~np.uint64(0)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, step: int = 1 << 16) -> int:
    """The SimHash of one text, unsigned; shingles are hashed ``step`` at a time."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - 2)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, step):
        part = words[i : i + step + 2]
        shingles = map(b" ".join, zip(part, part[1:], part[2:])) if len(words) > 2 else [b" ".join(words)]
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``digest`` (MD5 of the text) and ``fp`` (the fingerprint as a signed long); one pass, no shuffle."""

    def run(batch: pa.RecordBatch) -> list:
        return [batch.column("doc_id"), batch.column("digest"), [_signed(fingerprint(t)) for t in batch.column("text").to_pylist()]]

    return map_rows(texts(docs, id_col, text_col).withColumn("digest", _digest(F.col("text"))), run, "doc_id long, digest binary, fp long")


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _bits(codes: np.ndarray) -> np.ndarray:
    """A row of 64 zeros and ones for each code, lowest bit first."""
    return np.unpackbits(codes.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _together(batches):
    """How many codes of a partition have each two bits (place 64 is one in every code): ``cell``, ``n``."""
    counts = np.zeros((65, 65), dtype=np.int64)
    for batch in batches:
        for part in slices(batch, 1 << 20):
            x = np.pad(_bits(part.column("fp").to_numpy()), ((0, 0), (0, 1)), constant_values=1).astype(np.float64)
            counts += (x.T @ x).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(65 * 65)), pa.array(counts.ravel())], names=["cell", "n"])


def bit_order(codes: DataFrame) -> tuple[int, list[int]]:
    """The number of codes, and their bits from the one that the order is to begin with.

    Next is always the bit whose variance, less what the bits before it explain, is largest
    (Cholesky's factors with pivots): bits that split the codes evenly and independently come
    first, constant and repeated ones last.  4,225 counts over all codes come to the driver.
    """
    counts = np.zeros(65 * 65)
    for r in codes.select("fp").mapInArrow(_together, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[r["cell"]] = r["n"]
    counts = counts.reshape(65, 65)
    n = int(counts[64, 64])
    share = counts[:64, :64] / max(1, n)
    left = share - np.outer(np.diag(share), np.diag(share))
    order: list[int] = []
    while len(order) < 64:
        b = max((b for b in range(63, -1, -1) if b not in order), key=lambda b: round(left[b, b], 9))
        order.append(b)
        if left[b, b] > 1e-9:
            left = left - np.outer(left[b], left[b]) / left[b, b]
    return n, order


def gray_rank(codes: np.ndarray, order: list[int]) -> np.ndarray:
    """Places of codes in Gray order, as signed longs: the running exclusive or of their bits in ``order``."""
    running = np.cumsum(_bits(codes)[:, order], axis=1, dtype=np.uint8) & 1
    return (np.ascontiguousarray(np.packbits(running, axis=1)).view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def levels(codes: np.ndarray, fan: int = FAN, height: int = HEIGHT) -> list[tuple[np.ndarray, np.ndarray]]:
    """(shared masks, patterns) of the nodes of each level, from the codes upwards."""
    out = [(np.full(len(codes), ALL), codes)]
    for _ in range(height):
        masks, patterns = out[-1]
        starts = np.arange(0, len(masks), fan)
        low, high = np.bitwise_and.reduceat(patterns, starts), np.bitwise_or.reduceat(patterns, starts)
        shared = np.bitwise_and.reduceat(masks, starts) & ~(low ^ high)
        out.append((shared, low & shared))
    return out


def near(a: list, b: list, same: bool, fan: int = FAN, step: int = 1 << 14) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Level by level, pairs of nodes that may hold codes within ``DISTANCE``: (level, place in a, place in b).

    Level 0 gives the pairs of codes themselves.  At most ``step`` pairs are opened at once,
    deepest first, and the rest wait unopened, which bounds the memory.  In one block
    (``same``) a pair comes once.
    """
    work = [(len(a), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    while work:
        level, i, j = work.pop()
        work += [(level, i[at : at + step], j[at : at + step]) for at in range(step, len(i), step)]
        x = np.repeat(i[:step, None] * fan + np.arange(fan), fan, axis=1).ravel()
        y = np.tile(j[:step, None] * fan + np.arange(fan), fan).ravel()
        level -= 1
        (ma, pa_), (mb, pb) = a[level], b[level]
        real = (x < len(ma)) & (y < len(mb))
        if same:
            real &= (x < y) if level == 0 else (x <= y)
        x, y = x[real], y[real]
        keep = np.bitwise_count((pa_[x] ^ pb[y]) & ma[x] & mb[y]) <= DISTANCE
        x, y = x[keep], y[keep]
        if len(x):
            yield level, x, y
            if level:
                work.append((level, x, y))


def forest(a: np.ndarray, b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (code, root) that join exactly the codes of two blocks (or one) reachable by steps of ``DISTANCE`` between them."""
    codes = a if b is None else np.concatenate([a, b])
    root, shift = np.arange(len(codes)), 0 if b is None else len(a)
    of_a = levels(a)
    for level, x, y in near(of_a, of_a if b is None else levels(b), b is None):
        y = y + shift
        while not level and len(x):
            rx, ry = root[x], root[y]
            open_ = rx != ry
            if not open_.any():
                break
            x, y, rx, ry = x[open_], y[open_], rx[open_], ry[open_]
            np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
            while (root != (up := root[root])).any():
                root = up
    linked = root != np.arange(len(codes))
    return codes[linked], codes[root[linked]]


BLOCKS = "part long, place long, mask long, pattern long, codes binary"


def _cut(size: int):
    """A sorted partition in blocks of ``size`` codes, each with what they share."""

    def run(batches):
        part, held, place = TaskContext.get().partitionId(), np.zeros(0, dtype=np.int64), 0

        def block(codes: np.ndarray, place: int) -> pa.RecordBatch:
            low, high = np.bitwise_and.reduce(codes), np.bitwise_or.reduce(codes)
            row = [[part], [place], [~(low ^ high)], [low & ~(low ^ high)], [codes.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, [pa.int64()] * 4 + [pa.binary()])], names=["part", "place", "mask", "pattern", "codes"])

        for batch in batches:
            held = np.concatenate([held, batch.column("fp").to_numpy()])
            while len(held) >= size:
                yield block(held[:size], place)
                held, place = held[size:], place + 1
        if len(held):
            yield block(held, place)

    return run


def blocks(codes: DataFrame, size: int = BLOCK) -> DataFrame:
    """The distinct fingerprints of ``codes`` in Gray order, ``size`` in a row, with the mask and pattern they share."""
    n, order = bit_order(codes)
    ranked = map_rows(codes.select("fp"), lambda batch: [batch.column("fp"), gray_rank(batch.column("fp").to_numpy(), order)], "fp long, gray long", 1 << 20)
    ordered = ranked.repartitionByRange(-(-max(1, n) // (16 * size)), "gray").sortWithinPartitions("gray")
    return ordered.select("fp").mapInArrow(_cut(size), BLOCKS)


def block_pairs(cut: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of block numbers that may hold near fingerprints, by going down the tree above the blocks."""
    most = cut.agg(F.max("part"), F.max("place")).first()  # two numbers
    width = int(most[1] or 0).bit_length()
    tree = [numbered(cut, width).select("node", "mask", "pattern")]
    for _ in range(-(-((int(most[0] or 0) << width) + int(most[1] or 0)).bit_length() // SPREAD)):
        up = tree[-1].groupBy(F.shiftright("node", SPREAD).alias("node")).agg(F.bit_and("mask").alias("m"), F.bit_and("pattern").alias("low"), F.bit_or("pattern").alias("high"))
        shared = F.col("m").bitwiseAND(F.bitwise_not(F.col("low").bitwiseXOR(F.col("high"))))
        tree.append(up.select("node", shared.alias("mask"), F.col("low").bitwiseAND(shared).alias("pattern")))
    pairs = tree[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for nodes in reversed(tree[:-1]):
        x, y = (nodes.select(F.shiftright("node", SPREAD).alias(c), F.col("node").alias(f"{c}_node"), F.col("mask").alias(f"{c}_mask"), F.col("pattern").alias(f"{c}_pattern")) for c in "ab")
        differ = F.bit_count(F.col("a_pattern").bitwiseXOR(F.col("b_pattern")).bitwiseAND(F.col("a_mask")).bitwiseAND(F.col("b_mask")))
        pairs = pairs.join(x, "a").join(y, "b").where((F.col("a_node") <= F.col("b_node")) & (differ <= DISTANCE)).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return pairs


def numbered(cut: DataFrame, width: int) -> DataFrame:
    """Blocks with ``node``, a number in Gray order."""
    return cut.withColumn("node", F.shiftleft("part", width).bitwiseOR(F.col("place")))


def _links(batches):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    for batch in batches:
        for part in slices(batch, 1 << 22):
            for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist()):
                u, v = forest(np.frombuffer(x, dtype="<u8"), None if y is None else np.frombuffer(y, dtype="<u8"))
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], schema=schema)


def links(codes: DataFrame, scratch: Scratch, size: int = BLOCK) -> DataFrame:
    """Links ``u``, ``v`` between distinct fingerprints that connect what is within reach."""
    spark = codes.sparkSession
    cut = scratch.write(blocks(codes, size))
    width = int(cut.agg(F.max("place")).first()[0] or 0).bit_length()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = scratch.write(block_pairs(cut).repartition(parts, "a", "b"))  # a few bytes each, dealt out for what follows
    held = numbered(cut, width)
    x, y = held.select(F.col("node").alias("a"), F.col("codes").alias("x")), held.select(F.col("node").alias("b"), F.col("codes").alias("y"))
    met = pairs.join(x, "a").join(y, "b").select("x", F.when(F.col("a") != F.col("b"), F.col("y")).alias("y"))
    return met.mapInArrow(_links, "u long, v long")


def _rooted(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The fingerprint of every row, and the ``root`` fingerprint of the component of every distinct one.

    Texts are read once; from there on rows are a few bytes.  Only linked fingerprints
    take part in the component rounds.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.write(fingerprints(docs, id_col, text_col))
    codes = scratch.write(prints.select("fp").distinct())
    roots = components(links(codes, scratch), scratch)
    return prints, codes.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest id reachable, for every row."""
    prints, rooted = _rooted(docs, id_col, text_col)
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first")).join(rooted, "fp")
    least = first.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(first.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: that with the smallest id (none counts as the largest), then the least MD5 of its text.

    Rows are judged by their own text, so an id that stands on unrelated texts stays once for
    each.  Of rows that share id and text the one with the least hash of all columns stays.
    """
    prints, rooted = _rooted(docs, id_col, text_col)

    def key() -> list[Column]:  # without nulls, so that grouping and join share one shuffle
        return [F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.coalesce("digest", F.lit(b"")).alias("digest")]

    first = prints.groupBy("fp").agg(F.min(F.struct(*key())).alias("first")).join(rooted, "fp")
    kept = first.groupBy("root").agg(F.min("first").alias("k")).select("k.*")
    hashed = [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), _digest(docs[text_col].cast("string")).alias("digest"), F.xxhash64(*hashed).alias("hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    once = rows.select(*key(), "hash", "row").groupBy("none", "id", "digest").agg(F.min_by("row", "hash").alias("row"))  # combined before the shuffle
    return once.join(kept, ["none", "id", "digest"], "left_semi").select("row.*")
