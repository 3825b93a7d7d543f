"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search.

The index is a graph of each vector's ``k`` nearest others.  It starts from leaves of
random-hyperplane trees and improves by rounds of NN-descent: every node introduces a
sample of its neighbours and of those it is a neighbour of to each other, which are
Spark joins of neighbours of neighbours, and nodes keep the best they have met.
Nodes that the trees leave with fewer than ``k`` neighbours (alone or with few others in
their leaves) first meet a random part of all nodes, and each other.
A query walks the graph: each hop expands its best unexpanded candidates by a join with
the adjacency, until the best ``beam`` are all expanded (a warning tells if ``hops`` ended
it before).  The distances met on the way
are of vectors rounded to bytes; the candidates left are measured again exactly, in
double precision on the original vectors.  A query that still has fewer rows than there
are to have is answered by a scan of all vectors.

Every list is bounded by construction: ``k`` neighbours, samples of ``sample``, leaves
of about ``leaf`` vectors (fuller ones are split by a hash), ``beam`` candidates.  The
adjacency and the codes are checkpointed as dealt out by node, so no hop shuffles them.

Defined cases: a vector that is null, all zero, or has a null or non-finite component
takes no part, nor does a null id.  Vectors of another length than most have no inner
product with these: they are left out too, with a warning.  An id that stands on several
vectors has the one that comes first, component by component.  Equal vectors are one node;
its ids come in order.  Ties go to the smaller id.  Repeated rows count once.
"""

from __future__ import annotations

import math
import uuid
import warnings
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch, map_rows, slices

PAIRS = "v long, u long, s float"


def product(a: Column, b: Column) -> Column:
    """The inner product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def valid(rows: DataFrame) -> DataFrame:
    """The rows that take part; the common length and the count of others are two numbers for the driver."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = rows.where(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0)).where(finite & F.exists(e, lambda x: x != 0))
    sizes = good.groupBy(F.size(e).alias("d")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), "d").first()
    if not most:
        return good
    if odd := sizes.where(F.col("d") != most["d"]).agg(F.sum("n")).first()[0]:
        warnings.warn(f"{odd} vectors do not have {most['d']} components and take no part", stacklevel=2)
    return good.where(F.size(e) == most["d"])


def _unpack(col: pa.Array, scale: pa.Array) -> np.ndarray:
    """Vectors from their byte codes, which all have one length."""
    raw = np.frombuffer(b"".join(col.to_pylist()), dtype=np.int8)
    return raw.reshape(len(col), -1).astype(np.float32) * scale.to_numpy(zero_copy_only=False)[:, None]


def _codes(batch: pa.RecordBatch) -> list:
    x = np.array(batch.column("embedding").to_pylist(), dtype=np.float64)
    top = np.abs(x).max(axis=1)
    return [batch.column("node"), [r.tobytes() for r in np.rint(x / top[:, None] * 127).astype(np.int8)], top / 127]


def _groups(batches, keys: list[str]):
    """Record batches of whole groups, from a partition sorted by ``keys``."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*([held] if held is not None else []), batch]).combine_chunks()
        rows = np.column_stack([table.column(k).to_numpy() for k in keys])
        other = np.flatnonzero((rows != rows[-1]).any(axis=1))
        cut = other[-1] + 1 if len(other) else 0
        whole = table.slice(0, cut)
        if cut:
            edges = np.flatnonzero((rows[1:cut] != rows[: cut - 1]).any(axis=1)) + 1
            yield whole.combine_chunks().to_batches()[0], np.concatenate([[0], edges, [cut]])
        held = table.slice(cut).combine_chunks().to_batches()[0]
    if held is not None:
        rows = np.column_stack([held.column(k).to_numpy() for k in keys])
        yield held, np.array([0, *(np.flatnonzero((rows[1:] != rows[:-1]).any(axis=1)) + 1), held.num_rows])


def _pairs(found: list[tuple]) -> pa.RecordBatch:
    v, u, s = (np.concatenate(x) if len(x) else np.zeros(0) for x in (zip(*found) if found else ([], [], [])))
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(u, pa.int64()), pa.array(s, pa.float32())], names=["v", "u", "s"])


def _leaf_neighbours(most: int):
    def run(batches):
        for batch, cuts in _groups(batches, ["tree", "leaf", "part"]):
            ids, x, found = batch.column("node").to_numpy(), _unpack(batch.column("code"), batch.column("scale")), []
            for a, b in zip(cuts, cuts[1:]):
                for i in range(a, b, 1024):
                    s = x[i : min(i + 1024, b)] @ x[a:b].T
                    s[np.arange(len(s)), np.arange(i - a, i - a + len(s))] = -np.inf
                    n = min(most, b - a - 1)
                    if n:
                        best = np.argpartition(-s, n - 1, axis=1)[:, :n]
                        found.append((np.repeat(ids[i : i + len(s)], n), ids[a:b][best].ravel(), np.take_along_axis(s, best, 1).ravel()))
            yield _pairs(found)

    return run


def _meet(most: int):
    """The best of a part for each of its poor nodes, and the poor nodes for those."""

    def run(batches):
        for batch, cuts in _groups(batches, ["crowd", "part"]):
            ids, x, found = batch.column("node").to_numpy(), _unpack(batch.column("code"), batch.column("scale")), []
            poor = np.flatnonzero(batch.column("poor").to_numpy(zero_copy_only=False))
            for a, b in zip(cuts, cuts[1:]):
                mine, n = poor[np.searchsorted(poor, a) : np.searchsorted(poor, b)], min(most, b - a - 1)
                for i in range(0, len(mine) if n else 0, 1024):
                    rows = mine[i : i + 1024]
                    s = x[rows] @ x[a:b].T
                    s[np.arange(len(rows)), rows - a] = -np.inf
                    best = np.argpartition(-s, n - 1, axis=1)[:, :n]
                    v, u, score = np.repeat(ids[rows], n), ids[a:b][best].ravel(), np.take_along_axis(s, best, 1).ravel()
                    found += [(v, u, score), (u, v, score)]
            yield _pairs(found)

    return run


def _exact(queries: list[tuple[int, list[float]]], most: int):
    """The ``most`` best nodes of a partition for each query, summed in the order of ``product``; ties go to the smaller id."""
    q, wanted = np.array([r[0] for r in queries], dtype=np.int64), np.array([r[1] for r in queries], dtype=np.float64)

    def run(batches):
        ids, top = np.zeros((len(q), 0), dtype=np.int64), np.zeros((len(q), 0))
        for batch in batches:
            for part in slices(batch, 1 << 20):
                x = np.array(part.column("embedding").to_pylist(), dtype=np.float64)
                s = np.zeros((len(q), len(x)))
                for d in range(x.shape[1]):
                    s += wanted[:, d, None] * x[None, :, d]
                ids = np.hstack([ids, np.broadcast_to(part.column("node").to_numpy(), s.shape)])
                top = np.hstack([top, s])
                keep = np.lexsort((ids, -top), axis=1)[:, :most]
                ids, top = np.take_along_axis(ids, keep, 1), np.take_along_axis(top, keep, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, ids.shape[1])), pa.array(ids.ravel())], names=["q", "u"])

    return run


def _introduce(batches):
    """For each node, the pairs of its neighbours (one of them new) that improve on a member's worst."""
    for batch, cuts in _groups(batches, ["v"]):
        ids, new, worst = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "fresh", "worst"))
        x, found = _unpack(batch.column("code"), batch.column("scale")), []
        for a, b in zip(cuts, cuts[1:]):
            s = x[a:b] @ x[a:b].T
            good = (new[a:b, None] | new[None, a:b]) & (s > worst[a:b, None])
            np.fill_diagonal(good, False)
            i, j = np.nonzero(good)
            found.append((ids[a:b][i], ids[a:b][j], s[i, j]))
        yield _pairs(found)


def _expand(batches):
    """Neighbours of an expanded node that beat the query's floor."""
    for batch in batches:
        found = []
        query, floor = batch.column("q").to_numpy(), batch.column("floor").to_numpy()
        mine = _unpack(batch.column("qcode"), batch.column("qscale"))
        lists = batch.column("near")
        ends, flat = lists.offsets.to_numpy(), lists.values
        ids, x = flat.field("u").to_numpy(), _unpack(flat.field("code"), flat.field("scale"))
        for i in range(len(query)):
            a, b = ends[i], ends[i + 1]
            s = x[a:b] @ mine[i]
            good = (s > floor[i]) & (ids[a:b] != query[i])
            found.append((np.full(good.sum(), query[i]), ids[a:b][good], s[good]))
        yield _pairs(found)


def best(rows: DataFrame, by: str, n: int, score: str = "s", tie: str = "u") -> DataFrame:
    """The ``n`` rows of each ``by`` with the largest score."""
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def _in_session(df: DataFrame, spark: SparkSession) -> DataFrame:
    """The same rows as a DataFrame of another session of this application, by a global view that goes at once."""
    name = f"ann_{uuid.uuid4().hex}"
    df.createGlobalTempView(name)
    try:
        return spark.table(f"global_temp.{name}")
    finally:
        spark.catalog.dropGlobalTempView(name)


class Index:
    """The graph over the distinct vectors of ``rows`` (``vec_id``, ``embedding``)."""

    def __init__(self, rows: DataFrame, k: int = 30, sample: int = 10, rounds: int = 6, trees: int = 4, leaf: int = 1000, seed: int = 5):
        self.spark, self.k = rows.sparkSession, k
        self.scratch = Scratch(self.spark, "ann")  # also makes sure that there is a folder for checkpoints
        rows = valid(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        self.nodes = self.scratch.write(rows.groupBy("embedding").agg(F.min("vec_id").alias("node")).select("node", "embedding"))
        self.members = self.scratch.write(rows.join(self.nodes, "embedding").select("node", "vec_id"))
        coded = map_rows(self.nodes, _codes, "node long, code binary, scale float")
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.codes = self._dealt(coded, "node")
        self.size = self.codes.count()
        graph = self._fill(self._start(trees, leaf, seed), leaf, seed)
        for i in range(rounds):
            graph, moved = self._descend(graph, sample, i)
            if moved <= 0.001 * k * max(1, self.size):
                break
        self.graph = graph
        self.adjacency = self._adjacency()

    def _dealt(self, df: DataFrame, key: str) -> DataFrame:
        """Checkpointed in the folder all executors share, as dealt out and sorted by ``key``.

        Adaptive plans don't tell their partitioning, so the checkpoint is made in a session of
        its own that has none: joins on ``key`` then move only their other side, and the
        caller's session keeps its settings.
        """
        plain = self.spark.newSession()
        for name, value in self.spark.conf.getAll.items():
            if self.spark.conf.isModifiable(name):
                plain.conf.set(name, value)
        plain.conf.set("spark.sql.adaptive.enabled", "false")
        held = _in_session(df, plain).repartition(self.parts, key).sortWithinPartitions(key).checkpoint()
        return _in_session(held, self.spark)

    def _forget(self, *tables: DataFrame) -> None:
        """Old rounds' files go; Spark drops their shuffle files itself."""
        for t in tables:
            self.scratch.drop(t)

    def _start(self, trees: int, leaf: int, seed: int) -> DataFrame:
        bits = max(0, int(math.log2(max(1, self.size / leaf))))

        def side(batch: pa.RecordBatch) -> list:
            x = _unpack(batch.column("code"), batch.column("scale"))
            planes = np.random.default_rng(seed).normal(size=(trees, x.shape[1] if len(x) else 1, bits))
            put = np.stack([(x @ p > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(x), dtype=np.int64) for p in planes])
            again = np.tile(np.arange(len(x)), trees)
            return [np.repeat(np.arange(trees), len(x)), put.ravel(), *(batch.column(c).take(pa.array(again)) for c in ("node", "code", "scale"))]

        put = map_rows(self.codes, side, "tree int, leaf long, node long, code binary, scale float")
        full = self.scratch.write(map_rows(self.codes, side, "tree int, leaf long, node long, code binary, scale float").groupBy("tree", "leaf").agg(F.ceil(F.count("*") / (2 * leaf)).alias("parts")))
        cut = put.join(full, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.col("parts")))
        near = cut.select("tree", "leaf", "part", "node", "code", "scale").repartition("tree", "leaf", "part").sortWithinPartitions("tree", "leaf", "part").mapInArrow(_leaf_neighbours(max(8, self.k // 2)), PAIRS)
        return self.scratch.write(best(near.groupBy("v", "u").agg(F.max("s").alias("s")), "v", self.k).withColumn("fresh", F.lit(True)))

    def _fill(self, graph: DataFrame, leaf: int, seed: int) -> DataFrame:
        """The graph with at least ``k`` neighbours for every node, or all others where there are fewer."""
        n = self.size
        have = graph.groupBy("v").agg(F.count("*").alias("have"))
        short = self.codes.join(have, self.codes["node"] == have["v"], "left").where(F.coalesce("have", F.lit(0)) < min(self.k, n - 1))
        poor = self.scratch.write(short.select("node", F.lit(True).alias("poor")))
        m = poor.count()
        if not m:
            return graph
        size = max(leaf, 4 * self.k)  # far more than ``k`` in each part
        marked = self.codes.join(poor, "node", "left").withColumn("poor", F.coalesce("poor", F.lit(False)))
        put = [
            rows.withColumn("crowd", F.lit(i)).withColumn("part", F.pmod(F.xxhash64("node", F.lit(seed + i)), F.lit(max(1, of // size))))
            for i, (rows, of) in enumerate([(marked, n), (marked.where("poor"), m)])
        ]
        dealt = put[0].union(put[1]).select("crowd", "part", "node", "poor", "code", "scale").repartition("crowd", "part").sortWithinPartitions("crowd", "part")
        met = dealt.mapInArrow(_meet(self.k), PAIRS).withColumn("fresh", F.lit(True))
        new = self.scratch.write(best(graph.union(met).groupBy("v", "u").agg(F.max("s").alias("s"), F.max("fresh").alias("fresh")), "v", self.k))
        self._forget(graph, poor)
        return new

    def _descend(self, graph: DataFrame, sample: int, turn: int) -> tuple[DataFrame, int]:
        """One round: the new graph, and how many of its edges are new."""

        def some(edges: DataFrame) -> DataFrame:
            w = Window.partitionBy("v", "fresh").orderBy(F.xxhash64("v", "u", F.lit(turn)), "u")
            return edges.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= sample).drop("__r")

        picked = self.scratch.write(some(graph.select("v", "u", "fresh")))
        back = some(picked.select(F.col("u").alias("v"), F.col("v").alias("u"), "fresh"))
        met = picked.union(back).groupBy("v", "u").agg(F.max("fresh").alias("fresh"))
        worst = graph.groupBy("v").agg(F.when(F.count("*") >= self.k, F.min("s")).otherwise(F.lit(float("-inf"))).cast("float").alias("worst"))
        known = self.codes.withColumnRenamed("node", "u").join(worst.withColumnRenamed("v", "u"), "u")
        seen = met.join(known, "u").select("v", "u", "fresh", "worst", "code", "scale")
        pairs = seen.repartition("v").sortWithinPartitions("v").mapInArrow(_introduce, PAIRS)
        # What was introduced is no longer new; what was known before stays old.
        told = picked.where("fresh").select("v", "u", F.lit(float("-inf")).cast("float").alias("s"), F.lit(False).alias("fresh"))
        all_ = graph.union(told).union(pairs.withColumn("fresh", F.lit(True))).groupBy("v", "u").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
        new = self.scratch.write(best(all_, "v", self.k))
        moved = new.where("fresh").count()
        self._forget(graph, picked)
        return new, moved

    def _adjacency(self) -> DataFrame:
        """Neighbours both ways, with their codes, as one list for each node."""
        ahead = self.graph.select("v", "u", "s")
        behind = best(ahead.select(F.col("u").alias("v"), F.col("v").alias("u"), "s"), "v", self.k)
        both = ahead.union(behind).select("v", "u").distinct()
        held = both.join(self.codes.withColumnRenamed("node", "u"), "u")
        lists = held.groupBy("v").agg(F.collect_list(F.struct("u", "code", "scale")).alias("near"))  # at most 2 k
        return self._dealt(lists, "v")

    def search(self, queries: DataFrame, n: int = 20, beam: int = 320, width: int = 64, hops: int = 60) -> DataFrame:
        """``query_id, rank, vec_id, score`` for the ids of ``queries`` (column ``query_id``), all of them indexed."""
        asked = self.scratch.write(queries.join(self.members, queries["query_id"] == self.members["vec_id"]).select("query_id", "node").distinct())
        who = asked.select(F.col("node").alias("q")).distinct()
        coded = self._dealt(who.join(self.codes, who["q"] == self.codes["node"]).select("q", F.col("code").alias("qcode"), F.col("scale").alias("qscale")), "q")
        near = self.graph.join(who, self.graph["v"] == who["q"], "left_semi").select(F.col("v").alias("q"), "u", "s", F.lit(False).alias("done"))
        state = self.scratch.write(self._planned(near, beam, width))
        for _ in range(hops):
            front = state.where("go").select("q", "u", "floor")
            if not front.head(1):
                break
            near = front.join(coded, "q").join(self.adjacency, F.col("u") == self.adjacency["v"]).select("q", "floor", "qcode", "qscale", "near")
            met = near.mapInArrow(_expand, PAIRS).select(F.col("v").alias("q"), "u", "s", F.lit(False).alias("done"))
            known = state.select("q", "u", "s", (F.col("done") | F.col("go")).alias("done"))
            merged = known.union(met).groupBy("q", "u").agg(F.max("s").alias("s"), F.max("done").alias("done"))
            new = self.scratch.write(self._planned(merged, beam, width))
            self._forget(state)
            state = new
        else:
            open_ = state.where("NOT done").select("q").distinct().count()
            if open_:
                warnings.warn(f"{open_} searches ended after {hops} hops with candidates left", stacklevel=2)
        return self._completed(asked, state, n)

    def _planned(self, rows: DataFrame, beam: int, width: int) -> DataFrame:
        """The best ``beam`` candidates of each query: which are expanded next (``go``) and what their neighbours have to beat (``floor``).

        All of it comes from one sort by query, in the pass that merges a hop.
        """
        each = Window.partitionBy("q")
        waiting = F.sum((~F.col("done")).cast("int")).over(each.orderBy(F.desc("s"), "u").rowsBetween(Window.unboundedPreceding, 0))
        floor = F.when(F.count("*").over(each) >= beam, F.min("s").over(each)).otherwise(F.lit(float("-inf"))).cast("float")
        return best(rows, "q", beam).withColumns({"go": ~F.col("done") & (waiting <= width), "floor": floor})

    def _completed(self, asked: DataFrame, state: DataFrame, n: int, block: int = 256) -> DataFrame:
        """The rows found; queries with fewer than there are to have are answered by a scan, a block of them at a time."""
        found = self.scratch.write(self._measured(asked, state.select("q", "u"), n))
        got = found.groupBy("query_id").agg(F.count("*").alias("got"))
        due = min(n, self.members.count() - 1)
        short = self.scratch.write(asked.join(got, "query_id", "left").where(F.coalesce("got", F.lit(0)) < due).select("query_id", "node"))
        if not short.head(1):
            return found
        wanted = self.nodes.join(short.select("node").distinct(), "node", "left_semi").select("node", "embedding").toLocalIterator()
        scanned = []
        while some := [tuple(r) for r in islice(wanted, block)]:
            scanned.append(self.scratch.write(self.nodes.mapInArrow(_exact(some, n + 1), "q long, u long")))
        return found.join(short, "query_id", "left_anti").union(self._measured(short, reduce(DataFrame.union, scanned), n))

    def _measured(self, asked: DataFrame, state: DataFrame, n: int) -> DataFrame:
        """Exact scores of the candidates ``q``, ``u``, one row for each id of a node, and the query's own copies.

        The best ids are picked for a node before its queries, of which it may have many, join.
        """
        left = self.nodes.select(F.col("node").alias("q"), F.col("embedding").alias("a"))
        right = self.nodes.select(F.col("node").alias("u"), F.col("embedding").alias("b"))
        pairs = state.union(asked.select(F.col("node").alias("q"), F.col("node").alias("u"))).distinct()
        scored = self.scratch.write(pairs.join(left, "q").join(right, "u").select("q", "u", product(F.col("a"), F.col("b")).alias("score")))
        few = best(scored, "q", n + 1, "score")  # a node's other ids only push nodes out
        ids = best(self.members.withColumn("s", F.lit(0)), "node", n + 1, "s", "vec_id").select(F.col("node").alias("u"), "vec_id")
        top = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        each = few.join(ids, "u").withColumn("__r", F.row_number().over(top)).where(F.col("__r") <= n + 1).drop("__r", "u")
        rows = each.join(asked.withColumnRenamed("node", "q"), "q").where("vec_id <> query_id")
        ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
        return ranked.where(F.col("rank") <= n).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
