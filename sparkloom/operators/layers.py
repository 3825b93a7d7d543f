"""Layers, training steps and geometry as expressions and single aggregates."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import vector as V
from sparkloom.functions.activation import sigmoid, softmax
from sparkloom.functions.ieee import dbl
from sparkloom.functions.random import keyed_uniform
from sparkloom.operators.features import fit_standard
from sparkloom.operators.linalg import linear
from sparkloom.operators.ordering import gathered_bits


def batch_norm(df: DataFrame, columns: list[str], gain: float = 1.0, shift: float = 0.0, eps: float = 1e-5) -> DataFrame:
    """Columns brought to mean ``shift`` and deviation ``gain``, by one aggregate and one projection."""
    stats = fit_standard(df, columns, 0.0)
    return df.withColumns({c: gain * (dbl(F.col(c)) - m) / math.sqrt(s * s + eps) + shift for c, (m, s) in stats.items()})


def layer_norm(xs: Column, eps: float = 1e-5) -> Column:
    stats = F.struct(V.mean(xs).alias("m"), F.sqrt(V.variance(xs) + eps).alias("s"))
    return V.let(stats, lambda t: F.transform(xs, lambda x: (dbl(x) - t["m"]) / t["s"]))


def dropout(x: Column, key: Column, rate: float, seed: int = 0) -> Column:
    """Zero for a share of the keys, the rest scaled up; the same keys in every rerun."""
    return F.when(keyed_uniform(key, seed) < rate, 0.0).otherwise(dbl(x) / (1 - rate))


def positional_encoding(position: Column, width: int) -> Column:
    """Sines and cosines of falling frequency, in turn."""
    parts = []
    for i in range(width):
        angle = position / math.pow(10000, 2 * (i // 2) / width)
        parts.append(F.sin(angle) if i % 2 == 0 else F.cos(angle))
    return F.array(*parts)


def causal_attention(df: DataFrame, key: list[str], order: list[str], query: str, value: str, span: int = 8) -> DataFrame:
    """Each row's weighted mean of ``value`` over itself and ``span - 1`` rows before, by likeness of one number, ``query``.

    A kernel over the past; for scores from products and predictions see :func:`prediction_attention`.
    """
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-(span - 1), 0)
    past = F.collect_list(F.struct(F.col(query).alias("q"), F.col(value).alias("v"))).over(w)
    rows = df.withColumn("__past", past)
    score = F.transform("__past", lambda p: F.struct(F.exp(-F.abs(dbl(p["q"]) - dbl(F.col(query)))).alias("e"), p["v"].alias("v")))
    rows = rows.withColumn("__s", score)
    top = F.aggregate("__s", F.lit(0.0), lambda a, s: a + s["e"] * dbl(s["v"]))
    return rows.withColumn("attended", top / F.aggregate("__s", F.lit(0.0), lambda a, s: a + s["e"])).drop("__past", "__s")


def prediction_attention(df: DataFrame, key: list[str], order: list[str], query: str, item: str, value: str, predicted: str, span: int = 8) -> DataFrame:
    """Attention over itself and ``span - 1`` rows before, in which well predicted rows count more.

    Scores are products of ``query`` and ``item``, times the softmax over the rows of the
    negative error between ``predicted`` and ``value``; ``attended`` is the mean of ``value``
    by the softmax of the scores.
    """
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-(span - 1), 0)
    past = F.collect_list(F.struct(dbl(F.col(item)).alias("k"), dbl(F.col(value)).alias("v"), (-F.abs(dbl(F.col(predicted)) - dbl(F.col(value)))).alias("e"))).over(w)
    rows = df.withColumn("__past", past).withColumn("__q", dbl(F.col(query)))
    sure = softmax(F.transform("__past", lambda p: p["e"]))
    score = softmax(F.zip_with("__past", sure, lambda p, s: F.col("__q") * p["k"] * s))
    parts = F.zip_with("__past", score, lambda p, s: p["v"] * s)
    return rows.withColumn("attended", F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)).drop("__past", "__q")


def attention_state(temporal: Column, causal: Column, novelty: Column) -> Column:
    """The weight of a row from its recency, the success of predictions from it, and its novelty: their mean."""
    return (dbl(temporal) + dbl(causal) + dbl(novelty)) / 3


def hebbian(df: DataFrame, xs: list[str], ys: list[str], rate: float = 0.01) -> DataFrame:
    """The Hebbian weight change, rate times the mean product, as rows ``x, y, w``."""
    cells = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), (rate * F.avg(dbl(F.col(a)) * dbl(F.col(b)))).alias("w")) for a in xs for b in ys]
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


@dataclass
class Optimizer:
    """Gradient steps on a small parameter vector: sgd (momentum, also Nesterov's) or adam (also amsgrad).

    ``decay`` adds that share of the parameters to the gradient.  Amsgrad divides by the largest
    second moment so far.
    """

    kind: str = "adam"
    rate: float = 0.1
    momentum: float = 0.0
    betas: tuple[float, float] = (0.9, 0.999)
    nesterov: bool = False
    amsgrad: bool = False
    decay: float = 0.0
    state: dict = field(default_factory=dict)

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        s, g = self.state, g + self.decay * w
        if self.kind == "sgd":
            s["v"] = self.momentum * s.get("v", np.zeros_like(w)) - self.rate * g
            return w + (self.momentum * s["v"] - self.rate * g if self.nesterov else s["v"])
        s["t"] = s.get("t", 0) + 1
        s["m"] = self.betas[0] * s.get("m", np.zeros_like(w)) + (1 - self.betas[0]) * g
        s["v"] = self.betas[1] * s.get("v", np.zeros_like(w)) + (1 - self.betas[1]) * g * g
        s["top"] = np.maximum(s.get("top", s["v"]), s["v"]) if self.amsgrad else s["v"]
        return w - self.rate * (s["m"] / (1 - self.betas[0] ** s["t"])) / (np.sqrt(s["top"] / (1 - self.betas[1] ** s["t"])) + 1e-8)


def train_logistic(df: DataFrame, xs: list[str], y: str, optimizer: Optimizer, epochs: int = 10) -> np.ndarray:
    """Slopes and intercept by full-batch steps: the gradient of an epoch is one aggregate."""
    w = np.zeros(len(xs) + 1)
    for _ in range(epochs):
        e = sigmoid(linear(xs, w[:-1], w[-1])) - dbl(F.col(y))
        w = optimizer.step(w, np.array([v or 0.0 for v in df.agg(*[F.avg(e * dbl(F.col(c))) for c in xs], F.avg(e)).first()]))
    return w


# The unit sphere


def to_sphere(v: Column) -> Column:
    return V.normalize(v)


def log_map(p: Column, q: Column) -> Column:
    """The tangent vector at ``p`` that leads to ``q``."""

    def tangent(t: Column) -> Column:
        off = F.zip_with(t["p"], t["q"], lambda a, b: dbl(b) - t["c"] * dbl(a))
        return V.let(off, lambda o: V.let(V.norm(o), lambda n: F.transform(o, lambda x: F.when(n > 1e-12, F.acos(t["c"]) * x / F.greatest(n, F.lit(1e-12))).otherwise(0.0))))

    both = V.let(F.struct(p.alias("p"), q.alias("q")), lambda t: F.struct(t["p"].alias("p"), t["q"].alias("q"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), V.dot(t["p"], t["q"]))).alias("c")))
    return V.let(both, tangent)


def exp_map(p: Column, v: Column) -> Column:
    """The point reached from ``p`` along the tangent vector ``v``."""
    return V.let(V.norm(v), lambda n: F.zip_with(p, v, lambda a, b: F.cos(n) * dbl(a) + F.when(n > 1e-12, F.sin(n) * dbl(b) / F.greatest(n, F.lit(1e-12))).otherwise(0.0)))


def parallel_transport(p: Column, q: Column, v: Column) -> Column:
    """A tangent vector at ``p`` carried along the great circle to ``q``."""
    scale = V.dot(q, v) / (1 + V.dot(p, q))
    both = F.zip_with(p, q, lambda a, b: dbl(a) + dbl(b))
    return V.let(scale, lambda k: F.zip_with(v, both, lambda x, s: dbl(x) - k * s))


# Pattern memory


def remember(store: DataFrame, new: DataFrame, order: str, most: int = 1000) -> DataFrame:
    """The newest ``most`` patterns of a memory and what is added to it."""
    return store.unionByName(new).orderBy(F.desc(order)).limit(most)


def recall_patterns(store: DataFrame, queries: DataFrame, threshold: float = 0.8, block: int = 4096) -> DataFrame:
    """``query_id, pattern_id, similarity`` of stored binary patterns at or above the threshold; exact.

    The queries are a stated set, taken ``block`` at a time; each block scans the store once,
    comparing packed bits.  Only patterns of one length are compared; null ones match nothing.
    """

    def packed(patterns: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Places and packed bits of the patterns of each length."""
        by: dict[int, list[int]] = {}
        for i, p in enumerate(patterns):
            if p:
                by.setdefault(len(p), []).append(i)
        return {n: (np.array(at), np.packbits(np.array([patterns[i] for i in at], dtype=np.uint8), axis=1)) for n, at in by.items()}

    def scan(ids: np.ndarray, wanted: dict[int, tuple[np.ndarray, np.ndarray]]):
        def run(batches):
            for batch in batches:
                found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
                mine = batch.column("pattern_id").to_numpy()
                for n, (at, bits) in packed(batch.column("pattern").to_pylist()).items():
                    if n not in wanted:
                        continue
                    places, asked = wanted[n]
                    for q, row in zip(ids[places], asked):
                        differ = np.bitwise_count(bits ^ row).sum(axis=1, dtype=np.int64)
                        likeness = 1 - differ / n
                        good = likeness >= threshold
                        found.append((np.full(good.sum(), q), mine[at[good]], likeness[good]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["query_id", "pattern_id", "similarity"])

        return run

    rows = store.where("pattern_id IS NOT NULL AND pattern IS NOT NULL").select(F.col("pattern_id").cast("long").alias("pattern_id"), F.col("pattern").cast("array<int>").alias("pattern"))
    each = queries.where("query_id IS NOT NULL AND pattern IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.col("pattern").cast("array<int>").alias("pattern")).toLocalIterator()
    shape, out = "query_id long, pattern_id long, similarity double", None
    while some := list(islice(each, block)):
        part = rows.mapInArrow(scan(np.array([r["query_id"] for r in some], dtype=np.int64), packed([r["pattern"] for r in some])), shape)
        out = part if out is None else out.union(part)
    return out if out is not None else rows.limit(0).selectExpr("pattern_id AS query_id", "pattern_id", "0D AS similarity")


def detect_interference(a: Column, b: Column) -> Column:
    """Constructive, destructive and multiplicative parts over the energy of both."""
    e = V.energy(a) + V.energy(b)
    safe = F.when(e > 0, e)
    return F.struct(
        F.coalesce(V.energy(F.zip_with(a, b, lambda x, y: dbl(x) + dbl(y))) / safe, F.lit(0.0)).alias("constructive"),
        F.coalesce(V.energy(F.zip_with(a, b, lambda x, y: dbl(x) - dbl(y))) / safe, F.lit(0.0)).alias("destructive"),
        F.coalesce(V.energy(F.zip_with(a, b, lambda x, y: dbl(x) * dbl(y))) / safe, F.lit(0.0)).alias("multiplicative"),
    )


def resonance(xs: Column, shifts: int = 8) -> Column:
    """Mean product of a wave with itself shifted by 0, 1, ... steps."""
    return F.transform(F.sequence(F.lit(0), F.lit(shifts - 1)), lambda s: V.dot(xs, V.roll(xs, s)) / F.size(xs))


@dataclass
class WaveNetwork:
    """A layer whose rows leave bits in a memory of up to 64 cells, one long for each state.

    The hidden values are linear in ``columns`` (``inward``: columns x hidden) and give the
    outputs (``outward``: hidden x outputs) and the wave (``cells``: hidden x cells), which
    has the bits of the cells above ``threshold``.  Of a wave only what both gates let
    through (bits as whole numbers) is added to the memory.
    """

    columns: list[str]
    inward: np.ndarray
    cells: np.ndarray
    outward: np.ndarray
    memory_gate: int
    update_gate: int
    threshold: float = 0.5

    def wave(self) -> Column:
        """The cells as bits; null where an input is null."""
        weights = self.inward @ self.cells
        if weights.shape[1] > 64:
            raise ValueError("at most 64 cells")
        out = F.lit(0).cast("long")
        for c in range(weights.shape[1]):
            out = out + F.shiftleft((linear(self.columns, weights[:, c]) > self.threshold).cast("long"), c)
        return out

    def outputs(self, prefix: str = "y") -> dict[str, Column]:
        weights = self.inward @ self.outward
        return {f"{prefix}_{j}": linear(self.columns, weights[:, j]) for j in range(weights.shape[1])}

    def forward(self, df: DataFrame, key: list[str], order: list[str], memory: int | None = None, parts: int | None = None) -> DataFrame:
        """Adds the outputs, ``wave`` and ``memory``, the state after each row of a series.

        Without a ``memory`` to begin with, the first wave of a series is its memory, whole.
        Bits are only ever added, so ranges of a series are folded apart and chained.
        """
        let = _long(self.memory_gate & self.update_gate)
        rows = df.withColumns({**self.outputs(), "wave": self.wave()})
        return gathered_bits(rows, key, order, F.col("wave").bitwiseAND(F.lit(let)), "memory", F.col("wave") if memory is None else F.lit(_long(memory)), parts)


def _long(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits
