"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other.  Each is a logistic regression over the
presence of words and word beginnings (which carry over to other endings), and over the
log-odds that the chain gave the categories before.  In training those come from models
that had not seen the document (out-of-fold), so that a later link learns from earlier
probabilities as they will be on new texts.

The chain is fitted on a bounded sample: up to ``per_class`` different labelled documents
with and up to as many without the last category, chosen by a hash after ids and texts have
met, so that an id on many rows adds no more than it may.  Their features are counted in
Spark, the ``keep`` with the largest chi-square of any category are selected, and only those
come to the driver.  Scoring reads whole texts in one pass, without a shuffle.

Defined cases: a null or empty text has no features and gets the chain's prior; without
labelled rows, or rows of both kinds, every probability is 0 and nothing is flagged.  Of
several labels of one id the largest counts; an id whose last label is null everywhere is
unlabelled.  Different texts of a labelled id each carry its label; repeated rows count once.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch, map_rows, spread_sample, texts

WORDS = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 22
STEMS = (4, 5, 6)
CACHED = 400_000


def features(word: str) -> tuple[int, ...]:
    """Buckets of a lower-case word: itself and its beginnings."""
    names = [f"w{word}"] + [f"p{word[:k]}" for k in STEMS if len(word) >= k]
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in names)


def logit(p: np.ndarray) -> np.ndarray:
    return np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def regress(x: np.ndarray, extra: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression: for ``x``, then ``extra``, then the intercept."""
    full = np.concatenate([x, extra / 8, np.ones((len(x), 1))], axis=1).astype(np.float32)
    w = np.zeros(full.shape[1], dtype=np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        g = full.T @ (sigmoid(full @ w) - y) / len(y) + decay * w
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w[x.shape[1] : -1] /= 8
    return w


def apply_weights(w: np.ndarray, x: np.ndarray, extra: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[: x.shape[1]] + extra @ w[x.shape[1] : -1] + w[-1])


@dataclass
class Chain:
    """Selected buckets, one weight vector for each category in order, and a threshold for the last."""

    categories: list[str]
    buckets: dict[int, int]
    weights: list[np.ndarray]
    threshold: float

    def __post_init__(self):
        self.cache: dict[str, tuple[int, ...]] = {}

    def hits(self, text: str | None) -> list[int]:
        """Places of the selected features that a text has."""
        if not text:
            return []
        cache, got = self.cache, set()
        if len(cache) > CACHED:
            cache.clear()
        for w in set(WORDS.findall(text.lower())):
            if (own := cache.get(w)) is None:
                own = cache[w] = tuple(self.buckets[i] for i in features(w) if i in self.buckets)
            if own:
                got.update(own)
        return sorted(got)

    def predict(self, hits: list[list[int]]) -> np.ndarray:
        """Probabilities (rows x categories), each fed to the links after it."""
        n = len(self.buckets)
        out = np.zeros((len(hits), len(self.categories)))
        if not self.weights:
            return out
        sizes = np.array([len(h) for h in hits])
        flat, row = np.array([i for h in hits for i in h], dtype=np.int64), np.repeat(np.arange(len(hits)), sizes)
        for j, w in enumerate(self.weights):
            z = np.bincount(row, w[:n][flat], len(hits)) if len(flat) else np.zeros(len(hits))
            out[:, j] = sigmoid(z + logit(out[:, :j]) @ w[n:-1] + w[-1])
        return out


def fit(x: np.ndarray, labels: np.ndarray, categories: list[str], buckets: list[int], folds: int = 3, seed: int = 3) -> Chain:
    """The chain from a presence matrix and one column of 0 and 1 for each category."""
    fold = np.random.default_rng(seed).permutation(len(x)) % folds
    blind, weights = np.zeros((len(x), 0), dtype=np.float32), []
    for j in range(len(categories)):
        y, given, p = labels[:, j].astype(np.float32), logit(blind), np.zeros(len(x))
        for f in range(folds):
            on, off = fold != f, fold == f
            p[off] = apply_weights(regress(x[on], given[on], y[on]), x[off], given[off])
        weights.append(regress(x, given, y))
        blind = np.concatenate([blind, p[:, None].astype(np.float32)], axis=1)
    return Chain(categories, {b: i for i, b in enumerate(buckets)}, weights, best_threshold(blind[:, -1], labels[:, -1]))


def best_threshold(p: np.ndarray, y: np.ndarray, least: float = 0.5) -> float:
    """The probability with the largest F1, in the middle of the gap to the next one below; ``least`` at least."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    right = np.cumsum(y)
    f1 = 2 * right / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    f1[:-1][p[:-1] == p[1:]] = -1  # equal probabilities can't be parted
    best = int(f1.argmax())
    return max(least, float((p[best] + (p[best + 1] if best + 1 < len(p) else 0)) / 2))


def learn(docs: DataFrame, labels: DataFrame, categories: list[str], per_class: int = 4000, keep: int = 2500, least: int = 5, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """A chain fitted on a bounded sample; ``labels`` has the id and one column for each category,
    which may be 0/1 or an SQL condition over ``toxic`` and ``words`` given as a dict value.
    """
    spark, names = docs.sparkSession, list(categories)
    rules = categories if isinstance(categories, dict) else {c: c for c in categories}
    last = names[-1]
    numeric = [c for c, t in labels.dtypes if c not in (id_col, "doc_id", "text", "feats", "words") and t in ("int", "bigint", "boolean", "smallint", "tinyint")]
    rows = labels.select(labels[id_col].cast("long").alias("doc_id"), *[labels[c] for c in numeric]).where("doc_id IS NOT NULL")
    rows = rows.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in numeric])
    rows = rows.withColumn("__y", F.expr(f"cast({rules[last]} as int)"))
    chosen = spread_sample(rows, "__y", per_class, F.xxhash64("doc_id"))
    # At most 2 * per_class rows of a few numbers: a proven bound for a broadcast.
    met = texts(docs, id_col, text_col).where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    drawn = spread_sample(Scratch(spark, "toxicity").write(met.distinct()), "__y", per_class, F.xxhash64("doc_id", "text"))

    def run(batch: pa.RecordBatch) -> list:
        found = [set(WORDS.findall(t.lower())) for t in batch.column("text").to_pylist()]
        own = [[*batch.column(c).to_pylist()] for c in numbers]
        return [*own, [sorted({i for w in x for i in features(w)}) for x in found], [sorted(x & terms) for x in found]]

    numbers = [*numeric, "__y"]
    terms = {t for r in rules.values() for t in re.findall(r"'(\w+)'", r)}
    kinds = dict(chosen.dtypes)
    shape = ", ".join(f"`{c}` {kinds[c]}" for c in numbers) + ", feats array<int>, words array<string>"
    got = map_rows(drawn.select("text", *numbers), run, shape)
    got = got.select("feats", *[F.expr(f"coalesce(cast({rules[c]} as int), 0)").alias(f"y{i}") for i, c in enumerate(names)])
    table = Scratch(spark, "toxicity").write(got)
    ys = [f"y{i}" for i in range(len(names))]
    total = table.agg(F.count("*"), *[F.sum(y) for y in ys]).first()
    n, sums = total[0], [x or 0 for x in total[1:]]
    if not n or not 0 < sums[-1] < n:
        return Chain(names, {}, [], 1.0)
    seen = table.select(F.explode("feats").alias("f"), *ys).groupBy("f").agg(F.count("*").cast("double").alias("c"), *[F.sum(y).cast("double").alias(y) for y in ys]).where(F.col("c") >= least)

    def chi(i: int):
        # Chi-square of presence against the category, without its constant.
        a, s = F.col(ys[i]), float(sums[i])
        return F.when(F.lit(s) * (n - s) > 0, F.pow(a * n - F.col("c") * s, 2) / (F.col("c") * (n - F.col("c") + 1) * (s * (n - s) + 1))).otherwise(0.0)

    ranked = seen.select("f", F.greatest(*[chi(i) for i in range(len(ys))], F.lit(0.0)).alias("x")).orderBy(F.desc("x"), "f").limit(keep)
    picked = [r["f"] for r in ranked.collect()]
    place = {b: i for i, b in enumerate(picked)}
    wanted = F.filter(F.split(F.lit(",".join(map(str, picked))), ","), lambda x: x != "").cast("array<int>")  # one literal, not thousands
    rows = table.select(F.array_intersect("feats", wanted).alias("feats"), *ys).collect()
    rows.sort(key=tuple)  # the order of rows must not matter
    x = np.zeros((len(rows), len(picked)), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, [place[f] for f in r["feats"]]] = 1
    return fit(x, np.array([[r[y] for y in ys] for r in rows]), names, picked)


def predict(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``p_<category>`` for each, and ``flagged`` (the last one's threshold reached)."""
    shipped = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batch: pa.RecordBatch) -> list:
        c = shipped.value
        p = c.predict([c.hits(t) for t in batch.column("text").to_pylist()])
        return [batch.column("doc_id"), *p.T, bool_(p[:, -1] >= c.threshold, c)]

    def bool_(x: np.ndarray, c: Chain) -> np.ndarray:
        return x & bool(c.weights)

    return map_rows(texts(docs, id_col, text_col), run, "doc_id long, " + ", ".join(f"`p_{c}` double" for c in chain.categories) + ", flagged boolean")
