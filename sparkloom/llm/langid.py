"""Language identification by a linear-chain conditional random field over words.

A word's emission scores are sums of weights of hashed features: prefixes and suffixes,
character n-grams with word ends, and membership in per-language lexicons.  Learned
transitions tie neighbouring words together, and forward-backward gives each word's
probability of each language, also where a text switches between languages.  A text's
language is the one with the largest mean probability over its words; that mean is the
score.

The field is fitted on a bounded sample of labelled rows: ``per_lang`` for each language,
every one that occurs, chosen by a hash of id and text, and of each
``per_text`` segments of 16 words from hashed places of the whole text.  Words that fill
no segment of their own are in one that overlaps the one before; a text of fewer words
is one segment, repeated to its length.  A third of the training sequences are
code-switched, put together from segments of different languages.  Prediction reads whole
texts, in one pass without a shuffle; the weights it ships hold ``2 ** bits`` numbers for each
language (a parameter, 65,536 unless told otherwise: choose fewer for hundreds of languages).
Training takes up to ``CELLS`` over the squared number of languages sequences of each, and
two at least, which bounds its time.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is
every text if nothing could be learned; rows are independent.  Labelled rows that are
repeated count once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch, map_rows, spread_sample, texts

UND = "und"
BITS = 16  # of the number of buckets for each language; the row after them is that of no feature, whose weights stay 0, and lexicon rows follow
CELLS = 1 << 16  # training sequences of a language times the squared number of languages
WORDS = re.compile(r"[^\W\d_]+")
UNIT = 16  # words of a segment
UNITS = 3
CACHED = 1_200_000  # scores kept
CHUNK = 200_000  # scores computed at once


def features(words: list[str], lexicon: dict[str, int], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of every character of the marked words ``^word$``, and where each word starts.

    A character begins an n-gram of 2, 3 and 4 characters, if its word is long enough;
    with the marks these are inner n-grams, prefixes and suffixes of 1 to 3.  The fourth
    column is the word's lexicon entry, at its first character.
    """
    none = 1 << bits
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    left = np.repeat(starts + sizes, sizes) - np.arange(sizes.sum())  # characters up to the word's end
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    out = np.full((len(codes), 4), none, dtype=np.int64)
    gram = codes
    for n in (2, 3, 4):
        gram = gram[:-1] * np.uint64(1000003) + codes[n - 1 :]
        mixed = (gram ^ (gram >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15 + 2 * n)
        whole = left[: len(gram)] >= n
        out[: len(gram), n - 2][whole] = (mixed >> np.uint64(64 - bits)).astype(np.int64)[whole]
    out[starts, 3] = np.fromiter((none if (i := lexicon.get(w)) is None else none + 1 + i for w in words), dtype=np.int64, count=len(words))
    return out, starts


@dataclass
class Model:
    """Weights (buckets x languages), transitions (from x to), start scores and lexicons."""

    langs: list[str]
    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray
    lexicon: dict[str, int]
    bits: int = BITS

    def __post_init__(self):
        self.cache: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.langs)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("cache", "scores")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def rows_of(self, words: list[str]) -> np.ndarray:
        """Emission scores of the words; those of recent words are kept."""
        k = len(self.langs)
        if len(self.cache) > CACHED // k:
            self.__post_init__()
        cache = self.cache
        new = [w for w in dict.fromkeys(words) if w not in cache]
        if new:
            step = max(1, CHUNK // k)
            fresh = np.concatenate([emissions(self.weights, *features(new[i : i + step], self.lexicon, self.bits)) for i in range(0, len(new), step)])
            base = len(self.scores)
            self.scores = np.concatenate([self.scores, fresh])
            cache.update((w, base + i) for i, w in enumerate(new))
        return self.scores[np.fromiter(map(cache.__getitem__, words), dtype=np.int64, count=len(words))]

    def predict(self, found: list[list[str]]) -> list[tuple[str, float]]:
        """Language and score of each list of words; an empty one is ``und``."""
        out = [(UND, 0.0)] * len(found)
        if not self.langs:
            return out
        order = sorted((i for i, x in enumerate(found) if x), key=lambda i: -len(found[i]))
        if order:
            sizes = np.array([len(found[i]) for i in order])
            means = mean_marginals(self.rows_of([w for i in order for w in found[i]]), sizes, self.moves, self.start)
            for i, m in zip(order, means):
                best = int(m.argmax())
                out[i] = (self.langs[best], float(min(1.0, m[best])))
        return out


def emissions(weights: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the weights of each word's features."""
    return np.add.reduceat(sum(weights[rows[:, i]] for i in range(rows.shape[1])), starts, axis=0)


def _steps(scores, sizes, moves, start):
    """Scaled forward messages; sizes fall, so the sequences alive at a step come first."""
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    move, off = np.exp(moves), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    alive = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # sequences longer than t
    alpha = np.empty_like(p)
    a = p[off] * np.exp(start)
    for t in range(sizes[0]):
        k = alive[t]
        at = off[:k] + t
        if t:
            a = (a[:k] @ move) * p[at]
        a = a / a.sum(axis=1, keepdims=True)
        alpha[at] = a
    return p, move, off, alive, alpha


def mean_marginals(scores, sizes, moves, start) -> np.ndarray:
    """Mean over each sequence's words of the probabilities of the labels."""
    p, move, off, alive, alpha = _steps(scores, sizes, moves, start)
    total, b = np.zeros((len(sizes), scores.shape[1])), np.ones((len(sizes), scores.shape[1]))
    for t in range(sizes[0] - 1, -1, -1):
        k = alive[t]
        at = off[:k] + t
        m = alpha[at] * b[:k]
        total[:k] += m / m.sum(axis=1, keepdims=True)
        back = (p[at] * b[:k]) @ move.T
        b[:k] = back / back.sum(axis=1, keepdims=True)
    return total / sizes[:, None]


def _gradient(scores, gold, moves, start):
    """Expected minus observed counts for sequences of one length: (n, t, labels) scores."""
    n, t, k = scores.shape
    p, move = np.exp(scores - scores.max(axis=2, keepdims=True)), np.exp(moves)
    alpha, beta = np.empty_like(p), np.ones_like(p)
    for i in range(t):
        a = p[:, i] * (np.exp(start) if not i else alpha[:, i - 1] @ move)
        alpha[:, i] = a / a.sum(axis=1, keepdims=True)
    for i in range(t - 2, -1, -1):
        b = (p[:, i + 1] * beta[:, i + 1]) @ move.T
        beta[:, i] = b / b.sum(axis=1, keepdims=True)
    marg = alpha * beta
    marg /= marg.sum(axis=2, keepdims=True)
    before, after = alpha[:, :-1].reshape(-1, k), (p * beta)[:, 1:].reshape(-1, k)
    after = after / ((before @ move) * after).sum(axis=1, keepdims=True)
    seen = np.bincount((gold[:, :-1] * k + gold[:, 1:]).ravel(), minlength=k * k).reshape(k, k)
    marg[np.arange(n)[:, None], np.arange(t), gold] -= 1
    return marg, move * (before.T @ after) - seen, marg[:, 0].sum(axis=0)


def lexicons(passages: list[tuple[int, list[str]]], langs: int, least: int = 3, share: float = 0.9) -> dict[str, int]:
    """Words seen ``least`` times whose occurrences are nearly all of one language."""
    counts: dict[str, np.ndarray] = {}
    for lang, words in passages:
        for w in words:
            counts.setdefault(w, np.zeros(langs))[lang] += 1
    return {w: int(c.argmax()) for w, c in counts.items() if c.sum() >= least and c.max() >= share * c.sum()}


def segments(words: list[str]) -> list[list[str]]:
    """The words ``UNIT`` at a time; the last ones with as many before them as it takes, few words repeated."""
    if not words:
        return []
    if len(words) < UNIT:
        return [(words * UNIT)[:UNIT]]
    return [words[i : i + UNIT] for i in range(0, len(words) - UNIT + 1, UNIT)] + ([words[-UNIT:]] if len(words) % UNIT else [])


def fit(passages: list[tuple[str, str]], rounds: int = 40, rate: float = 0.15, decay: float = 1e-4, seed: int = 7, bits: int = BITS) -> Model:
    """The field from (language, passage) pairs."""
    langs = sorted({lang for lang, _ in passages})
    place, rng, k = {x: i for i, x in enumerate(langs)}, np.random.default_rng(seed), len(langs)
    listed = [(place[lang], WORDS.findall(text.lower())) for lang, text in passages]
    units = [(lang, part) for lang, words in listed for part in segments(words)]
    none = 1 << bits
    model = Model(langs, np.zeros((none + 1 + k, k), dtype=np.float32), np.zeros((k, k)), np.zeros(k), lexicons(listed, k), bits)
    if k < 2 or not units:
        return model
    by = [[] for _ in langs]
    for i in rng.permutation(len(units)):
        by[units[i][0]].append(units[i])
    many = min(-(-max(map(len, by)) // UNITS), max(2, CELLS // (k * k)))  # sequences: every language as often as the most frequent one
    rows = []
    for own in by:
        for j in range(many if own else 0):
            rest = [units[rng.integers(len(units))] if j % UNITS == 0 else own[rng.integers(len(own))] for _ in range(UNITS - 1)]
            rows.append([own[j * UNITS % len(own)], *rest])
    gold = np.array([[lang for lang, _ in row for _ in range(UNIT)] for row in rows])
    names: dict[str, int] = {}
    ids = np.array([[names.setdefault(w, len(names)) for _, words in row for w in words] for row in rows])
    rows_of, starts = features(list(names), model.lexicon, bits)
    sizes = np.diff(starts, append=len(rows_of))
    step = max(1, CHUNK // k)
    cuts = [(i, min(i + step, len(names)), starts[i], starts[i + step] if i + step < len(names) else len(rows_of)) for i in range(0, len(names), step)]
    params = [np.zeros(model.weights.shape), model.moves, model.start]
    mean, var = [np.zeros_like(q) for q in params], [np.zeros_like(q) for q in params]
    for turn in range(1, rounds + 1):
        score = np.concatenate([emissions(params[0], rows_of[c:d], starts[a:b] - c) for a, b, c, d in cuts])
        g, move_g, start_g = _gradient(score[ids], gold, params[1], params[2])
        weight_g = np.empty_like(params[0])
        for i in range(k):
            of_word = np.bincount(ids.ravel(), g[..., i].ravel(), len(names))
            weight_g[:, i] = np.bincount(rows_of.ravel(), np.repeat(of_word, 4 * sizes), len(params[0]))
        weight_g[none] = 0
        for q, dq, m, v in zip(params, (weight_g, move_g, start_g), mean, var):
            dq = dq / len(rows) + decay * q
            m += 0.1 * (dq - m)
            v += 0.01 * (dq * dq - v)
            q -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    model.weights = params[0].astype(np.float32)
    return model


def drawn(text: str, mark: int, per_text: int) -> list[str]:
    """Up to ``per_text`` segments of the whole text, from places that ``mark`` decides; a short text whole."""
    words = WORDS.findall(text.lower())
    if len(words) < UNIT:
        return [" ".join(words)] if words else []
    parts = segments(words)
    some = np.random.default_rng(mark % (1 << 63)).choice(len(parts), min(per_text, len(parts)), replace=False)
    return [" ".join(parts[i]) for i in sorted(some)]


def sample(docs: DataFrame, per_lang: int, per_text: int, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """Segments with their languages: at most ``per_text`` of each of ``per_lang`` rows of every language."""
    rows = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"), F.xxhash64(F.lit("passage"), docs[id_col].cast("long"), docs[text_col].cast("string")).alias("mark")).where("lang IS NOT NULL AND text IS NOT NULL")
    marks = rows.select("lang", "mark").distinct()
    picked = Scratch(docs.sparkSession, "langid").write(spread_sample(marks, "lang", per_lang, F.col("mark")))  # written, so that Spark knows its size
    once = rows.join(picked, ["lang", "mark"]).groupBy("lang", "mark").agg(F.min("text").alias("text"))

    def run(batch: pa.RecordBatch) -> list:
        lang, text, mark = (batch.column(c).to_pylist() for c in ("lang", "text", "mark"))
        return [lang, [drawn(t, m, per_text) for t, m in zip(text, mark)]]

    return sorted((r["lang"], part) for r in map_rows(once, run, "lang string, parts array<string>").collect() for part in r["parts"])


def learn(docs: DataFrame, per_lang: int = 400, per_text: int = 6, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model fitted on a bounded sample of the labelled rows of ``docs``."""
    return fit(sample(docs, per_lang, per_text, id_col, text_col, lang_col), bits=bits)


def words_of(text: str | None) -> list[str]:
    """Lower-case words; none if the text has no letter."""
    words = WORDS.findall(text.lower()) if text else []
    return words if any(c.isalpha() for w in words for c in w) else []


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list:
        said = shipped.value.predict([words_of(t) for t in batch.column("text").to_pylist()])
        return [batch.column("doc_id"), [x for x, _ in said], [x for _, x in said]]

    return map_rows(texts(docs, id_col, text_col), run, "doc_id long, lang_pred string, score double", _slice(model))


def _slice(model: Model) -> int:
    """Bytes of text at once: less the more languages there are."""
    return max(1 << 16, (8 << 20) * 4 // max(4, len(model.langs)))


def keep(docs: DataFrame, model: Model, least: float = 0.5, langs: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The rows whose language is known (one of ``langs``, or any learned) with score ``least``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batch: pa.RecordBatch) -> list:
        said = shipped.value.predict([words_of(t) for t in batch.column(names.index(text_col)).to_pylist()])
        good = pa.array([x != UND and s >= least and (langs is None or x in langs) for x, s in said])
        return list(batch.filter(good).columns)

    return map_rows(docs, run, docs.schema, _slice(model))
