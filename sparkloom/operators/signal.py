"""Signals: one row holds one signal in an array column, so features are Column expressions.

Long transforms and those over several axes run in Arrow batches; short ones, and the
features that need no spectrum, stay inside the JVM.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import vector as V
from sparkloom.functions.ieee import clip, dbl

COMPLEX = "array<struct<re:double,im:double>>"


def rms(xs: Column) -> Column:
    return F.sqrt(V.energy(xs) / V.length(xs))


def peak(xs: Column) -> Column:
    return V.norm(xs, math.inf)


def crest_factor(xs: Column) -> Column:
    return F.when(rms(xs) == 0, 0.0).otherwise(peak(xs) / F.when(rms(xs) != 0, rms(xs)))  # null where the rms is


def _steps(xs: Column) -> tuple[Column, Column]:
    """All entries but the last, and all but the first; none of fewer than two."""
    n = F.greatest(F.size(xs) - 1, F.lit(0))
    return F.slice(xs, 1, n), F.slice(xs, 2, n)


def zero_crossings(xs: Column) -> Column:
    """Share of neighbours whose signs differ."""
    signs = F.transform(xs, lambda x: (dbl(x) >= 0).cast("int"))
    pairs = F.zip_with(*_steps(signs), lambda a, b: F.abs(a - b))
    return F.aggregate(pairs, F.lit(0), lambda a, x: a + x) / V.length(xs)


def dft_rows(df: DataFrame, key: str, xs: str, n: int) -> DataFrame:
    """``key`` and ``z``, the transform of arrays of ``n`` values, as rows joined with a table of n squared factors.

    Vectors are dealt out by key once; both aggregates then need no other shuffle.  The factors
    are bounded by ``n``, which is checked against what may be broadcast.
    """
    if n > 512:
        raise ValueError("use fft for long signals")
    turn = F.col("id") % n * F.floor(F.col("id") / n) % n * (2 * math.pi / n)
    factors = df.sparkSession.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("k"), (F.col("id") % n).cast("int").alias("j"), F.cos(turn).alias("c"), (-F.sin(turn)).alias("s"))
    parts = df.select(key, F.col(xs).alias("__x")).repartition(key).select(key, F.posexplode("__x").alias("j", "x"))
    terms = parts.join(F.broadcast(factors), "j").groupBy(key, "k").agg(F.sum(dbl(F.col("x")) * F.col("c")).alias("re"), F.sum(dbl(F.col("x")) * F.col("s")).alias("im"))
    z = F.array_sort(F.collect_list(F.struct("k", "re", "im")))
    return terms.groupBy(key).agg(z.alias("z")).select(key, F.transform("z", lambda v: F.struct(v["re"].alias("re"), v["im"].alias("im"))).alias("z"))


def magnitudes(xs: Column) -> Column:
    """Of the non-negative frequencies."""

    @F.arrow_udf("array<double>")
    def run(col: pa.Array) -> pa.Array:
        return _by_length(col, lambda m: np.abs(np.fft.rfft(m, axis=1)), real=True)

    return run(xs.cast("array<double>"))


def spectral_centroid(mags: Column, step: float | Column) -> Column:
    """Mean frequency by magnitude; ``step`` is the width of a bin in Hz."""
    total = V.total(mags)
    return F.when(total > 0, V.total(F.transform(mags, lambda m, k: m * k * step)) / F.when(total > 0, total)).otherwise(0.0)


def spectral_bandwidth(mags: Column, step: float | Column) -> Column:
    total = V.total(mags)
    spread = V.let(spectral_centroid(mags, step), lambda c: V.total(F.transform(mags, lambda m, k: m * F.pow(k * step - c, F.lit(2.0)))))
    return F.when(total > 0, F.sqrt(spread / F.when(total > 0, total))).otherwise(0.0)


def spectral_rolloff(mags: Column, step: float | Column, share: float = 0.85) -> Column:
    """The frequency under which that share of the magnitude lies."""
    below = V.let(share * V.total(mags), lambda most: F.size(F.filter(V.cumsum(mags), lambda s: s < most)))
    return below * step


def dominant_frequency(mags: Column, step: float | Column) -> Column:
    return V.first_argmax(mags) * step


def wave_features(xs: Column, mags: Column, step: float) -> Column:
    return F.struct(
        rms(xs).alias("rms"), peak(xs).alias("peak"), crest_factor(xs).alias("crest_factor"), zero_crossings(xs).alias("zero_crossing_rate"),
        spectral_centroid(mags, step).alias("spectral_centroid"), spectral_bandwidth(mags, step).alias("spectral_bandwidth"), spectral_rolloff(mags, step).alias("spectral_rolloff"), dominant_frequency(mags, step).alias("dominant_frequency"),
    )


# Conversions


def pcm_to_float(x: Column) -> Column:
    return dbl(x) / 32768


def float_to_pcm(x: Column) -> Column:
    return clip(F.round(dbl(x) * 32768), -32768, 32767).cast("int")


def amplitude_to_db(x: Column, least: float = -80.0) -> Column:
    return F.greatest(20 * F.log10(F.greatest(F.abs(dbl(x)), F.lit(1e-10))), F.lit(least))


def power_to_db(x: Column, least: float = -80.0) -> Column:
    return F.greatest(10 * F.log10(F.greatest(dbl(x), F.lit(1e-10))), F.lit(least))


def db_to_amplitude(x: Column) -> Column:
    return F.pow(F.lit(10.0), dbl(x) / 20)


def to_binary(xs: Column, threshold: float = 0.0) -> Column:
    return F.transform(xs, lambda x: (dbl(x) > threshold).cast("int"))


def from_binary(bits: Column, amplitude: float = 1.0) -> Column:
    return F.transform(bits, lambda b: (2 * b - 1) * amplitude)


# Binary waves


def binary_interference(a: Column, b: Column, mode: str = "xor") -> Column:
    ops = {"xor": lambda x, y: x != y, "and": lambda x, y: x & y, "or": lambda x, y: x | y}
    return F.zip_with(a, b, lambda x, y: ops[mode.lower()](x > 0.5, y > 0.5).cast("int"))


def binary_features(xs: Column) -> Column:
    """Density of ones, number of changes, and likeness to the mirror image."""
    change = F.zip_with(*_steps(xs), lambda a, b: F.abs(a - b))
    return F.struct(V.mean(xs).alias("density"), V.total(change).alias("transitions"), V.pattern_similarity(xs, F.reverse(xs)).alias("symmetry"))


def best_shift(a: Column, b: Column, most: int) -> Column:
    """The shift of ``b`` with the largest similarity, and that similarity; the smaller shift on ties."""
    tried = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda s: F.struct(V.pattern_similarity(a, V.roll(b, s)).alias("similarity"), (-s).alias("s")))
    best = F.array_max(tried)
    return F.struct((-best["s"]).alias("shift"), best["similarity"].alias("similarity"))


# Waves


def wave(spark: SparkSession, kind: str, frequency: float, n: int, rate: float, amplitude: float = 1.0, phase: float = 0.0, duty: float = 0.5) -> DataFrame:
    """``i, v``: n samples of a sine, square, sawtooth or triangle wave."""
    t = F.col("id") / rate
    turn = t * frequency - F.floor(t * frequency)
    shape = {
        "sine": amplitude * F.sin(2 * math.pi * frequency * t + phase),
        "square": F.when(turn < duty, amplitude).otherwise(-amplitude),
        "sawtooth": 2 * amplitude * (turn - 0.5),
        "triangle": 2 * amplitude * F.abs(2 * turn - 1) - amplitude,
    }[kind]
    return spark.range(n).select(F.col("id").alias("i"), shape.alias("v"))


def peaks(df: DataFrame, key: list[str], order: str, value: str, share: float = 0.1) -> DataFrame:
    """Rows above both neighbours and above a share of their series' maximum."""
    from pyspark.sql import Window

    w = Window.partitionBy(*key).orderBy(order)
    top = Window.partitionBy(*key)
    x = df.withColumns({"__a": F.lag(value).over(w), "__b": F.lead(value).over(w), "__m": F.max(value).over(top)})
    return x.where((F.col(value) > F.col("__a")) & (F.col(value) > F.col("__b")) & (F.col(value) > share * F.col("__m"))).drop("__a", "__b", "__m")


# Arrow batches


#: Numbers of a batch that one step of a transform turns into complex ones at once.
STEP = 1 << 18


def _some(fn):
    """``fn`` of an array; nothing for a null or empty one, or one with a null entry."""
    return lambda x: None if x is None or not len(x) or any(v is None or v != v for v in x) else fn(x)


def _by_length(xs: pa.Array, fn, real: bool = False) -> pa.Array:
    """Arrays of numbers, or of structs ``re, im``, as the transforms ``fn(matrix)`` of those of one length, without an object for a number.

    Null for a null or empty array and for one with a null or NaN entry.  Matrices hold ``STEP`` numbers, or one array, at most.
    """
    flat, inner = xs.flatten(), np.asarray(xs.value_lengths().fill_null(0), dtype=np.int64)
    parts = flat.flatten() if pa.types.is_struct(flat.type) else [flat]
    numbers = [np.asarray(p.cast(pa.float64()).fill_null(np.nan)) for p in parts]
    starts, many = np.cumsum(inner) - inner, np.zeros(len(xs), dtype=np.int64)
    found = []
    for length in np.unique(inner[inner > 0]):
        rows = np.flatnonzero(inner == length)
        for some in np.array_split(rows, max(1, -(-len(rows) * int(length) // STEP))):
            at = starts[some][:, None] + np.arange(length)
            cells = [n[at] for n in numbers]
            whole = ~np.any([np.isnan(c).any(axis=1) for c in cells], axis=0)
            if whole.any():
                y = np.asarray(fn(np.stack([c[whole] for c in cells], axis=-1).view(complex)[..., 0] if len(cells) > 1 else cells[0][whole]))
                y = y.reshape(len(y), -1)
                many[some[whole]] = y.shape[1]
                found.append((some[whole], y))
    ends = np.cumsum(many)
    out = np.zeros(int(many.sum()), dtype=float if real else complex)
    for rows, y in found:
        out[(ends - many)[rows][:, None] + np.arange(y.shape[1])] = y
    values = pa.array(out) if real else pa.StructArray.from_arrays([pa.array(out.real), pa.array(out.imag)], names=["re", "im"])
    offsets = np.append(0, ends).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(many == 0, False)), values)


def fft(xs: Column, inverse: bool = False, real: bool = False, n: int | None = None) -> Column:
    """Of any length, in Arrow batches.  Forward ones take numbers; inverse ones take structs.

    Null for a null or empty array, and where an entry is null or NaN, as for all transforms here.
    """

    @F.arrow_udf(COMPLEX if not (inverse and real) else "array<double>")
    def run(col: pa.Array) -> pa.Array:
        fn = {(False, False): np.fft.fft, (False, True): np.fft.rfft, (True, False): np.fft.ifft, (True, True): np.fft.irfft}[inverse, real]
        return _by_length(col, lambda m: fn(m, n, axis=1), inverse and real)

    return run(xs if inverse else xs.cast("array<double>"))


def fft_nd(xs: Column, shape: tuple[int, ...], inverse: bool = False, real: bool = False) -> Column:
    """Over several axes: the array holds a row-major block of ``shape``, as does the result."""

    @F.arrow_udf(COMPLEX)
    def run(col: pa.Array) -> pa.Array:
        fn = np.fft.ifftn if inverse else (np.fft.rfftn if real else np.fft.fftn)
        return _by_length(col, lambda m: fn(m.reshape(-1, *shape), axes=tuple(range(1, len(shape) + 1))))

    return run(xs if inverse else xs.cast("array<double>"))


def phases(xs: Column) -> Column:
    """Of all frequencies; an imaginary part of zero has no sign."""
    return F.transform(fft(xs), lambda z: F.atan2(z["im"] + 0.0, z["re"]))


def stft(xs: Column, width: int = 64, hop: int = 16) -> Column:
    """Magnitudes of Hann-windowed frames as an array of arrays."""

    @F.pandas_udf("array<array<double>>")
    def run(col: pd.Series) -> pd.Series:
        hann = np.hanning(width + 1)[:-1]
        one = _some(lambda x: [np.abs(np.fft.rfft(np.asarray(x[i : i + width], dtype=float) * hann)).tolist() for i in range(0, len(x) - width + 1, hop)])
        return pd.Series([one(x) for x in col], dtype=object)

    return run(xs.cast("array<double>"))


def mel_filters(n_bins: int, rate: float, n_mels: int) -> np.ndarray:
    """Triangles at equal steps of the mel scale."""
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), n_mels + 2)
    at = 700 * (10 ** (mel / 2595) - 1)
    freq = np.linspace(0, rate / 2, n_bins)
    up, down = (freq - at[:-2, None]) / (at[1:-1] - at[:-2])[:, None], (at[2:, None] - freq) / (at[2:] - at[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


def mfcc(xs: Column, rate: float = 44100, n_mfcc: int = 13, n_mels: int = 26) -> Column:
    """Cepstral coefficients of the whole signal."""

    @F.pandas_udf("array<double>")
    def run(col: pd.Series) -> pd.Series:
        def one(x) -> list[float]:
            power = np.abs(np.fft.rfft(np.asarray(x, dtype=float))) ** 2
            energy = np.log(np.maximum(mel_filters(len(power), rate, n_mels) @ power, 1e-10))
            k, m = np.arange(n_mfcc)[:, None], np.arange(n_mels)
            return (np.cos(np.pi * k * (m + 0.5) / n_mels) @ energy).tolist()

        return pd.Series([_some(one)(x) for x in col], dtype=object)

    return run(xs.cast("array<double>"))


def phase_coherence(a: Column, b: Column) -> Column:
    """Length of the mean unit vector of the phase differences."""
    d = F.zip_with(phases(a), phases(b), lambda x, y: x - y)
    n = V.length(a)
    return F.sqrt(F.pow(V.total(F.transform(d, F.cos)) / n, F.lit(2.0)) + F.pow(V.total(F.transform(d, F.sin)) / n, F.lit(2.0)))


def correlation(a: Column, b: Column) -> Column:
    means = F.struct(V.mean(a).alias("a"), V.mean(b).alias("b"))
    cov = V.let(means, lambda m: V.total(F.zip_with(a, b, lambda x, y: (dbl(x) - m["a"]) * (dbl(y) - m["b"])))) / V.length(a)
    s = F.sqrt(V.variance(a) * V.variance(b))
    return F.when(s > 0, cov / F.when(s > 0, s)).when(s.isNotNull(), 0.0)


def interference_strength(a: Column, b: Column) -> Column:
    """Correlation, weighted by how close the phases are on average."""
    d = F.zip_with(phases(a), phases(b), lambda x, y: F.abs(x - y))
    return correlation(a, b) * (1 - V.mean(d) / math.pi)
