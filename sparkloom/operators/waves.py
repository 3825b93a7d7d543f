"""Harmonics, pulse width and quantised blocks, and measures of activity."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import vector as V
from sparkloom.functions.ieee import dbl
from sparkloom.functions.random import keyed_uniform

PEAKS = "array<struct<frequency:bigint,amplitude:double>>"


def sliding_interference(a: Column, b: Column, width: int = 100) -> Column:
    """Correlation times closeness of phases, for each window of ``width`` values of two signals.

    A signal shorter than a window gives an empty array; the longer of two is cut to the other.
    """

    @F.pandas_udf("array<double>")
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(xs, ys):
            n = min(len(x), len(y)) if x is not None and y is not None else 0
            if n < width:
                out.append(None if x is None or y is None else [])
                continue
            p, q = (np.lib.stride_tricks.sliding_window_view(np.asarray(z[:n], dtype=float), width) for z in (x, y))
            dp, dq = p - p.mean(axis=1, keepdims=True), q - q.mean(axis=1, keepdims=True)
            size = np.sqrt((dp**2).sum(axis=1) * (dq**2).sum(axis=1))
            turn = np.abs(np.angle(np.fft.fft(p, axis=1) + 0.0) - np.angle(np.fft.fft(q, axis=1) + 0.0)).mean(axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                out.append(((dp * dq).sum(axis=1) / size * (1 - turn / np.pi)).tolist())
        return pd.Series(out)

    return run(a.cast("array<double>"), b.cast("array<double>"))


def banded_coherence(a: Column, b: Column, low: float, high: float) -> Column:
    """Length of the mean unit vector of the phase differences of frequencies from ``low`` to ``high`` (cycles a sample)."""

    @F.pandas_udf("double")
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(xs, ys):
            n = min(len(x), len(y)) if x is not None and y is not None else 0
            f = np.abs(np.fft.fftfreq(n)) if n else np.zeros(0)
            band = (f >= low) & (f <= high)
            if not band.any():
                out.append(None)
                continue
            d = np.angle(np.fft.fft(np.asarray(x[:n], dtype=float))[band] + 0.0) - np.angle(np.fft.fft(np.asarray(y[:n], dtype=float))[band] + 0.0)
            out.append(float(np.abs(np.exp(1j * d).mean())))
        return pd.Series(out)

    return run(a.cast("array<double>"), b.cast("array<double>"))


# Harmonics


def spectrum(xs: Column) -> Column:
    """Magnitudes of the Hann-windowed signal, of the non-negative frequencies."""
    from sparkloom.operators.signal import magnitudes

    n = F.size(xs)
    return magnitudes(F.transform(xs, lambda x, i: dbl(x) * (0.5 - 0.5 * F.cos(2 * math.pi * i / n))))


def harmonic_peaks(mags: Column, step: float, threshold: float = 0.1, tolerance: float = 0.01) -> Column:
    """Local maxima over ``threshold`` of the greatest magnitude: whole frequencies and relative amplitudes, largest first.

    Peaks within ``tolerance`` of one met before merge into the larger.  ``step`` is the width of a bin.
    """

    @F.pandas_udf(PEAKS)
    def run(col: pd.Series) -> pd.Series:
        out = []
        for m in col:
            if m is None or not len(m):
                out.append(None if m is None else [])
                continue
            m = np.asarray(m)
            top, merged = m.max(), {}
            for i in np.flatnonzero((m[1:-1] > m[:-2]) & (m[1:-1] > m[2:]) & (m[1:-1] > threshold * top)) + 1:
                peak = {"frequency": round(i * step), "amplitude": float(m[i] / top)}
                near = next((f for f in merged if abs(f - peak["frequency"]) <= tolerance), None)
                if near is None or peak["amplitude"] > merged[near]["amplitude"]:
                    merged[peak["frequency"] if near is None else near] = peak
            out.append(sorted(merged.values(), key=lambda p: -p["amplitude"]))
        return pd.Series(out)

    return run(mags)


def harmonic_ratio(mags: Column, peaks: Column) -> Column:
    """The relative amplitudes of the peaks over the sum of all magnitudes; 0 without either."""
    found = F.aggregate(peaks, F.lit(0.0), lambda a, p: a + p["amplitude"])
    return V.let(V.total(mags), lambda t: F.when(t > 0, found / F.when(t > 0, t)).otherwise(0.0))


def harmonic_wave(frequencies: list[float], amplitudes: list[float], seconds: float, rate: float, spark: SparkSession, phases: list[float] | None = None, normalised: bool = True) -> DataFrame:
    """``i, v``: a sum of sines over ``seconds``, both ends included; amplitudes are brought to a sum of 1 unless told otherwise."""
    n, total = int(seconds * rate), sum(map(abs, amplitudes))
    t = F.col("id") * (seconds / max(n - 1, 1))
    scale = total if normalised and total > 0 else 1.0
    parts = [a / scale * F.sin(2 * math.pi * f * t + p) for f, a, p in zip(frequencies, amplitudes, phases or [0.0] * len(frequencies))]
    return spark.range(n).select(F.col("id").alias("i"), sum(parts, F.lit(0.0)).alias("v"))


def reconstruct(peaks: list[tuple[float, float]], seconds: float, rate: float, spark: SparkSession) -> DataFrame:
    """``i, v`` from (frequency, amplitude) pairs, scaled by the largest amplitude."""
    ordered = sorted(peaks)
    most = max((abs(a) for _, a in ordered), default=1.0)
    wave = harmonic_wave([f for f, _ in ordered], [a for _, a in ordered], seconds, rate, spark)
    return wave.withColumn("v", F.col("v") * most) if most > 0 else wave


def keep_harmonics(xs: Column, frequencies: list[float], rate: float) -> Column:
    """Sines of the kept frequencies, each with the signal's greatest absolute value, averaged."""
    n = F.size(xs)

    def at(top: Column, i: Column) -> Column:
        t = i * (n / rate) / F.greatest(n - 1, F.lit(1))
        return sum((top * F.sin(2 * math.pi * f * t) for f in frequencies), F.lit(0.0)) / len(frequencies)

    return V.let(V.norm(xs, math.inf), lambda top: F.transform(xs, lambda _, i: at(top, i)))


def envelope(xs: Column, shape: Column) -> Column:
    """The signal under an amplitude envelope, brought to its length by straight lines, made positive and brought to a maximum of 1."""
    shape = F.when(F.size(shape) == F.size(xs), F.transform(shape, dbl)).otherwise(V.stretch(shape, F.size(xs)))
    return V.let(shape, lambda own: V.let(V.norm(own, math.inf), lambda top: F.zip_with(xs, own, lambda x, e: F.signum(dbl(x)) * F.least(F.abs(dbl(x)) * F.abs(e) / top, F.abs(dbl(x))))))


# Blocks of a series, as rows with a place ``i`` from 0


def _blocks(df: DataFrame, i: str, size: int) -> DataFrame:
    return df.withColumn("__b", F.floor(F.col(i) / size)).withColumn("__p", F.col(i) % size)


def pulse_width(df: DataFrame, key: list[str], i: str, v: str, period: int, levels: int) -> DataFrame:
    """Adds ``pwm``: of each whole period the first samples high (32767), as its mean says in ``levels`` steps, the rest low (-32768); 0 in a part of one."""
    block = Window.partitionBy(*key, "__b")
    duty = (F.avg(dbl(F.col(v))).over(block) + 32768) / 65536
    high = F.floor(F.rint(duty * (levels - 1)) / (levels - 1) * period)
    rows = _blocks(df, i, period).withColumn("__high", high).withColumn("__n", F.count("*").over(block))
    return rows.withColumn("pwm", F.when(F.col("__n") < period, 0).when(F.col("__p") < F.col("__high"), 32767).otherwise(-32768)).drop("__b", "__p", "__high", "__n")


def duty_cycles(df: DataFrame, key: list[str], i: str, pwm: str, period: int) -> DataFrame:
    """``key, block, duty, pcm`` of each whole period: the share of positive samples, and the value it stands for."""
    got = _blocks(df, i, period).groupBy(*key, F.col("__b").alias("block")).agg(F.count("*").alias("__n"), (F.count_if(F.col(pwm) > 0) / period).alias("duty"))
    return got.where(F.col("__n") == period).select(*key, "block", "duty", (F.col("duty") * 65536 - 32768).cast("int").alias("pcm"))


def pulse_measures(df: DataFrame, key: list[str], i: str, pwm: str, period: int) -> DataFrame:
    """``key`` with the mean, least, greatest and number of different duty cycles."""
    d = F.col("duty")
    return duty_cycles(df, key, i, pwm, period).groupBy(*key).agg(F.avg(d).alias("mean"), F.min(d).alias("low"), F.max(d).alias("high"), F.count_distinct(d).alias("levels"))


def quantise_blocks(df: DataFrame, key: list[str], i: str, v: str, size: int = 4096) -> DataFrame:
    """Adds ``block``, ``scale`` (the greatest absolute value over 127) and ``q``, the value in 8 bits around 128."""
    rows = df.withColumn("block", F.floor(F.col(i) / size))
    scale = F.max(F.abs(dbl(F.col(v)))).over(Window.partitionBy(*key, "block")) / 127
    q = F.when(F.col("scale") > 0, F.rint(F.greatest(F.lit(-127.0), F.least(F.lit(127.0), dbl(F.col(v)) / F.col("scale"))) + 128)).otherwise(128)
    return rows.withColumn("scale", scale).withColumn("q", q.cast("int"))


def quantisation_error(quantised: DataFrame, key: list[str], v: str) -> DataFrame:
    """``key, block, scale, mse`` of what :func:`quantise_blocks` gave."""
    e = dbl(F.col(v)) - (F.col("q") - 128) * F.col("scale")
    return quantised.groupBy(*key, "block").agg(F.max("scale").alias("scale"), F.avg(e * e).alias("mse"))


# Activity


def activity(df: DataFrame, key: list[str], order: list[str], v: str, threshold: float = 0.5, ends: int = 5, least: int = 10) -> DataFrame:
    """``key`` with the share of values over the threshold, their mean, extremes, deviation and last, and the trend.

    The trend is the mean of the last ``ends`` values less that of the first, for more than
    ``least`` of them, else 0.
    """
    x = dbl(F.col(v))
    w, back = Window.partitionBy(*key).orderBy(*order), Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    rows = df.withColumns({"__a": F.row_number().over(w), "__z": F.row_number().over(back)})
    got = rows.groupBy(*key).agg(
        F.count(x).alias("n"), F.avg((x > threshold).cast("double")).alias("active"), F.avg(x).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high"), F.stddev_pop(x).alias("std"),
        F.max(F.when(F.col("__z") == 1, x)).alias("last"), (F.avg(F.when(F.col("__z") <= ends, x)) - F.avg(F.when(F.col("__a") <= ends, x))).alias("trend"),
    )
    return got.withColumn("trend", F.when(F.col("n") > least, F.col("trend")).otherwise(0.0))


# Patterns on grids


def wave_grid(spark: SparkSession, frequency: float, seconds: float, size: int) -> DataFrame:
    """``i, j, v``: products of two sines over a square of ``seconds``, both ends included, brought to [0, 1]."""
    return interference_grid(spark, [frequency], [1.0], seconds, size)


def interference_grid(spark: SparkSession, frequencies: list[float], amplitudes: list[float], seconds: float, size: int) -> DataFrame:
    """``i, j, v``: the sum of wave grids by amplitude, clipped to [0, 1]."""
    i, j, step = F.floor(F.col("id") / size), F.col("id") % size, seconds / max(size - 1, 1)
    parts = [a * 0.5 * (F.sin(2 * math.pi * f * step * i) * F.sin(2 * math.pi * f * step * j) + 1) for f, a in zip(frequencies, amplitudes)]
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum(parts, F.lit(0.0))))
    return spark.range(size * size).select(i.alias("i"), j.alias("j"), v.alias("v"))


def binary_grid(spark: SparkSession, size: int, density: float, seed: int = 0) -> DataFrame:
    """``i, j, v``: ones at a share of the cells, the same in every rerun."""
    return spark.range(size * size).select(F.floor(F.col("id") / size).alias("i"), (F.col("id") % size).alias("j"), (keyed_uniform(F.col("id"), seed) < density).cast("double").alias("v"))


def noise(spark: SparkSession, n: int, amplitude: float = 1.0, kind: str = "uniform", seed: int = 0) -> DataFrame:
    """``i, v``: uniform noise in [-amplitude, amplitude) or gaussian with that deviation, the same in every rerun."""
    u, w = keyed_uniform(F.col("id"), seed), keyed_uniform(F.col("id"), seed + 1)
    if kind not in ("uniform", "gaussian"):
        raise ValueError(kind)
    v = 2 * amplitude * (u - 0.5) if kind == "uniform" else amplitude * F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * math.pi * w)
    return spark.range(n).select(F.col("id").alias("i"), v.alias("v"))


def text_waves(text: Column, phases: int = 4, fade: float = 0.1) -> Column:
    """For each character its code's 16 bits as a 4 x 4 grid, row by row, in ``phases`` slices.

    Slice t is the grid rolled by t along its rows, times 1 - t * ``fade`` (0 at least).
    Codes above 65,535 keep their last 16 bits.
    """

    def cell(code: Column, t: Column, at: Column) -> Column:
        source = F.floor(at / 4) * 4 + F.pmod(at - t, F.lit(4))
        bit = F.getbit(code, (15 - source).cast("int"))
        return bit * F.greatest(F.lit(0.0), 1.0 - t * fade)

    def waves(char: Column) -> Column:
        return V.let(F.ascii(char), lambda code: F.transform(F.sequence(F.lit(0), F.lit(phases - 1)), lambda t: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda at: cell(code, t, at))))

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(chars, waves)


def _basis(phases: int, n: int, scale: float, shift: float) -> np.ndarray:
    return scale * np.sin(2 * np.pi * np.outer(np.arange(phases) + shift, np.linspace(0, 1, n)))


def encode_wave(xs: Column, phases: int = 8, scale: float = 1.0, shift: float = 0.5) -> Column:
    """The values on ``phases`` sine waves along them, as one array for each wave."""

    @F.pandas_udf("array<array<double>>")
    def run(col: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else (_basis(phases, len(x), scale, shift) * np.asarray(x, dtype=float)).tolist() for x in col])

    return run(xs.cast("array<double>"))


def decode_wave(waves: Column, scale: float = 1.0, shift: float = 0.5) -> Column:
    """The values whose waves come nearest by least squares; 0 where every wave is 0."""

    @F.pandas_udf("array<double>")
    def run(col: pd.Series) -> pd.Series:
        out = []
        for w in col:
            if w is None:
                out.append(None)
                continue
            w = np.array([np.asarray(r, dtype=float) for r in w])
            basis = _basis(len(w), w.shape[1] if w.ndim > 1 else 0, scale, shift)
            size = (basis**2).sum(axis=0)
            out.append(np.where(size > 1e-12, (basis * w).sum(axis=0) / np.where(size > 1e-12, size, 1), 0.0).tolist())
        return pd.Series(out)

    return run(waves)


def delta_sigma(xs: Column) -> Column:
    """A signal in [-1, 1] as bits: each is 1 if the value with the weighted errors before it (1.5 and -0.5) is positive."""

    @F.pandas_udf("array<int>")
    def run(col: pd.Series) -> pd.Series:
        out = []
        for x in col:
            one, two, bits = 0.0, 0.0, []
            known = x is not None and not any(v is None or v != v for v in x)
            for v in x if known else []:
                v = v + 1.5 * one - 0.5 * two
                bits.append(int(v > 0))
                one, two = v - bits[-1], one + 0.5 * (v - bits[-1])
            out.append(bits if known else None)
        return pd.Series(out, dtype=object)

    return run(xs.cast("array<double>"))


def band_bits(bits: Column, low: float, high: float, rate: float, slack: float = 0.1) -> Column:
    """Bits of one band: the Hann-windowed signal of -1 and 1 under a response of fourth order
    around the band's middle, made bits again; a bit turns only ``slack`` beyond zero.
    """

    @F.pandas_udf("array<int>")
    def run(col: pd.Series) -> pd.Series:
        out = []
        for b in col:
            if b is None or len(b) < 2:
                out.append(None if b is None else [0] * len(b))
                continue
            x = (np.asarray(b, dtype=float) * 2 - 1) * np.hanning(len(b))
            response = 1 / (1 + ((np.fft.rfftfreq(len(x), 1 / rate) - (low + high) / 2) / ((high - low) / 2)) ** 4)
            y = np.fft.irfft(np.fft.rfft(x) * response, len(x))
            turns = np.where(y > slack, 1, np.where(y < -slack, 0, -1))  # -1: as before
            last = np.maximum.accumulate(np.where(turns >= 0, np.arange(len(y)), -1))
            out.append(np.where(last >= 0, turns[last], 0).tolist())
        return pd.Series(out)

    return run(bits)


def mean_phase(bits: Column) -> Column:
    """The mean phase of the analytic signal of bits as -1 and 1, from 0 to 2 pi."""

    @F.pandas_udf("double")
    def run(col: pd.Series) -> pd.Series:
        out = []
        for b in col:
            if b is None or not len(b):
                out.append(None)
                continue
            n = len(b)
            twice = np.where(np.arange(n) == 0, 1.0, np.where(np.arange(n) < (n + 1) // 2, 2.0, np.where((np.arange(n) == n // 2) & (n % 2 == 0), 1.0, 0.0)))
            z = np.fft.ifft(np.fft.fft(np.asarray(b, dtype=float) * 2 - 1) * twice)
            out.append(float(np.angle(z).mean() % (2 * np.pi)))
        return pd.Series(out)

    return run(bits)


def phase_to_pcm(phases: Column, magnitudes: Column | None = None) -> Column:
    """Samples of 16 bits from phases and magnitudes (1 if not given), by the inverse transform."""
    from sparkloom.operators.signal import fft, float_to_pcm

    sizes = magnitudes if magnitudes is not None else F.transform(phases, lambda _: F.lit(1.0))
    z = F.zip_with(phases, sizes, lambda p, m: F.struct((dbl(m) * F.cos(dbl(p))).alias("re"), (dbl(m) * F.sin(dbl(p))).alias("im")))
    return F.transform(fft(z, inverse=True), lambda v: float_to_pcm(v["re"]))


def match_pattern(template: Column, target: Column, shifts: int = 8) -> Column:
    """The roll of the template that is most like the target, by the product of both at length 1: ``similarity`` and ``shift``."""

    def at(a: Column, b: Column) -> Column:
        tried = F.transform(F.sequence(F.lit(0), F.lit(shifts - 1)), lambda s: F.struct(V.dot(V.roll(a, s), b).alias("similarity"), (-s).alias("s")))
        return V.let(F.array_max(tried), lambda best: F.struct(best["similarity"].alias("similarity"), (-best["s"]).alias("shift")))

    return V.let(V.normalize(template), lambda a: V.let(V.normalize(target), lambda b: at(a, b)))


def energy_history_stability(xs: Column) -> Column:
    """1 / (1 + deviation) of an array of energies; 1 for an empty one."""
    return F.when(F.size(xs) == 0, F.lit(1.0)).otherwise(1 / (1 + F.sqrt(V.variance(xs))))


#: The planes of four dimensions: xy, xz, xw, yz, yw, zw.
PLANES = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))


def rotate(xs: Column, angle: float, plane: int = 0) -> Column:
    """An array of four values turned by ``angle`` in one of ``PLANES``."""
    a, b = PLANES[plane]
    c, s = math.cos(angle), math.sin(angle)
    parts = [dbl(xs[i]) for i in range(4)]
    parts[a], parts[b] = c * dbl(xs[a]) - s * dbl(xs[b]), s * dbl(xs[a]) + c * dbl(xs[b])
    return F.array(*parts)
