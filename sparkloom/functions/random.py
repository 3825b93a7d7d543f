"""Seeded random columns.

Those from a key hash the key, so reruns and lost executors give the same numbers; the
others use Spark's generator, which is seeded for each partition.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_uniform(key: Column, seed: int = 0) -> Column:
    """In [0, 1), from the first 13 hexadecimal digits of an md5."""
    digits = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / float(1 << 52)


def uniform(low: float = 0.0, high: float = 1.0, seed: int = 0) -> Column:
    return F.rand(seed) * (high - low) + low


def normal(mean: float = 0.0, std: float = 1.0, seed: int = 0) -> Column:
    return F.randn(seed) * std + mean


def bernoulli(p: float = 0.5, seed: int = 0) -> Column:
    return (F.rand(seed) < p).cast("int")


def exponential(scale: float = 1.0, seed: int = 0) -> Column:
    return -scale * F.ln(1 - F.rand(seed))


def categorical(logits: list[float], seed: int = 0) -> Column:
    """A class by its softmax share."""
    p = np.exp(np.array(logits) - max(logits))
    edges = np.cumsum(p / p.sum())
    return F.aggregate(F.array(*map(F.lit, edges[:-1].tolist())), F.struct(F.lit(0).alias("k"), F.rand(seed).alias("u")), lambda a, e: F.struct((a["k"] + (a["u"] >= e).cast("int")).alias("k"), a["u"].alias("u")), lambda a: a["k"])


def _drawn(key: Column, kind: str, draw) -> Column:
    @F.pandas_udf(kind)
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series([draw(np.random.default_rng(int(k))) for k in keys])

    return run(F.xxhash64(key).bitwiseAND(F.lit((1 << 62) - 1)))


def gamma(key: Column, shape: float = 1.0, scale: float = 1.0) -> Column:
    return _drawn(key, "double", lambda g: float(g.gamma(shape, scale)))


def poisson(key: Column, mean: float = 1.0) -> Column:
    return _drawn(key, "long", lambda g: int(g.poisson(mean)))


def glorot_uniform(fan_in: int, fan_out: int, gain: float = 1.0, seed: int = 0) -> Column:
    limit = gain * (6 / (fan_in + fan_out)) ** 0.5
    return uniform(-limit, limit, seed)
