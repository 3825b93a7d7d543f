"""Streams: windowed aggregates with a watermark, and stateful strided windows.

The state holds the last ``width - 1`` values of each key and a count, whatever arrives, so each
whole window comes out exactly once over all batches.  Keys are dealt to ``shards`` by a hash; a
shard's keys have one state and are advanced together in arrays, so a batch costs a call for each
shard, not for each key.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOWS = "key string, stride int, start long, mean double, energy double"


def windowed(events: DataFrame, time: str, key: str, value: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum of each key and tumbling window, closed once the watermark has passed."""
    w = events.withWatermark(time, late).groupBy(F.window(time, size), key)
    return w.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


SHARDS = 64
#: Of the keys of a shard: their rows so far, the number of values held, the moment of the last one, and the values.
TAILS = "keys array<string>, seen binary, held binary, last binary, tail binary"


def shard_of(key: str, shards: int):
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def advanced(state: tuple | None, keys: np.ndarray, values: np.ndarray, ms: np.ndarray | None, width: int, strides: list[int], idle_ms: int | None = None) -> tuple[tuple, pd.DataFrame]:
    """A shard's state (``TAILS``) after some rows, and the windows that they end; the rows of a key stand in its order.

    A row ``idle_ms`` or more after the one before it in ``ms`` begins a new series.
    """
    old = list(state[0]) if state else []
    seen, held, last = (np.frombuffer(x, dtype=np.int64) for x in (state[1:4] if state else (b"",) * 3))
    tail = np.frombuffer(state[4] if state else b"", dtype=float)
    codes, names = pd.factorize(np.concatenate([np.array(old, dtype=object), keys]), use_na_sentinel=False)
    ms = np.zeros(len(keys), dtype=np.int64) if ms is None else ms
    code = np.concatenate([np.repeat(codes[: len(old)], held), codes[len(old) :]])
    order = np.argsort(code, kind="stable")
    code, new = code[order], order >= len(tail)
    v, at = np.concatenate([tail, values])[order], np.concatenate([np.repeat(last, held), ms])[order]
    n, place = len(v), np.arange(len(v))
    first = np.append(True, code[1:] != code[:-1])[:n]
    begins = first.copy()
    if idle_ms is not None:
        begins[1:] |= at[1:] - at[:-1] >= idle_ms
    base = np.zeros(len(names), dtype=np.int64)
    base[codes[: len(old)]] = seen - held
    part = np.cumsum(begins) - 1
    place = place - place[begins][part] + np.where(first, base[code], 0)[begins][part]
    out, whole = [], max(0, n - width + 1)
    mean, energy = np.zeros(whole), np.zeros(whole)
    for k in range(width):
        mean, energy = mean + v[k : k + whole], energy + v[k : k + whole] ** 2
    ends = (part[:whole] == part[width - 1 :][:whole]) & new[width - 1 :][:whole]
    for s in strides:
        some = np.flatnonzero(ends & (place[:whole] % s == 0))
        out.append(pd.DataFrame({"key": names[code[some]], "stride": np.int32(s), "start": place[some], "mean": mean[some] / width, "energy": energy[some]}))
    end = np.flatnonzero(np.append(code[1:] != code[:-1], True)[:n])  # the last row of each code, in the order of codes
    keep = (end[code] - np.arange(n) < max(width - 1, 1)) & (part == part[end][code])
    after = (place[end] + 1, np.bincount(code[keep], minlength=len(names)), at[end])
    return ([None if x != x else x for x in names], *(x.astype(np.int64).tobytes() for x in after), v[keep].tobytes()), pd.concat(out)


def strided(events: DataFrame, key: str, order: str, value: str, width: int, strides: list[int], shards: int = SHARDS) -> DataFrame:
    """Mean and energy of every whole window that starts at a multiple of a stride.

    Values of a key are taken in order inside a batch; a batch's rows come after those of
    the batches before it.  A task holds a batch's rows of one shard.
    """

    def run(k: tuple, batches: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order)
        after, out = advanced(state.get if state.exists else None, rows[key].to_numpy(dtype=object), rows[value].to_numpy(dtype=float, na_value=np.nan), None, width, strides)
        state.update(after)
        yield out

    slim = events.select(F.col(key).cast("string").alias(key), order, value)
    return slim.withColumn("__shard", shard_of(key, shards)).groupBy("__shard").applyInPandasWithState(run, WINDOWS, TAILS, "append", "NoTimeout")


def batches_of(rows: int, most: int, several: int, worth: int = 1 << 16) -> int:
    """Batches of at most ``most`` rows; of fewer, down to those ``worth`` the fixed cost of a batch, if there would not be ``several``."""
    return max(1, -(-rows // most), min(several, -(-rows // worth)))


def in_order(rows: DataFrame, order: str, path: str, most: int = 1 << 20, several: int = 1) -> DataFrame:
    """A stream over ``rows`` in batches of about ``most`` (fewer, for ``several`` batches of enough rows), each after the one before it in ``order``.

    The rows are written to ``path`` in ranges of ``order``; file sources read by time of
    modification, so the files are given theirs in the order of the ranges.
    """
    spark, parts = rows.sparkSession, batches_of(rows.count(), most, several)
    rows.repartitionByRange(parts, F.col(order).asc_nulls_last()).write.parquet(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda f: int(f.getName().split("-")[1]))
    last = int(time.time()) * 1000
    for i, f in enumerate(files):
        fs.setTimes(f, last - (len(files) - 1 - i) * 1000, -1)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run what is there to its end, however long that takes, into a table at ``path``."""
    q = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
