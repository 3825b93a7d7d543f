"""Windows of series whose rows come late and out of order: list state and timers in event time.

Keys are dealt to shards, and a shard's rows wait in a list in the pieces in which they came, with a timer for the latest of each piece.
When a timer fires, all waiting rows that the watermark has passed are put in order and advance the series of the
shard together, in arrays.  So windows are those of the series in order, whatever the order of arrival, and
the state store is asked for pieces, not for rows.  A call holds a shard's waiting rows (those of a batch and of the lateness) and the ends of its series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from sparkloom.streaming.stride import SHARDS, TAILS, WINDOWS, advanced, shard_of


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of this application whose streams keep their state in RocksDB, which timers need; the caller's is left as it is.

    Every batch opens and commits the store of every partition, with rows or without, so a stream has as many as tasks run at a time.
    """
    own = spark.newSession()
    at_once = max(spark.sparkContext.defaultParallelism, SHARDS // 8)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    own.conf.set("spark.sql.shuffle.partitions", min(int(spark.conf.get("spark.sql.shuffle.partitions")), at_once))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own


COLUMNS = (("key", object), ("us", np.int64), ("at", np.int64), ("value", float))


def _packed(keys: np.ndarray, *numbers: np.ndarray) -> tuple:
    return (keys.tolist(), *(x.tobytes() for x in numbers))


class Series(StatefulProcessor):
    """Mean and energy of the whole windows of a shard's keys that start at multiples of the strides."""

    def __init__(self, width: int, strides: list[int], idle_ms: int | None):
        self.width, self.strides, self.idle = width, strides, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "keys array<string>, us binary, at binary, value binary")
        self.tails = handle.getValueState("tails", TAILS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for some in rows:
            self.waiting.appendValue(_packed(*(some[c].to_numpy(dtype=t) for c, t in COLUMNS)))
            self.handle.registerTimer(-(-int(some["us"].max()) // 1000))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        held = list(self.waiting.get())
        columns = [np.concatenate([np.frombuffer(h[c], dtype=t) if c else np.array(h[0], dtype=object) for h in held]) if held else np.zeros(0, dtype=t) for c, (_, t) in enumerate(COLUMNS)]
        due = columns[1] <= passed * 1000
        state = self.tails.get() if due.any() or self.idle is not None else None
        if due.any():
            keys, us, at, value = (x[due] for x in columns)
            order = np.lexsort((value, at, us))
            state, out = advanced(state, keys[order], value[order], us[order] // 1000, self.width, self.strides, self.idle)
            if due.all():
                self.waiting.clear()
            else:
                self.waiting.put([_packed(*(x[~due] for x in columns))])
            if len(out):
                yield out
        if state is not None and self.idle is not None:
            state = _without_idle(state, passed - self.idle)
            if state[0]:
                self.handle.registerTimer(int(np.frombuffer(state[3], dtype=np.int64).min()) + self.idle)
        if state is not None and state[0]:
            self.tails.update(state)
        elif state is not None:
            self.tails.clear()


def _without_idle(state: tuple, last: int) -> tuple:
    """The state of the keys that have had a row after ``last``."""
    seen, held, ms = (np.frombuffer(x, dtype=np.int64) for x in state[1:4])
    keep = ms > last
    tail = np.frombuffer(state[4], dtype=float)[np.repeat(keep, held)]
    return [k for k, some in zip(state[0], keep) if some], seen[keep].tobytes(), held[keep].tobytes(), ms[keep].tobytes(), tail.tobytes()


def late_windows(events: DataFrame, key: str, time: str, order: str, value: str, width: int, strides: list[int], late: str = "0 seconds", idle_ms: int | None = None, shards: int = SHARDS) -> DataFrame:
    """``key, stride, start, mean, energy`` of every whole window of ``width`` values of a key, in the order of ``time``, then ``order`` (a long).

    ``events`` is a stream of a :func:`stateful_session`.  Rows may come ``late`` by that much behind
    the latest time seen; later ones are dropped, as by any watermark.  Rows of a null key, time,
    order or value are no part of a series, but their times move the watermark.  After
    ``idle_ms`` without a row a series ends: its state goes, and a later row starts at place 0.
    """
    slim = events.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("time"), F.col(order).cast("long").alias("at"), F.col(value).cast("double").alias("value"))
    # The moment is null for rows outside any series.  As it needs the time, Spark leaves this filter above the watermark.
    whole = F.col("key").isNotNull() & F.col("at").isNotNull() & F.col("value").isNotNull()
    placed = slim.withWatermark("time", late).withColumn("us", F.when(whole, F.unix_micros("time"))).where("us IS NOT NULL").withColumn("shard", shard_of("key", shards))
    return placed.groupBy("shard").transformWithStateInPandas(Series(width, strides, idle_ms), WINDOWS, "append", "EventTime")
