"""Operators on streams with timed state: what a key holds goes when it no longer counts.

All need the RocksDB state store (``with_rocksdb``). Rows of one key in one batch are taken in order of
time and then of their tie-breaker; rows behind the watermark are dropped.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def with_rocksdb(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def _seconds(ts: datetime.datetime) -> float:
    return ts.timestamp()


class SlidingLimiter(StatefulProcessor):
    """At most ``most`` admitted rows of a key within ``window`` seconds. The key's state, its admitted times, is dropped by a timer once the watermark has passed the last of them by the window."""

    def __init__(self, most: int, window: float) -> None:
        self.most, self.window = most, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.passed = handle.getListState("passed", "t double")

    def _arm(self, passed: list[float]) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if passed:
            self.handle.registerTimer(int((passed[-1] + self.window) * 1000) + 1)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        passed = [t for (t,) in self.passed.get()] if self.passed.exists() else []
        for row in sorted(rows, key=lambda r: (r["ts"], r["tie"])):
            now = _seconds(row["ts"])
            passed = [t for t in passed if now - t < self.window]
            allowed = len(passed) < self.most
            if allowed:
                passed.append(now)
            yield Row(key=key[0], ts=row["ts"], tie=row["tie"], allowed=allowed)
        if passed:
            self.passed.put([(t,) for t in passed])
        else:
            self.passed.clear()
        self._arm(passed)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.passed.clear()
        yield from ()

    def close(self) -> None:
        pass


def rate_limited(stream: DataFrame, key: str, ts: str, tie: str, most: int, window: float, late: str = "10 minutes") -> DataFrame:
    """``key, ts, tie, allowed``: the sliding-window limiter on event time (``ts``: a timestamp). ``tie`` orders rows of one time."""
    kinds = dict(stream.dtypes)
    rows = stream.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(tie).alias("tie")).withWatermark("ts", late)
    return rows.groupBy("key").transformWithState(SlidingLimiter(most, window), f"key {kinds[key]}, ts timestamp, tie {kinds[tie]}, allowed boolean", "Append", "EventTime")


class ExpiringMap(StatefulProcessor):
    """Of each key a map of entries that expire ``ttl_ms`` after they were last set, by the store itself: ``set`` rows enter, ``ask`` rows say whether the entry is there."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "entry string", "since double", self.ttl_ms)
        self.asked = handle.getValueState("asked", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        asked = (self.asked.get() or (0,))[0] if self.asked.exists() else 0
        for row in sorted(rows, key=lambda r: r["tie"]):
            entry = (row["entry"],)
            if row["op"] == "set":
                self.entries.updateValue(entry, (float(timerValues.getCurrentProcessingTimeInMs()),))
                continue
            asked += 1
            yield Row(key=key[0], tie=row["tie"], entry=row["entry"], listed=self.entries.containsKey(entry), asked=asked)
        self.asked.update((asked,))

    def close(self) -> None:
        pass


def listed_with_ttl(stream: DataFrame, key: str, entry: str, op: str, tie: str, ttl_ms: int) -> DataFrame:
    """``key, tie, entry, listed, asked``: for each ``ask`` row, whether its entry was set within the last ``ttl_ms`` (processing time), and how often the key has been asked."""
    kinds = dict(stream.dtypes)
    rows = stream.select(F.col(key).alias("key"), F.col(entry).cast("string").alias("entry"), F.col(op).alias("op"), F.col(tie).alias("tie"))
    return rows.groupBy("key").transformWithState(ExpiringMap(ttl_ms), f"key {kinds[key]}, tie {kinds[tie]}, entry string, listed boolean, asked bigint", "Append", "ProcessingTime")
