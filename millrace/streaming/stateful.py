"""Folds over streams whose result depends on the order of events: token buckets and confidences.

A processor holds a key's rows in list state until the watermark has passed them,
and folds them then, in event order, into one value; so rows that arrive in any
order within the watermark's delay give what the batch folds give, and rows later
than that are dropped by Spark. A key has one timer: for its earliest waiting row,
or, when nothing waits and the fold allows it, for the time from which its value
is that of a new key, which is then forgotten. State and timers are in the query's
checkpoint, so a stopped query goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State of this kind needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class InOrder(StatefulProcessor):
    """Folds a key's rows (at, id, x) in the order of (at, id); `at` is in seconds."""

    #: Seconds without rows after which a key is as good as new; None: never.
    idle: float | None = None
    state: str
    out: tuple[str, ...]

    def __init__(self, keys: tuple[str, ...]) -> None:
        self.keys = keys

    def step(self, value: tuple | None, at: float, x: float) -> tuple[tuple, tuple]:
        """(the new value, the row that goes out) after one event; value is None for a new key."""
        raise NotImplementedError

    def last(self, value: tuple) -> float:
        """When the value's last event was."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at double, id long, x double")
        self.value = handle.getValueState("value", self.state)
        self.timer = handle.getValueState("timer", "ms long")

    def _wake(self, ms: int | None) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if ms is not None:
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [(float(a), int(i), float(x)) for b in rows for a, i, x in zip(b["at"], b["id"], b["x"], strict=True)]
        if new:
            idle = not self.waiting.exists()  # then a timer only waits for the key to be forgotten
            self.waiting.appendList(new)
            ms = int(min(new)[0] * 1000) + 1
            if idle or not self.timer.exists() or ms < self.timer.get()[0]:
                self._wake(ms)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.timer.clear()  # this one is spent
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get())
        due = [r for r in rows if r[0] * 1000 < passed]
        rest = rows[len(due) :]
        value = tuple(self.value.get()) if self.value.exists() else None
        out = []
        for at, id_, x in due:
            value, made = self.step(value, at, x)
            out.append((*key, id_, *made))
        if due:
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
            self.value.update(value)
        if rest:
            self._wake(int(rest[0][0] * 1000) + 1)
        elif self.idle is not None and value is not None:
            end = int((self.last(value) + self.idle) * 1000) + 1
            if end <= passed:
                self.value.clear()
            else:
                self._wake(end)
        if out:
            yield pd.DataFrame(out, columns=[*self.keys, "id", *self.out])


class Bucket(InOrder):
    """A bucket of `per_minute` tokens that refills evenly; an event takes one. A minute without events fills it."""

    state, out, idle = "level double, at double", ("allowed",), 61.0

    def __init__(self, keys: tuple[str, ...], per_minute: float) -> None:
        super().__init__(keys)
        self.per_minute = per_minute

    def step(self, value: tuple | None, at: float, x: float) -> tuple[tuple, tuple]:
        level, before = value or (self.per_minute, at)
        level = min(self.per_minute, level + (at - before) * self.per_minute / 60)
        allowed = level >= 1
        return (level - allowed, at), (allowed,)

    def last(self, value: tuple) -> float:
        return value[1]


class Confidence(InOrder):
    """c <- round(min(1, c + (1 - c) x / 2), 4) over a triple's observations; the first is taken as it is."""

    state, out = "confidence double, mentions long", ("confidence", "mentions")

    def step(self, value: tuple | None, at: float, x: float) -> tuple[tuple, tuple]:
        if value is None:
            new = (x, 1)
        else:
            raised = Decimal(repr(min(1.0, value[0] + (1 - value[0]) * x * 0.5)))
            new = (float(raised.quantize(Decimal("0.0001"), ROUND_HALF_UP)), value[1] + 1)
        return new, new


def _folded(events: DataFrame, fold: InOrder, schema: str, id_col: str, x: Column, late: str) -> DataFrame:
    use_rocksdb(events.sparkSession)
    ts = F.col("ts").cast("timestamp")
    rows = events.select(*fold.keys, ts.alias("ts"), ts.cast("double").alias("at"), F.col(id_col).alias("id"), x.cast("double").alias("x")).withWatermark("ts", late)
    return rows.groupBy(*fold.keys).transformWithStateInPandas(fold, schema, "append", "eventTime")


def stream_token_bucket(events: DataFrame, per_minute: float = 120.0, key: str = "user_id", order: str = "event_id", late: str = "1 hour") -> DataFrame:
    """(key, id, allowed) of a stream of events, when the watermark has passed them: `token_bucket`, streamed."""
    return _folded(events, Bucket((key,), per_minute), f"{key} long, id long, allowed boolean", order, F.lit(0.0), late)


def stream_confidence(events: DataFrame, keys: list[str], value: Column, order: str = "event_id", least: float = 0.5, late: str = "1 hour") -> DataFrame:
    """(keys, id, confidence, mentions) after each observation of a stream, in event order; values under `least` are refused."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "id long, confidence double, mentions long"])
    return _folded(events.where(value >= least), Confidence(tuple(keys)), schema, order, value, late)


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Fold what has arrived and stop; called again with the same folders it goes on from there."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
