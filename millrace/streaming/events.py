"""Event-time windows and token buckets, batch and streaming. An extension: the windows have no counterpart in a batch corpus system."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stamped(events: DataFrame) -> DataFrame:
    """events with `ts` as a timestamp, which watermarks ask for."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 day") -> DataFrame:
    rows = stamped(events).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "4 hours", step: str = "1 hour") -> DataFrame:
    rows = stamped(events).groupBy(F.window("ts", size, step), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    rows = stamped(events).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), "n")


def stream_tumbling(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """The tumbling windows of a stream, with a watermark for late rows."""
    rows = stamped(events).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n")


def token_bucket(events: DataFrame, per_minute: float = 120.0, key: str = "user_id", order: str = "event_id") -> DataFrame:
    """(event_id, allowed): a bucket for each key refills per_minute / 60 a second up to per_minute; an event takes one.

    Streams over each key's rows in order, holding one bucket.
    """
    rows = events.select(key, F.col("ts").cast("timestamp").cast("double").alias("at"), F.col(order))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, level, last = None, 0.0, 0.0
        for b in batches:
            out = []
            for k, at in zip(b[key], b["at"], strict=True):
                if k != who:
                    who, level, last = k, per_minute, at
                level, last = min(per_minute, level + (at - last) * per_minute / 60), at
                ok = level >= 1
                level -= ok
                out.append(ok)
            yield pd.DataFrame({order: b[order], "allowed": out})

    return rows.repartition(key).sortWithinPartitions(key, "at", order).mapInPandas(run, f"{order} long, allowed boolean")
