"""Audit and run-log operators over event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
REQUIRED_STAGES = ("acquire", "validate", "normalize", "clean", "dedup", "score", "approve")


def activity(events: DataFrame, day_from: str | None = None, day_to: str | None = None) -> DataFrame:
    """Counts by event type, distinct users, first and last day, within inclusive ISO days."""
    day = F.date_format("ts", "yyyy-MM-dd")
    rows = events if day_from is None else events.where(day >= day_from)
    rows = rows if day_to is None else rows.where(day <= day_to)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def compliance(events: DataFrame, source: str, stage: str, ok, required: tuple[str, ...] = REQUIRED_STAGES) -> DataFrame:
    """For each source the stages done and missing, and whether none is missing."""
    done = F.array_sort(F.collect_set(F.when(ok, F.col(stage))))
    rows = events.groupBy(source).agg(done.alias("done"))
    return rows.withColumn("missing", F.array_sort(F.array_except(F.array(*map(F.lit, required)), "done"))).withColumn("compliant", F.size("missing") == 0)


def run_history(events: DataFrame, run: str, order: str, columns: list[str]) -> DataFrame:
    """The last non-null value of each column for each run, and its first and last order value."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return events.groupBy(run).agg(F.min(order).alias("opened"), F.max(order).alias("closed"), *last)


def union_logs(*logs: DataFrame) -> DataFrame:
    """Union of logs with whole-row dedup."""
    out = logs[0]
    for more in logs[1:]:
        out = out.unionByName(more)
    return out.distinct()
