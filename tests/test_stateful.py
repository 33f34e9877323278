"""Stateful streams against the batch folds: rows in any order, a stop in between, late rows, forgotten keys."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import graph
from millrace.streaming import events as batch
from millrace.streaming import stateful

SCHEMA = "event_id long, user_id long, event_type string, value double, ts timestamp"
START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    out, at = [], 0.0
    for i in range(240):
        at += r.choice((0.0, 0.5, 4.0, 90.0))
        out.append((i, r.randrange(4), r.choice("ab"), r.choice((0.3, 0.6, 0.9)), START + timedelta(seconds=at)))
    return out


def write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def end(days=30):
    return [(-1, -1, "end", 1.0, START + timedelta(days=days))]


def run(spark, parts, folder, fold):
    """Each part arrives, is folded, and the query stops."""
    base = f"file://{folder}"
    for part in parts:
        write(spark, part, f"{base}/in")
        stream = fold(spark.readStream.schema(SCHEMA).parquet(f"{base}/in"))
        stateful.drain(stream, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{base}/out").where("user_id <> -1")


def test_token_bucket(spark, rows, tmp_path):
    """Two parts that overlap in time by less than the delay, each in random order."""
    want = {x.event_id: x.allowed for x in batch.token_bucket(spark.createDataFrame(rows, SCHEMA), 3.0).collect()}
    first, second = rows[:130], rows[120:130] and rows[130:]
    swapped = [*first[:110], *second[:5]], [*first[110:], *second[5:]]
    for part in swapped:
        random.Random(1).shuffle(part)
    got = run(spark, [*swapped, end()], tmp_path, lambda e: stateful.stream_token_bucket(e, 3.0, late="2 hours")).collect()
    assert len(got) == len(rows) and {x.id: x.allowed for x in got} == want
    assert len(set(want.values())) == 2


def test_late_rows_are_dropped(spark, tmp_path):
    late = [(99, 1, "a", 0.5, START)]
    parts = [[(1, 1, "a", 0.5, START + timedelta(hours=5))], [(2, 1, "a", 0.5, START + timedelta(hours=9))], late, end()]
    got = run(spark, parts, tmp_path, lambda e: stateful.stream_token_bucket(e, 3.0, late="1 hour")).collect()
    assert sorted(x.id for x in got) == [1, 2]


def test_confidence(spark, rows, tmp_path):
    keys = ["user_id", "event_type"]
    seen = spark.createDataFrame(rows, SCHEMA).withColumn("confidence", F.col("value"))
    want = {(x.user_id, x.event_type): (x.confidence, x.mentions) for x in graph.fold_confidence(seen, keys, ["ts", "event_id"]).collect()}
    got = run(spark, [rows[:100], rows[100:], end()], tmp_path, lambda e: stateful.stream_confidence(e, keys, F.col("value"), late="2 hours"))
    last = {}
    for x in got.collect():
        last[x.user_id, x.event_type] = max(last.get((x.user_id, x.event_type), (0, 0)), (x.mentions, x.confidence))
    assert {k: (c, n) for k, (n, c) in last.items()} == want
