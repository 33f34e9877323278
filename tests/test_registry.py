"""The registry, stages that resume, strategies, and token ids."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.functions import tokenize
from millrace.operators import registry
from millrace.operators.attempts import STRATEGIES, perturbed


@pytest.fixture(scope="module")
def records(spark):
    rows = [("s1", "One", "A", 0.1, "x"), ("s2", "Two", "B", None, "x"), ("s2", "Again", "B", 0.2, "x"), (None, "none", "A", 0.1, "x"), ("s3", "Three", "A", 0.3, "x"), ("s4", None, None, None, "x")]
    return registry.register(spark.createDataFrame(rows, "source_id string, name string, category string, licence_risk double, EXTRA string"))


def test_register(records):
    got = {r.source_id: r for r in records.collect()}
    assert got.keys() == {"s1", "s2", "s3", "s4"} and got["s2"].name == "Again"
    assert all(r.status == "pending" and r.approved_tokens_est == 0 and not r.source_validated for r in got.values())
    assert records.columns == registry.NAMES


def test_events(spark, records):
    events = [
        (1, "s1", "validate", "ann", "d1", None, None, "fine"), (2, "s1", "approve", "bob", "d2", 10, 500, None), (3, "s1", "look", "eve", "d3", 1, 1, "no"),
        (5, "s2", "validate", "ann", "d1", None, None, "fine"), (6, "s2", "reject", "bob", "d2", None, None, "licence"), (4, "s2", "approve", "eve", "d0", 3, 30, None), (7, "nobody", "approve", "x", "d", 1, 1, None),
    ]
    schema = "at int, source_id string, action string, by string, day string, paragraphs long, tokens long, note string"
    got = {r.source_id: r for r in registry.updated(records, spark.createDataFrame(events, schema)).collect()}
    assert (got["s1"].status, got["s1"].source_validated, got["s1"].validated_by, got["s1"].approved_by, got["s1"].approved_tokens_est, got["s1"].notes) == ("approved", True, "ann", "bob", 500, "fine")
    assert (got["s2"].status, got["s2"].source_validated, got["s2"].validated_by, got["s2"].validation_date, got["s2"].approved_paragraphs, got["s2"].notes) == ("rejected", False, "bob", "d2", 3, "licence")
    assert got["s3"].status == "pending" and got.keys() == {"s1", "s2", "s3", "s4"}
    assert [r.source_id for r in registry.listed(registry.updated(records, spark.createDataFrame(events, schema)), "A", "approved").collect()] == ["s1"]
    assert registry.listed(records).count() == 4


def test_saved_registry_shows_changes(spark, records, tmp_path):
    path = f"file://{tmp_path}/registry"
    found = registry.save(records, path)
    assert registry.save(records.orderBy(F.desc("source_id")).repartition(3), path) == found
    assert sorted(map(tuple, registry.load(spark, path).collect()), key=repr) == sorted(map(tuple, records.collect()), key=repr)
    records.withColumn("status", F.when(F.col("source_id") == "s3", "approved").otherwise(F.col("status"))).write.mode("overwrite").json(f"{path}/sources")
    with pytest.raises(ValueError, match="was changed"):
        registry.load(spark, path)


def test_cleaning_resumes(spark, tmp_path):
    docs = spark.createDataFrame([(i, f" text {i} ", 7) for i in range(10)] + [(10, None, 7)], "doc_id long, text string, _done int")
    path = f"file://{tmp_path}/out"
    first = registry.cleaned_once(spark, docs.where("doc_id < 4"), path, F.trim)
    assert sorted(map(tuple, first.collect())) == [(i, 8, 6) for i in range(4)]
    again = registry.cleaned_once(spark, docs, path, F.trim)
    assert sorted(r.doc_id for r in again.collect()) == list(range(4, 11))
    assert registry.cleaned_once(spark, docs, path, F.trim).collect() == []
    assert spark.read.parquet(path).count() == 11


def test_strategies(spark):
    rows = [(1, "chunk", 1), (1, "chunk", 2), (1, "memory", 1), (2, "memory", 1), (2, "memory", 2), (3, "fact", 1)]
    got = {}
    for r in perturbed(spark.createDataFrame(rows, "q long, kind string, nth int")).collect():
        got.setdefault((r.q, r.strategy), set()).add((r.kind, r.nth))
    for q in (1, 2, 3):
        own = {(k, n) for p, k, n in rows if p == q}
        for name, kind in STRATEGIES.items():
            focus = {x for x in own if x[0] == kind}
            assert got[q, name] == ({x for x in own if x[1] == 1} if name == "thin_evidence" else focus or own)


def test_token_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Plain words.", "", None, "naïve <|endoftext|> 日本\n\t x", "a" * 5000]
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string").select("i", "text", tokenize.ids(F.col("text"), path).alias("ids"))
    got = {r.i: r for r in df.select("*", tokenize.decoded(F.col("ids"), path).alias("back")).collect()}
    for i, x in enumerate(texts):
        assert got[i].ids == t.encode(x or "", add_special_tokens=False).ids and got[i].back == (x or "")
