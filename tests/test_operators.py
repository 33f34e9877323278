"""Literal-row vectors: formulas worked out by hand."""

import json
import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import audit, corpus, graph, memory, retrieval, similarity
from millrace.runtime import materialize
from millrace.sources import files
from millrace.streaming import events as stream


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], " ,".join(f"{k} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'string'}" for k, v in cols.items()))
    return df.select(expr.alias("x")).first()["x"]


def test_text(spark):
    t = F.col("t")
    assert one(spark, X.clean_text(t), t="<b>A</b>  see https://x.y/z “q” – end\n") == 'A see "q" - end'
    assert one(spark, X.approx_tokens(t), t=" \n ") == 0
    assert one(spark, X.shingles(X.tokens(t)), t="a b c") == ["a b c"]
    assert one(spark, X.shingles(X.tokens(t), 2), t="a b a b c") == ["a b", "b a", "b c"]
    assert one(spark, X.entropy(t), t="aabb") == 1.0 and one(spark, X.entropy(t), t="") == 0.0
    assert one(spark, X.jaccard(F.array(), F.array()), t="") == 1.0
    assert tuple(one(spark, X.language_en(t), t="zz the")) == ("en", 0.55, False)
    assert tuple(one(spark, X.language_en(t), t="zz yy")) == ("unknown", 0.5, True)
    assert one(spark, X.typed_redaction(t), t="mail a.b@c.de key=1 secret = hush") == "mail [email] key=1 secret =[REDACTED]"
    assert one(spark, X.class_labels(t), t="the python function and code of a chapter") == ["Programming", "Books"]
    assert one(spark, corpus.top_share(F.col("w")), w=["a", "a", "b", "c", "d"]) == pytest.approx(0.8)
    assert one(spark, retrieval.rewrite_query(t, F.col("h")), t="what is it for", h="we met Alice in Paris today") == "what is Paris for"


def test_percentile(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "v long")
    assert corpus.nearest_rank(df, "v", {"p": 0.9}).first()["p"] == 4


def test_simhash(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "b", "b"],)], "t array<string>").select(similarity.simhash("t").alias("x"))
    got = [r.x for r in df.collect()]
    import hashlib

    assert got[0] == 0 and got[1] & (2**64 - 1) == int(hashlib.md5(b"a").hexdigest()[16:], 16) and got[2] & (2**64 - 1) == int(hashlib.md5(b"b").hexdigest()[16:], 16)


def test_hamming_pairs(spark):
    base = 0x123456789ABCDEF0
    fps = [base, base ^ 1, base ^ (1 | 1 << 20 | 1 << 40), base ^ 0xF, base ^ (1 << 62)]
    got = {(r.fp_a, r.fp_b): r.distance for r in similarity.hamming_pairs(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    assert got == {(min(a, b), max(a, b)): (a ^ b).bit_count() for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3}


def test_keep_first_is_sequential(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "doc_id long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (4, 5)], "a long, b long")
    assert sorted(r.doc_id for r in similarity.keep_first_near(nodes, edges, materialize).collect()) == [0, 2, 4]


def test_graph(spark):
    seen = spark.createDataFrame([("a", 1, 0.7), ("a", 2, 0.7), ("b", 1, 0.4)], "s string, i long, confidence double")
    assert [tuple(r) for r in graph.fold_confidence(seen, ["s"], ["i"]).collect()] == [("a", 0.805, 2)]
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4)], "id long, parent long")
    assert {r.id: (r.depth, r.cyclic) for r in graph.ancestors(tree).collect()} == {1: (0, False), 2: (1, False), 3: (2, False), 4: (None, True), 5: (None, True)}
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(20)] + [(50, 51), (51, 52), (52, 50), (53, 50), (60, 99)], "id long, parent long")
    walked = {r.id: (r.depth, r.cyclic) for r in graph.ancestors(chain).collect()}
    assert walked == {i: (i, False) for i in range(20)} | {i: (None, True) for i in (50, 51, 52, 53)} | {60: (0, False)}
    t = spark.createDataFrame([("x", "r", "p", 0.9), ("x", "r", "q", 0.6)], "subject string, relation string, object string, confidence double")
    assert graph.contradictions(t).first()["preferred"] == "p"
    assert graph.ranked_triples(t, ["x", "p"]).first()["score"] == pytest.approx(0.96)


def test_memory(spark):
    assert one(spark, memory.kind(F.col("t")), t="I prefer tea") == "preference"
    assert one(spark, memory.kind(F.col("t")), t="thing") == "fact"
    assert one(spark, memory.decayed(F.lit(1.0), F.lit(45.0)), t="") == 0.5
    no, d = F.lit(False), F.lit
    assert one(spark, memory.admit(d(1.0), d(0.9), no, no, no, d(0.0), no), t="") == "rejected_exact_duplicate"
    assert one(spark, memory.admit(d(0.9), d(0.9), no, no, d(True), d(0.0), no), t="") == "admitted_preference_change"
    assert one(spark, memory.admit(d(0.0), d(0.1), no, d(True), no, d(0.0), no), t="") == "rejected_low_value"
    assert one(spark, memory.admit(d(0.0), d(0.1), no, no, no, d(0.0), no), t="") == "admitted_novel"


def test_audit(spark):
    e = spark.createDataFrame([("s", "clean", True), ("s", "dedup", False)], "src string, stage string, ok boolean")
    r = audit.compliance(e, "src", "stage", F.col("ok")).first()
    assert r.done == ["clean"] and len(r.missing) == 6 and not r.compliant


def test_ranking(spark):
    r = spark.createDataFrame([(1, 2, True), (1, 1, False), (2, 1, False)], "query_id long, rank int, relevant boolean")
    n = spark.createDataFrame([(1, 1), (2, 1)], "query_id long, n long")
    got = retrieval.ranking_metrics(r, n).first()
    assert (got.mrr, got.mean_rank, got.hit_rate) == (0.25, 6.5, 0.5) and got.ndcg == pytest.approx(0.5 / math.log2(3), abs=1e-6)


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("plain\ntext")
    (tmp_path / "sub" / "b.json").write_text(json.dumps({"x": ["one", {"y": "two"}], "n": 1}))
    (tmp_path / "c.jsonl").write_text('{"a": "p"}\nbad line\n')
    (tmp_path / "d.csv").write_text("h1,h2\n1, \n")
    (tmp_path / "e.bin").write_text("no")
    got = {r.path.rpartition("/")[2]: r.text for r in files.read_texts(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.txt": "plain\ntext", "b.json": "one\ntwo", "c.jsonl": "p\nbad line", "d.csv": "h1 h2\n1"}
    assert files.list_files(spark, f"file://{tmp_path}").count() == 4


def test_write_new(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, v string")
    path = f"file://{tmp_path}/out"
    assert files.write_new(df, path).count() == 2
    assert files.write_new(df, path).count() == 2


def test_stream(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    spark.sql("select timestamp_ntz'2024-01-01 00:10:00' ts, 'a' event_type, 1.0D value union all select timestamp_ntz'2024-01-02 00:10:00', 'a', 2.0D").write.parquet(src)
    rows = spark.readStream.schema("ts timestamp_ntz, event_type string, value double").parquet(src)
    q = stream.stream_tumbling(rows).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select * from windows").count() == 2


def test_token_bucket(spark):
    df = spark.sql("select id event_id, 1L user_id, timestamp_seconds(id) ts from range(6)")
    got = [r.allowed for r in stream.token_bucket(df, 2.0).orderBy("event_id").collect()]
    assert got == [True, True, False, False, False, False]


def test_chunks(spark):
    t = "One two three four. " * 60
    got = spark.createDataFrame([(t,)], "t string").select(retrieval.chunk_texts()("t").alias("c")).first()["c"]
    assert all(len(c) <= 520 for c in got) and got[1].startswith("four. One")
