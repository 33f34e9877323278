"""What grows with the input: work done once for a row, and not again for each row or branch it meets."""

import hashlib
import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.functions import checks as K
from millrace.functions import text as X
from millrace.operators import clusters, graph, memory

SF = "/root/testdata/sf0.001"


def plan_of(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_densities_meet_no_join(spark):
    """Above a join a text's densities would be worked out for each category."""
    plan = plan_of(spark, "category_scores")
    assert plan.count("regexp_extract_all") == len(K.VOCABULARIES)
    assert plan.count("Join") == 1  # with the written texts


def test_word_hits(spark):
    texts = ["", "If then, THUS since_then if-then", "is  a is a entity; Part of", "API apis modules Module", "how to\nhow\tto", "steps step stepss", "Key ſteps if́ İf"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in K.VOCABULARIES.values():
        assert [tuple(x) for x in d.select(K.word_hits(F.col("t"), p)).collect()] == [tuple(x) for x in d.select(K.hits(F.col("t"), p)).collect()]


def test_known_near(spark):
    """Brute force's answers, and no row for each pair."""
    sets = [[f"w{(i * k) % 40}" for k in range(n)] for i in range(1, 12) for n in (0, 1, 13, 25)]
    sets = [sorted(set(s)) for s in sets] + [[f"w{k}" for k in range(24)], None]
    d = spark.createDataFrame(list(enumerate(sets)), "id long, toks array<string>")
    few = [[], [f"w{k}" for k in range(25)], ["w0", "w2"], None]
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
    got = memory.known_near(d, spark.createDataFrame([(s,) for s in few], "toks array<string>"), 0.92)
    want = {i: None if s is None else any(jaccard(s, f) >= 0.92 for f in few if f is not None) for i, s in enumerate(sets)}
    assert {x.id: x.known for x in got.collect()} == want and sum(map(bool, want.values())) > 2
    assert {x.known for x in memory.known_near(d, spark.createDataFrame([], "toks array<string>"), 0.92).collect()} == {None}


def test_kind_is_found_once(spark):
    """Seven patterns say what a memory is; they stand in the plan once."""
    for name in ("memory_importance", "admission_decision"):
        plan = plan_of(spark, name)
        assert plan.count("favorite") == 1 and plan.count("birthdate") == 1, name


def test_patterns_run_once(spark):
    """Triples of odd texts as both groups' own extraction finds them; each pattern stands in the plan once."""
    words = ["Rhine", "is", "part", "of", "a", "Basel", "created", "built", "named", "comes", "before", "has", "works", "at", "similar", "to", ".", ",", "contains", "Anna", "means", "an", "instance"]
    texts = ["", "IS is IS", "A\tis\nb c d", *[" ".join(words[(i * k + k // 3) % len(words)] for k in range(1, 40)) for i in range(1, 40)], "Bern causes\u00a0rain", "Oil \u212ais K is ok"]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(2)
    want = set()
    for relation, p in graph.TRIPLE_PATTERNS:
        for r in d.select("id", F.regexp_extract_all("text", F.lit(p), 1).alias("s"), F.regexp_extract_all("text", F.lit(p), 2).alias("o")).collect():
            for s, o in zip(r.s, r.o, strict=True):
                s, o = (x.strip(" \t\n\r\f\v")[:60] for x in (s, o))
                if len(s) > 2 and len(o) > 2:
                    want.add((r.id, s.lower(), relation, o.lower()))
    found = graph.extract_triples(d)
    got = [(x.id, x.subject.lower(), x.relation, x.object.lower()) for x in found.collect()]
    assert sorted(got) == sorted(want) and len(got) > 40
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == len(graph.TRIPLE_PATTERNS)


def test_likeness_is_worked_out_once(spark):
    assert plan_of(spark, "admission_policy").count("likeness(") == 1


def test_clusters_are_not_broadcast(spark):
    rows = [(i, f"c{i}", "in", f"n{i % 3}", 1.0) for i in range(60)]
    found = clusters.star_clusters(spark.createDataFrame(rows, "ord long, subject string, relation string, object string, confidence double"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted(r["size"] for r in found.collect()) == [20] * 60


def test_manifests_sort_no_texts(spark):
    """A smallest hash is no fixed-width buffer: in one aggregation with it whole texts would be sorted, as the hash's group."""
    plan = entry.queries()["source_manifests"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Sort [" in line or "Exchange" in line]
    assert moved and not any("text#" in line for line in moved)


def test_manifests_of_odd_texts(spark, tmp_path):
    texts = [None, "", "  ", "\t\n", "a b c d e f g", "a b c d e f g h", "a b c d e f g h", " a\tb\nc\rd\fe\x0bf  g h ", "a b c d e f g h", "é ü ß ö ä ñ ç 😀", "x" * 50_000 + " y" * 7, " " * 50_000]
    rows = [(i, t, s) for i, (t, s) in enumerate((t, s) for s in ("one", None, "two") for t in (texts if s != "two" else [None]))]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.source: tuple(r)[1:] for r in entry.queries()["source_manifests"](spark, str(tmp_path)).collect()}
    known = [t for t in texts if t is not None]
    n_words = [len([w for w in re.split(r"[ \t\n\r\f\x0b]+", t) if w]) for t in known]
    approved, hashes = sum(n >= 8 for n in n_words), {hashlib.sha256(t.encode()).hexdigest() for t in known}
    want = (12, sum(t.strip(" ") != "" for t in known), len(hashes), approved, round(approved * 100 / 12, 1), int(sum(len(t.encode()) for t in known) / 3.8), min(hashes))
    assert got["one"] == got[None] == want
    assert got["two"] == (1, 0, 0, 0, 0.0, None, None)
    words = spark.createDataFrame([(t,) for t in texts], "t string").select(*[F.coalesce(X.has_words(F.col("t"), n), F.lit(False)) == (F.size(X.words(F.col("t"))) >= n) for n in (1, 2, 7, 8, 9)])
    assert all(all(r) for r in words.collect())
