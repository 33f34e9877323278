"""Every stage on odd rows and on an empty table, and what the stages decide."""

import pytest

import corpus_pipeline as p

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = f"file://{tmp_path_factory.mktemp('sf')}"
    body = " ".join(f"word{i}" for i in range(60))
    data = [(i, f"Clean text {i} about topic {i * 7} with its own line {i * 13}.\nAnd one more line {i}{i}, alone.", "en", f"src{i % 4}", 60) for i in range(80)]
    data += [(100 + i, f"You are a grobno{e} and a grobno{e}{e}, {i}.", "en", "src1", 30) for i, e in enumerate("abcdefghij" * 4)]
    data += [(300, body, "en", "src2", len(body)), (301, body, "en", "src2", len(body)), (302, body.replace("word5 ", "other "), "en", "src0", len(body)), (400, None, None, None, None), (401, "", "de", "src9", 0), (None, "no id here at all", "fr", None, 3)]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 140)) for i in range(140)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns and docs.dtypes == spark.read.parquet(f"{sf}/documents.parquet").dtypes
        seen[name] = {r.doc_id for r in docs.collect()}
    assert not seen["toxicity"] & set(range(100, 140)) and set(range(80)) <= seen["toxicity"]
    assert 301 not in seen["line dedup"] and 400 in seen["line dedup"]
    assert 302 not in seen["simhash near-dedup"] or 300 in seen["simhash near-dedup"]
    assert set(range(80)) <= seen["mixing"] == seen["simhash near-dedup"]
    out = p.run(spark, sf).collect()
    assert {r.doc_id for r in out} == seen["mixing"]


def test_empty(spark, sf):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in p.STAGES:
        assert stage(spark, none, sf).count() == 0
