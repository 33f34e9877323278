"""Metrics of texts at the edges: ratios between two values of six digits, and empty, null and one-character texts, as the SQL has them."""

import duckdb

import __spark_entry__ as entry


def test_metrics_at_ties(spark, tmp_path):
    """n letters or digits in a text of 640 or 3,200 characters: at some n the two engines' own rounding differs."""
    texts = [("a" * n + "5" * (size - n)) for size, step in ((640, 2), (3200, 26)) for n in range(1, size, step)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(["", None, "\n", " ", "éé", "😀😀a", "a\n\na\n", *texts])]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{path}/*.parquet'")
    want = duck.sql(entry.oracle_sql()["quality_metrics"])
    got = entry.queries()["quality_metrics"](spark, str(tmp_path))
    plain = lambda rs: sorted(tuple(map(str, r)) for r in rs)
    assert plain(tuple(r[c] for c in want.columns) for r in got.collect()) == plain(want.fetchall())
