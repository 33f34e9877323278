"""Pairs that several shards share, the audit, and the exact way that is taken when it stays low."""

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F
from test_vectors import SCHEMA, brute

from millrace.llm.vectors import _search, audit_recall, vector_groups


def test_later_shard_finds():
    """Of a pair with two common shards, what only the second shard's search reaches is linked too."""
    x = np.eye(4)[[0, 0]] + [[0, 0, 0, 0], [0.01, 0.01, 0, 0]]
    shard = pa.table(
        {
            "rep": pa.array([5, 9], pa.int64()), "n": pa.array([2, 3], pa.int64()), "vec": [v.tobytes() for v in x], "shards": [[1, 2], [1, 2]], "shard": pa.array([2, 2], pa.int64()),
            "ci": [0, 0], "cj": [0, 0], "chunk": [0, 0], "chunks": [1, 1], "nbrs": pa.array([[9], [5]], pa.list_(pa.int64())),
        }
    )
    out = _search(0.98)(shard).to_pylist()
    assert [(r["a"], r["b"]) for r in out if r["b"] is not None] == [(5, 9)]
    lists = {r["a"]: np.frombuffer(r["more"], np.int64).tolist() for r in out if r["more"]}
    assert lists == {5: [9, 3], 9: [5, 2]}


def test_exact_way(spark):
    """A target that no graph reaches: every link is found, by comparing chunks."""
    rng = np.random.default_rng(11)
    hot = rng.normal(size=12)
    vectors = [(hot + rng.normal(size=12) * 0.12).tolist() for _ in range(260)] + [rng.normal(size=12).tolist() for _ in range(140)]
    rows = [(i, [float(np.float32(x)) for x in v], i % 2, "x") for i, v in enumerate(vectors)]
    want = brute(rows)
    got = vector_groups(spark.createDataFrame(rows, SCHEMA), shard=20, cap=64, target=1.01).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert sum(w[1] for w in want) > 1000


def test_audit_counts_small_classes_like_dense_ones(spark):
    """Half of a few small classes' links are lost: next to a dense group that is little of all links, but not of the classes."""
    v = lambda *x: np.array(x, dtype=float).tobytes()
    dense = [("a", i, 1, v(1, 0, 0)) for i in range(0, 100)]
    small = [("b", 1000 + 2 * i + k, 1, v(0, np.cos(i), np.sin(i))) for i in range(4) for k in (0, 1)]
    classes = spark.createDataFrame(dense + small, "label string, rep long, n long, vec binary")
    found = [(i, 99) for i in range(100)] + [(r, 1) for _, r, _, _ in small if r < 1004]
    links = spark.createDataFrame([(a, None, n) for a, n in found], "a long, b long, links long")
    share = audit_recall(classes, links, 108, 0.9999, sample=108)
    assert abs(share - 104 / 108) < 1e-9
    every = links.union(spark.createDataFrame([(r, None, 1) for _, r, _, _ in small if r >= 1004], "a long, b long, links long"))
    assert audit_recall(classes, every.withColumn("b", F.lit(None).cast("long")), 108, 0.9999, sample=108) == 1.0
