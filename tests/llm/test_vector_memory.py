"""A dense shard is searched with memory for a bit and not for many numbers a pair."""

import tracemalloc

import numpy as np
import pyarrow as pa

from millrace.llm.vectors import _build, _search


def test_dense_shard():
    r = np.random.default_rng(1)
    n = 900
    x = r.normal(size=16) + 0.02 * r.normal(size=(n, 16))
    t = pa.table({"rep": np.arange(n), "n": np.ones(n, np.int64), "vec": [v.tobytes() for v in x], "shards": [[1]] * n, "chunk": np.zeros(n, np.int64), "chunks": np.ones(n, np.int64)})
    t = t.append_column("nbrs", _build(t)["nbrs"])
    tracemalloc.start()
    out = _search(0.98)(t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(v or 0 for v in out["links"].to_pylist()) == n * (n - 1)
    assert peak < 32 * n * n
