"""Distance keys against comparing every anchor with every row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.hard_negatives import mine_negatives

SCHEMA = "vec_id long, label int, embedding array<float>, cell string, KEY int"


def brute(rows, positives=5, negatives=10):
    fit = [(i, c, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, c, v in rows if None not in (i, c, v) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for anchor in sorted({i for i, *_ in fit if i % 100 == 0}):
        _, label, q = min(r for r in fit if r[0] == anchor)
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i, c) for i, c, v in fit if i != anchor)
        for s, p, _ in [r for r in scored if r[2] == label][:positives]:
            bad = [(n, -t) for t, n, c in scored if c != label and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(anchor, p, k, n, -s, t) for k, (n, t) in enumerate(bad[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted(map(tuple, mine_negatives(df, F.col("label"), F.col("vec_id") % 100 == 0, **kw).collect()))


@pytest.mark.parametrize("spread", [0.02, 0.3])
def test_clusters(spark, spread):
    """Small samples and cells: bounds are loose, several rounds are needed; tight clusters let annuli leave cells out."""
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 16))
    middles /= np.linalg.norm(middles, axis=1)[:, None]
    which = rng.integers(12, size=700)
    vectors = middles[which] + spread * rng.normal(size=(700, 16))
    rows = [(i, int(w % 4), v.tolist()) for i, (w, v) in enumerate(zip(which, vectors))]
    rows += [(1000 + i, 1, rows[5][2]) for i in range(250)]  # a hot vector, more than a cell holds
    want = brute(rows)
    assert want and mined(spark, rows, pivots=8, sample=50, cell=16) == want
    assert mined(spark, rows) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.1]), (2, 2, [0.6, 0.0]), (3, 2, [0.6, 0.0]), (3, 2, [0.6, 0.0]), (4, None, [1.0, 0.0]), (5, 2, None), (6, 2, [0.5, None]), (7, 2, [nan, 0.0]), (8, 2, [inf, 0.0]), (None, 2, [0.5, 0.5]), (9, 2, [0.5]), (10, 2, []), (11, 1, [-1.0, 0.0]), (0, 1, [1.0, 0.0]), (100, 3, [0.0, 0.0])]
    got = mined(spark, rows)
    assert got == [(0, 1, 1, 2, 65536, 39168), (0, 1, 2, 3, 65536, 39168), (0, 1, 3, 3, 65536, 39168), (0, 1, 4, 9, 65536, 32768)]


def test_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, None, [1.0])]) == []
