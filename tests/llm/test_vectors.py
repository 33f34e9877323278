"""Vector links and components against brute force."""

import numpy as np
import pytest

from millrace.llm.vectors import robust_prune, vector_groups

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows):
    n = len(rows)
    unit = []
    for i, v, label, _ in rows:
        a = np.array(v, dtype=float) if v and None not in v else np.zeros(1)
        good = i is not None and label is not None and np.isfinite(a).all() and a.any()
        unit.append(a / np.linalg.norm(a) if good else None)
    link = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98] for i in range(n)]
    seen, comp = {}, [None] * n
    for i in sorted((k for k in range(n) if rows[k][0] is not None), key=lambda k: rows[k][0]):
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in seen:
                seen[k] = rows[i][0]
                todo += link[k]
    return [(rows[i][0], len(link[i]), seen.get(i)) for i in range(n)]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(7)
    out, i = [], 0
    for label in (0, 1, 2):
        for _ in range(60):
            c = rng.normal(size=16)
            for _ in range(int(rng.integers(1, 7))):
                out.append((i, (c + rng.normal(size=16) * 0.07).tolist(), label, "x"))
                i += 1
    hot = rng.normal(size=16)
    out += [(i + k, hot.tolist(), 1, "x") for k in range(50)] + [(i + 50 + k, (hot + rng.normal(size=16) * 0.05).tolist(), 1, "x") for k in range(120)]
    i += 170
    out += [(i, None, 1, None), (i + 1, [0.0] * 16, 1, None), (i + 2, [1.0, None], 1, None), (i + 3, [float("nan")] * 16, 1, None), (i + 4, hot.tolist(), None, None), (None, hot.tolist(), 1, None), (i + 5, [1e-30] * 16, 0, None), (i + 6, [1e30] * 16, 0, None), (i + 7, [], 0, None), (i + 8, [1.0], 0, None)]
    return out


@pytest.mark.parametrize("shard,cap", [(600, 2000), (40, 2000), (600, 25)])
def test_groups(spark, vectors, shard, cap):
    df = spark.createDataFrame([(a, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c, d) for a, v, c, d in vectors], SCHEMA)
    rows = [(r.vec_id, r.embedding, r.label, None) for r in df.collect()]
    want = {w[0]: w for w in brute(rows)}
    got = vector_groups(df, shard=shard, cap=cap).collect()
    assert len(got) == len(rows)
    links = sum(w[1] for w in want.values())
    found = sum(r.n_links for r in got)
    assert all(r.n_links <= want[r.vec_id][1] for r in got)
    assert found >= 0.97 * links
    if (shard, cap) != (40, 2000):
        assert {r.vec_id: r.component_id for r in got} == {k: w[2] for k, w in want.items()}
    assert all(r.kept == (r.vec_id == r.component_id or r.vec_id is None) for r in got)


def test_prune():
    x = np.random.default_rng(0).normal(size=(50, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    adj = robust_prune(x, degree=6)
    assert adj.shape == (50, 6) and all(i not in a for i, a in enumerate(adj.tolist()))
    assert (adj[:, 0] == np.where(np.eye(50, dtype=bool), -2, x @ x.T).argmax(1)).all()
    assert (robust_prune(x[:1]) == -1).all()


def test_empty(spark):
    assert vector_groups(spark.createDataFrame([], SCHEMA)).count() == 0
