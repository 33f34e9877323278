"""Fingerprints and components against brute force."""

import re

import numpy as np
import xxhash

from millrace.llm.components import connected_components
from millrace.llm.simhash import fingerprint, hamming_links, near_dedup, simhash_groups

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return [find(i) for i in range(n)]


def test_fingerprint():
    for t in (None, "", " \n", "One", "a b c", "a b c d", "a b c d e", "É É é x y z A", "same " * 50, "a\x0bb\x1cc d e f g h"):
        assert fingerprint(t) == slow(t), t


def test_groups(spark, odd):
    rows = [(r.doc_id, slow(r.text)) for r in odd.collect()]
    prints = sorted({f for _, f in rows})
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    comp = dict(zip(prints, roots(len(prints), links), strict=True))
    want = [(d, f, min((x for x, g in rows if comp[g] == comp[f] and x is not None), default=None)) for d, f in rows]
    have = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash_groups(odd).collect()]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    kept = near_dedup(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {c for d, _, c in want if d is not None} | {None}


def test_links_lose_nothing(spark):
    """Planted chains at every distance, and a bucket over its block size."""
    rng = np.random.default_rng(5)
    fps = set()
    for _ in range(120):
        x = int(rng.integers(0, 2**63))
        fps.add(x)
        for d in (1, 2, 3, 4, 5):
            y = x
            for b in rng.choice(64, d, replace=False):
                y ^= 1 << int(b)
            fps.add(y)
    fps = sorted(fps)
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    want = roots(len(fps), links)
    signed = [f - (f >> 63 << 64) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for block in (4096, 3):
        edges = [(signed.index(r.a), signed.index(r.b)) for r in hamming_links(df, block=block).distinct().collect()]
        assert roots(len(fps), edges) == want
        assert all((fps[i] ^ fps[j]).bit_count() <= 4 for i, j in edges)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 160)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty(empty):
    assert simhash_groups(empty).count() == 0 and near_dedup(empty).count() == 0
