"""Operators that work in rounds against the sequential folds they stand for."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from test_inverted import brute as bm25_brute

from millrace.functions import text as X
from millrace.operators import clusters, corpus, graph, hops, memory, similarity
from millrace.runtime import materialize


def star_fold(triples, min_size):
    """The reference rule, one entity after another."""
    held = {}
    for _, s, r, o, c in sorted(triples, key=lambda t: t[0]):
        if None not in (s, r, o, c) and c >= 0.5:
            held.setdefault(s, set()).add((r, o))
            held.setdefault(o, set()).add((r, s))
    taken, out = set(), set()
    for e in held:
        if e not in taken:
            group = {e} | {x for x in held if x not in taken and held[e] & held[x]}
            if len(group) >= min_size:
                taken |= group
                out |= {(e, x, len(group)) for x in group}
    return out


@pytest.mark.parametrize(("entities", "facts", "min_size"), [(40, 60, 3), (120, 90, 3), (60, 150, 2), (50, 40, 5)])
def test_star_clusters(spark, entities, facts, min_size, monkeypatch):
    monkeypatch.setattr(clusters, "HUB", 5)  # many salts
    r = random.Random(entities)
    rows = [(i, f"e{r.randrange(entities)}", f"r{r.randrange(3)}", f"e{r.randrange(entities)}", r.choice((0.4, 0.7, 1.0))) for i in range(facts)]
    rows += [(1000 + i, f"e{r.randrange(entities)}", "hub", "centre", 0.9) for i in range(entities // 8)] + [(2000, None, "r0", "e1", 0.9), (2001, "e1", "r0", "e2", None), (2002, "e3", "r1", "e3", 0.8)]
    t = spark.createDataFrame(rows, "ord long, subject string, relation string, object string, confidence double")
    found = clusters.star_clusters(t, min_size)
    assert {tuple(x) for x in found.select("center", "entity", "size").collect()} == star_fold(rows, min_size)
    members = {}
    for x in found.collect():
        members.setdefault(x.center, set()).add(x.entity)
    want = {c: sorted({r for _, s, r, o, p in rows if p and p >= 0.5 and (s in m or o in m)})[:10] for c, m in members.items()}
    assert {x.center: x.relations for x in clusters.cluster_relations(t, found).collect()} == want


def test_no_triples(spark):
    none = spark.createDataFrame([], "ord long, subject string, relation string, object string, confidence double")
    assert clusters.star_clusters(none).collect() == []


def fill_fold(tokens, target, most):
    chunk, held, count, out = 0, 0, 0, []
    for n in tokens:
        if count and (held + n > target or count >= most):
            chunk, held, count = chunk + 1, 0, 0
        held, count = held + n, count + 1
        out.append(chunk)
    return out


@pytest.mark.parametrize(("target", "most", "block"), [(60, 4, 4), (25, 10, 13), (10_000, 7, 50), (5, 3, 3), (300, 1000, 1000)])
def test_chunk_fill(spark, target, most, block):
    r = random.Random(target)
    docs = [(i, " ".join(["w"] * r.choice((0, 1, 3, 8, 40)))) for i in range(157)] + [(900, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    order = sorted(docs, key=lambda d: hashlib.sha256(f"42:{d[0]}".encode()).hexdigest())
    keys = {x.doc_id: x.h for x in df.select("doc_id", X.stable_rank(df["doc_id"], 42).alias("h")).collect()}
    assert [d for d, _ in order] == sorted(keys, key=keys.get)
    want = dict(zip([d for d, _ in order], fill_fold([len((t or "").split()) for _, t in order], target, most), strict=True))
    assert {x.doc_id: x.chunk_index for x in corpus.chunk_fill(df, target, most, block=block).collect()} == want


def test_chunk_fill_empty(spark):
    assert corpus.chunk_fill(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_deep_chain(spark):
    """10,000 steps in under 20 rounds, and a circle of odd length with a tail."""
    rows = [(i, i - 1 if i else None) for i in range(10_001)] + [(20_000 + i, 20_000 + (i + 1) % 7) for i in range(7)] + [(30_000, 20_003), (None, 1), (40_000, 99_999)]
    rounds, write = [], graph.materialize

    def count(df, tag):
        rounds.append(tag)
        return write(df, tag)

    graph.materialize = count
    try:
        got = {r.id: (r.depth, r.cyclic) for r in graph.ancestors(spark.createDataFrame(rows, "id long, parent long")).collect()}
    finally:
        graph.materialize = write
    assert rounds.count("walks") < 20
    assert got == {i: (i, False) for i in range(10_001)} | {20_000 + i: (None, True) for i in range(7)} | {30_000: (None, True), 40_000: (0, False)}


def evidence_fold(questions, corpora, loops, enough):
    evidence, rounds = [], []
    for q, question in questions:
        question = question or ""
        text, seen, total = question, set(), 0
        for hop in range(loops):
            found = [(leg, r, d, s, (dict(docs)[d] or "")[:300]) for leg, docs in enumerate(corpora) for _, d, r, s in bm25_brute(docs, [(0, text)], 3)]
            new = []
            for row in sorted(found):
                if row[4][:80] not in seen:
                    seen.add(row[4][:80])
                    new.append((q, hop, *row[:3]))
            words = set(re.findall("[a-z]{4,}", question.lower())) - {w for f in found for w in re.findall("[a-z]{4,}", f[4].lower())}
            gap, total = sorted(words)[:5], total + len(new)
            evidence += new
            rounds.append((q, hop, len(new), total, gap))
            if total >= enough or not gap:
                break
            text = " ".join([question, *gap[:3]])
    return sorted(evidence), sorted(rounds)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    words = ["".join(r.choices("abcde", k=r.randint(3, 6))) for _ in range(60)]
    make = lambda n: [(i, " ".join(r.choices(words, k=r.choice((4, 9, 30))))) for i in range(n)]
    docs, turns = make(80), make(40)
    docs += [(500, docs[0][1]), (501, docs[0][1] + " more"), (502, None), (503, "")]
    questions = [(i, " ".join(r.choices(words, k=7))) for i in range(10)] + [(20, None), (21, "zzzz yyyy xxxx"), (22, docs[1][1])]
    return docs, turns, questions


def test_evidence_loop(spark, texts):
    docs, turns, questions = texts
    leg = lambda rows: hops.text_leg(spark.createDataFrame(rows, "id long, text string"), 3)
    evidence, rounds = hops.evidence_loop(spark.createDataFrame(questions, "query_id long, text string"), [leg(docs), leg(turns)], 4, 9)
    want = evidence_fold(questions, [docs, turns], 4, 9)
    assert sorted((r.query_id, r.hop, r.found, r.coverage, r.gap) for r in rounds.collect()) == want[1]
    assert sorted((r.query_id, r.hop, r.leg, r["rank"], r.id) for r in evidence.collect()) == want[0]
    assert max(r[1] for r in want[1]) == 3 and any(r[1] == 0 and not r[4] for r in want[1])


def hop_fold(docs, questions, k):
    def vector(text):
        out = np.zeros(64)
        for w in (text or "").lower().split():
            out[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64] += 1
        return out

    held = {d: vector(t) for d, t in docs}

    def leg(text):
        q = vector(text)
        dense = sorted((-round(float(q @ v) / ((np.linalg.norm(q) + 1e-9) * (np.linalg.norm(v) + 1e-9)), 6), d) for d, v in held.items())[:24]
        sparse = {d: s for _, d, _, s in bm25_brute(docs, [(0, text)], 24)}
        most = max([*sparse.values(), 1e-9])
        fused = {d: -s for s, d in dense}
        both = sorted((-round(0.7 * fused.get(d, 0.0) + 0.3 * sparse.get(d, 0.0) / most, 6), d) for d in fused.keys() | sparse.keys())[:15]
        return [(d, -s) for i, (s, d) in enumerate(both) if -s >= 0.25 or i == 0]

    out, texts = {}, {d: t or "" for d, t in docs}
    for q, question in questions:
        seen, merged = set(), []
        for d, s in leg(question or ""):
            if texts[d][:80] not in seen:
                seen.add(texts[d][:80])
                merged.append((d, 1, s))
        best, merged = merged[0][2], merged[:5]
        for hop in (1, 2):
            if best < 0.25 + 0.1 * hop and len(merged) >= hop:
                again = " ".join(re.findall("[a-zA-Z]{4,}", texts[merged[hop - 1][0]])[:8])
                if again:
                    new, now = [], set(seen)
                    for d, s in leg(again)[:3]:
                        if texts[d][:80] not in now:
                            now.add(texts[d][:80])
                            new.append((d, hop + 1, s))
                    seen = now
                    merged += new
        out[q] = merged[:k]
    return out


def test_hop_search(spark, texts):
    docs, _, questions = texts
    questions = [*questions, *[(30 + i, f"aaaaaaa{i} bbbbbbb{i} ccccccc{i} {docs[i][1].split()[0]}") for i in range(6)]]
    leg = hops.hybrid_leg(spark.createDataFrame(docs, "id long, text string"), 15)
    got = {}
    for r in sorted(hops.hop_search(spark.createDataFrame(questions, "query_id long, text string"), [leg], 5).collect(), key=lambda r: (r.query_id, r.place)):
        got.setdefault(r.query_id, []).append((r.id, r.hop, r.score))
    want = hop_fold(docs, questions, 5)
    assert got.keys() == want.keys()
    for q in want:
        assert [x[:2] for x in got[q]] == [x[:2] for x in want[q]], q
        assert np.allclose([x[2] for x in got[q]], [x[2] for x in want[q]], atol=2e-6)
    assert Counter(x[1] for v in want.values() for x in v)[2] > 0


def consolidate_fold(rows, least):
    kept, uses = [], {}
    for i, importance, n, toks in sorted(rows, key=lambda r: (-round((r[1] or 0.0) * 1_000_000), r[0])):
        near = [k for k, t in kept if toks and t and len(t & set(toks)) / len(t | set(toks)) >= least]
        if near:
            uses[near[0]] += n or 0
        else:
            kept.append((i, set(toks)))
            uses[i] = n or 0
    return uses


def test_consolidate(spark):
    r = random.Random(6)
    base = [r.sample("abcdefghijklmnop", r.choice((5, 9, 10))) for _ in range(6)]
    rows = []
    for i in range(-30, 60):
        toks = list(r.choice(base))
        if r.random() < 0.5:
            toks[r.randrange(len(toks))] = r.choice("qrst")
        rows.append((i, r.choice((0.1, 0.5, 0.9, None)), r.choice((1, 3, None)), sorted(set(toks))))
    rows += [(100, 0.9, 2, []), (101, 0.9, 2, [])]
    df = spark.createDataFrame(rows, "id long, importance double, uses int, toks array<string>")
    assert {x.id: x.uses for x in memory.consolidate(df).collect()} == consolidate_fold(rows, 0.8)


def source_fold(rows, least=0.85):
    """Every pair of texts of different sources by their signatures."""
    flat = {i: " ".join((t or "").lower().split()) for i, _, t in rows}
    slots = similarity.Slots()
    sig = {i: slots.least(sorted({t[k : k + 5] for k in range(len(t) - 4)} or {t})) for i, t in flat.items() if t}
    band = lambda a, b: any((a[k : k + 4] == b[k : k + 4]).all() for k in range(0, 128, 4))
    by = {i: s or "" for i, s, _ in rows}
    gone = {j for i in sig for j in sig if by[i] < by[j] and band(sig[i], sig[j]) and (sig[i] == sig[j]).mean() >= least}
    return {i: i not in gone for i in sig}


def test_cross_source_duplicates(spark):
    r = random.Random(9)
    words = ["".join(r.choices("abcdefg", k=5)) for _ in range(200)]
    texts = [" ".join(r.choices(words, k=60)) for _ in range(12)]
    rows = []
    for i in range(90):
        t = r.choice(texts).split()
        for _ in range(r.choice((0, 0, 1, 3, 12))):
            t[r.randrange(60)] = r.choice(words)
        rows.append((i, r.choice(("A", "B", "C", None)), " ".join(t)))
    rows += [(200, "B", "abc"), (201, "C", " ABC "), (202, "A", " "), (203, "A", None)]
    df = spark.createDataFrame(rows, "id long, source string, text string")
    got = {x.id: x.kept for x in similarity.cross_source_duplicates(df, materialize).collect()}
    assert got == source_fold(rows)
    assert 0 < sum(got.values()) < len(got)
