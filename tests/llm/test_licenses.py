"""Diagonal voting against a search for phrases and planted notices."""

import re

import numpy as np

from millrace.llm.licenses import TEMPLATES, Template, Vocabulary, Words, license_spans, windows

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    return WORD.findall((text or "").translate(LOW))


def places(words):
    """(label, start) of every place where a phrase's words stand."""
    return sorted((t.label, i) for t in TEMPLATES if t.phrase for i in range(len(words)) if words[i : i + len(t.words)] == t.words)


def test_words_are_the_patterns():
    texts = ["Ab-c 9Éİx y", "", "zz", "\x7f{a}[b]`c`", "日本 k9", "A", "a"]
    raw = [t.encode() for t in texts]
    low, starts, ends, hashes, counts = Words()(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    got = [low[s:e].tobytes().decode() for s, e in zip(starts, ends)]
    assert got == [w for t in texts for w in split(t)]
    assert counts.tolist() == [len(split(t)) for t in texts]
    assert len(set(hashes.tolist())) == len(set(got))
    v = Vocabulary(["c", "zz", "日本"])
    known = [w for w, c in zip(got, v.codes(low, starts, ends, hashes)) if c]
    assert known == [w for w in got if w in ("c", "zz", "日本")]


def test_windows_stay_within_texts():
    hashes, codes = np.arange(1, 8, dtype=np.uint64), np.arange(1, 8)
    text, first, _, _ = windows(3, hashes, codes, np.array([4, 0, 2, 1]))
    assert list(zip(text.tolist(), first.tolist())) == [(0, 0), (0, 1)]
    assert len(windows(9, hashes, codes, np.array([7]))[0]) == 0


def test_phrases(spark, odd):
    texts = ["CC BY cc by, cc-BY mit license", "GNU General\nPublic-License x gnu general public", None, "apache; license apache", "x " * 20_000 + "mit license"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, gram long").union(odd.select("doc_id", "text", F_zero()))
    got = sorted((str(r.doc_id), r.n_words, tuple((s.label, s.start) for s in sorted(r.spans, key=lambda s: (s.label, s.start)) if s.phrase)) for r in license_spans(df).collect())
    want = sorted((str(r.doc_id), len(split(r.text)), tuple(places(split(r.text)))) for r in df.collect())
    assert got == want


def F_zero():
    from pyspark.sql import functions as F

    return F.lit(0).cast("long")


def test_edited_notices_are_spans(spark):
    mit = next(t for t in TEMPLATES if t.label == "mit-grant").words
    filler = [f"w{i}" for i in range(30)]
    inserted = [*filler, *mit[:12], "kindly", "and", *mit[12:], *filler]  # neighbouring diagonals
    cut = [*filler, *mit[: len(mit) // 2], *filler]
    twice = [*mit, *filler, *mit]
    apart = [*mit[:15], *filler, *mit[15:]]  # too far apart to be one span
    rows = [(i, " ".join(w)) for i, w in enumerate((inserted, cut, twice, apart))]
    got = {r.doc_id: [(s.label, s.start, s.end) for s in r.spans if s.label == "mit-grant"] for r in license_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(mit)
    assert got == {0: [("mit-grant", 30, 32 + n)], 1: [], 2: [("mit-grant", 0, n), ("mit-grant", n + 30, 2 * n + 30)], 3: []}


def test_long_template(spark):
    """More windows than a block of votes holds."""
    words = [f"t{i % 90}q{i // 90}" for i in range(300)]
    long = Template("long", " ".join(words))
    rows = [("a", " ".join(["x", *words])), ("b", " ".join(words[:200]))]
    got = {r.doc_id: [(s.start, s.end, s.score) for s in r.spans] for r in license_spans(spark.createDataFrame(rows, "doc_id string, text string"), (long,)).collect()}
    assert got == {"a": [(1, 301, 1.0)], "b": []}


def test_empty(empty):
    assert license_spans(empty).collect() == []
