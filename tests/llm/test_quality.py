"""Statistics against brute force; the model tells junk from prose without labels."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from millrace.llm.quality import BAD, GOOD, HIGH, LOW, PRIOR, PULL, ROUNDS, fit_accuracies, judge, rule_votes, text_stats

WORD = r"[^\x20\x09-\x0D]+"


def slow(t):
    t = t or ""
    w = re.findall(WORD, t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), dup, len(covered)


def test_stats(frame, odd):
    more = frame([(1, "a b c d e a b c d e", "", "", 0, 0, ""), (2, "x " * 12, "", "", 0, 0, ""), (3, "a b c d e f\n\na b c d e f\nz\x0by\na b c d e f", "", "", 0, 0, "")])
    for df in (odd, more):
        want = sorted(((r.doc_id, *slow(r.text)) for r in df.collect()), key=repr)
        have = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in text_stats(df).collect()), key=repr)
        assert have == want


def test_judgement(frame, empty):
    prose = "The quick brown fox number {0} jumps over lazy dog {0}. It rests then near the river and looks at all of the boats {0}. Evening comes slowly now."
    junk = "###THE&&& $$$FOX%%% !!!NUMBER*** {0}||| ###JUMPS&&& $$$OVER%%% !!!LAZY*** {0}||| ###DOG&&& $$$AND%%% !!!RESTS*** HERE!!! ###NOW&&& $$$THEN%%% !!!GONE***"
    data = [(i, (junk if i % 10 == 0 else prose).format(i), "", "", 0, 0, "") for i in range(200)]
    got = {r.doc_id: r.kept for r in judge(frame(data)).collect()}
    assert all(k == (i % 10 != 0) for i, k in got.items())
    assert judge(empty).count() == 0


def em(votes, counts, k):
    """EM in numpy over a histogram of votes: (prior, good, bad), shares by rule of votes -1, 0, 1."""
    n, start = counts.astype(float), [np.tile(s, (k, 1)) for s in (GOOD, BAD)]
    prior, good, bad = PRIOR, *start
    onehot = (votes[:, :, None] == np.array([-1, 0, 1])).astype(float)
    pull = PULL * n.sum() + 1
    for _ in range(ROUNDS):
        q = posterior(onehot, prior, good, bad)
        prior = max(LOW, min(HIGH, (n * q).sum() / max(1.0, n.sum())))
        good, bad = (((w[:, None, None] * onehot).sum(0) + pull * s) / (w.sum() + pull) for w, s in zip((n * q, n * (1 - q)), start, strict=True))
    return prior, good, bad


def posterior(onehot, prior, good, bad):
    return 1 / (1 + np.exp(-(np.log(prior) - np.log(1 - prior) + (onehot * (np.log(good) - np.log(bad))).sum((1, 2)))))


def test_em_is_numpys(spark):
    rng = np.random.default_rng(4)
    truth = rng.random(400) < 0.8
    votes = np.where(truth[:, None], rng.choice([-1, 0, 1], (400, 5), p=[0.05, 0.15, 0.8]), rng.choice([-1, 0, 1], (400, 5), p=[0.6, 0.2, 0.2]))
    fit = fit_accuracies(spark.createDataFrame([(v.tolist(),) for v in votes], "v array<int>"), 5).first()
    kinds, counts = np.unique(votes, axis=0, return_counts=True)
    prior, good, bad = em(kinds, counts, 5)
    assert np.isclose(fit["prior"], prior) and np.allclose(fit["good"], good.ravel()) and np.allclose(fit["bad"], bad.ravel())


def test_posterior_and_verdict(frame, odd):
    texts = ["Plain words stand here in a row and say a thing or two about the boats. They end well.", "WHY!!! ###WHAT$$$ ***NOW*** |||", "same words again same words again same words again same words again same words again same words", "short"]
    df = frame([(i, texts[i % 4] + f" {i}", "", "", 0, 0, "") for i in range(120)])
    for table in (df, odd):
        rules = rule_votes()
        rows = text_stats(table).select("doc_id", "n_words", "n_repeat_words", F.array(*rules.values()).alias("v")).collect()
        votes = np.array([r.v for r in rows])
        kinds, counts = np.unique(votes, axis=0, return_counts=True)
        q = posterior((votes[:, :, None] == np.array([-1, 0, 1])).astype(float), *em(kinds, counts, len(rules)))
        want = sorted(((r.doc_id, round(float(p), 6), not (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and bool(p >= 0.5)) for r, p in zip(rows, q, strict=True)), key=repr)
        assert sorted(((r.doc_id, round(r.posterior, 6), r.kept) for r in judge(table).collect()), key=repr) == want
