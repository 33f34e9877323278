"""Toxicity, language and lattice models: exact parts by brute force, learned parts on held-out rows."""

import math
import os
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from millrace.llm.langid import WIDTHS, ByteCNN, fit_language, predict_language, to_windows
from millrace.llm.lattice import END, Lattice, score_documents
from millrace.llm.toxicity import CASCADE, PAID, Grammar, Transducer, compose, fit_grammar, grammar_machine, learn_stems, score_toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_composition_equals_the_cascade_by_brute_force():
    rng = np.random.default_rng(3)
    machine = grammar_machine()
    for _ in range(300):
        weights = tuple(rng.normal(0, 1, 1 + len(PAID)))
        clause = "".join(rng.choice(list("ihtnr"), rng.integers(0, 9)))
        paths = [(clause, 0.0)]  # all the outputs of one transducer after the other, with their weights
        for t in CASCADE:
            out = []
            for symbols, weight in paths:
                states = [("", 0, weight)]
                for s in symbols:
                    states = [(o + x, n, w + sum(weights[1 + k] for k in p)) for o, q, w in states for x, p, n in t.arcs[q].get(s, ())]
                out += [(o, w) for o, _, w in states]
            paths = out
        best, paid = machine.best(clause, weights)
        assert np.isclose(best, max(w for _, w in paths)) and np.isclose(best, sum(n * w for n, w in zip(paid, weights[1:], strict=True)))


def test_compose_follows_every_path():
    two = Transducer(({"i": (("I", (0,), 0), ("t", (2,), 1))}, {"i": (("t", (), 1),)}))
    tail = Transducer(({"I": (("I", (1,), 0),), "t": (("t", (), 0), ("t", (3,), 0))},))
    both = compose(two, tail)
    assert both.best("i", (0, 1, 1, 1, 9, 0)) == (10.0, (0, 0, 1, 1, 0)) and both.best("i", (0, 5, 5, 1, 1, 0)) == (10.0, (1, 1, 0, 0, 0))


def test_clauses():
    g = Grammar(words=frozenset(["idiot"]), stems=frozenset(["moro"]))
    paid = lambda t: {k: n for k, n in zip(PAID, g.reader().read(t)[1], strict=True) if n}
    assert paid("you are an Idiot.") == {"insult": 1, "target": 1} == paid("an idiot, you")
    assert paid("You idiotic thing. lovely moronic!") == {"insult": 1}
    assert paid("you are not an idiot") == {"insult": 1, "target": 1, "negated": 1}
    assert paid("they said idiot. Idiot") == {"insult": 2, "target": 1, "reported": 1}
    assert paid("I will kill you") == {"threat": 1, "target": 1} and paid("kill the process") == {"threat": 1}
    assert paid(None) == paid("") == paid("a clean sentence about you, idio, xidiot") == {}
    assert g.score("you idiot") > g.score("an idiot") > g.score("not an idiot") > g.score("")
    assert paid("a " * 100_000 + "idiot " * 3 + "x " * 100_000) == {"insult": 3}


def test_stems_reach_unseen_endings():
    texts = [f"plain words here {i} lowland lower" for i in range(60)] + [f"words lowei{e} here" for e in ("an", "ei", "tum", "chen", "ung", "isch")]
    assert learn_stems(texts, [0] * 60 + [1] * 6) == ({"lowei"}, frozenset())


def test_similar_lines_are_one_piece_of_evidence():
    word = lambda i, j: "".join(chr(97 + int(d)) for d in str(i * 97 + j * 31 + 1000))
    clean = [" ".join(f"{word(i, j)}" for j in range(12)) for i in range(90)]
    copied = "qqra qqrb qqrc qqrd qqre qqrf qqrg qqrh qqri qqrj"
    toxic = [f"{copied} zz{chr(97 + i)}" for i in range(10)] + [f"{word(i, 5)}k grobno{chr(97 + i)} {word(i, 7)}k" for i in range(10)]
    assert learn_stems(clean + toxic, [0] * 90 + [1] * 20) == ({"grobno"}, frozenset())


SEEDED = """
import random
from millrace.llm.toxicity import Lines
r = random.Random(3)
words = ["".join(r.choices("abcdefghij", k=r.randint(3, 9))) for _ in range(300)]
lines = [" ".join(r.choices(words, k=9)) for _ in range(400)]
rows = []
for i in range(1200):  # many similar lines: which of them counts decides what is learned
    some = r.choice(lines).split()
    some[r.randrange(9)] = r.choice(words)
    rows.append((" ".join(some + (["grobn" + r.choice("aeiou"), "plix"] if i % 3 == 0 else [])), int(i % 3 == 0), i % 2))
found = Lines(rows)
print(len(found.toxic), [sorted(s) for half in (None, 0, 1) for s in found.insults(half)])
"""


def test_grammar_is_the_same_in_any_process():
    run = lambda seed: subprocess.run([sys.executable, "-c", SEEDED], env=os.environ | {"PYTHONHASHSEED": seed, "PYTHONPATH": os.getcwd()}, capture_output=True, text=True, check=True).stdout
    assert "grobn" in run("0") and run("0") == run("1") == run("2")


def test_fit_ignores_the_order_of_rows(spark, frame):
    data = [(i, f"you {'grobnik' if i % 4 == 0 else 'kindly'} number w{i % 37} of w{i % 11}\nw{i % 5} other line", "en", "s", 1, 1, "x") for i in range(300)]
    labels = [(i, int(i % 4 == 0)) for i in range(300)]
    fit = lambda step: fit_grammar(frame(data[::step]).repartition(3), spark.createDataFrame(labels[::step], "doc_id long, toxic int"))
    assert fit(1) == fit(-1)


def test_toxicity(spark, frame, odd, empty):
    rng = np.random.default_rng(1)
    some = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(6))
    data = [(i, some() if i % 4 else f"{some()}. you are a grobno" + "abcdefghij"[i % 10] + f" {some()}", "en", "s", 0, 0, "") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    g = fit_grammar(frame(data), labels)
    out = score_toxicity(frame(data).withColumn("_toxic", F.lit(1)), g)
    assert out.columns[-3:] == ["_toxic", "toxic_score", "toxic_paid"]
    assert all((r.toxic_score >= 0.5) == (r.doc_id % 4 == 0) for r in out.collect())
    score = lambda t: g.score(t)
    assert score("you grobnox") > score("such grobnox") > score("not grobnox") >= score("nothing") < score("kill it")
    none = fit_grammar(odd, labels.limit(0))
    assert score_toxicity(odd, none).count() == odd.count() and score_toxicity(empty, none).count() == 0


def test_network_gradients_and_tables():
    rng = np.random.default_rng(0)
    net = ByteCNN.start(["a", "b"], rng)
    x = rng.integers(1, 256, (3, 256)).astype(np.uint8)
    y = np.array([0, 1, 1])
    h, _ = net.pooled(x, net.tables())
    e = net.embed[x]
    direct = np.concatenate([np.stack([sum(e[:, t : 256 - w + 1 + t] @ f[t] for t in range(w))]).max(2)[0] + b for w, f, b in zip(WIDTHS, net.filters, net.bias, strict=True)], 1)
    assert np.allclose(h, direct, atol=1e-4)
    loss = lambda: -np.mean(net.log_probabilities(x, net.tables())[np.arange(3), y])
    grads = net.gradients(x, y)
    for p, g in zip(net.parameters(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 1e-3
        up = loss()
        p[at] = old - 1e-3
        down = loss()
        p[at] = old
        assert abs((up - down) / 2e-3 - g[at]) < 0.05 * abs(g[at]) + 2e-3


def test_windows():
    assert to_windows(b"").shape == (0, 256) and to_windows(b"a" * 257).shape == (2, 256)


def test_language(frame, odd, empty):
    words = {"xx": "tha ther ing ould wen the".split(), "yy": "öst ünd ßen äch der zu".split()}
    rng = np.random.default_rng(3)
    data = []
    for i in range(600):
        lang = ("xx", "yy")[i % 2]
        data.append((i, " ".join(rng.choice(words[lang], 30)), lang, "s", 0, 0, ""))
    net = fit_language(frame(data), 150)
    got = {r.doc_id: r.lang_pred for r in predict_language(frame(data), net).collect()}
    held = [d for d in data if zlib.crc32(str(d[0]).encode()) % 4 == 2]
    assert np.mean([got[d[0]] == d[2] for d in held]) > 0.97
    out = {r.doc_id: (r.lang_pred, r.lang_score) for r in predict_language(odd, net).collect()}
    assert out[0] == out[1] == out[2] == ("und", 0.0) and out[4][0] != "und"
    assert fit_language(empty) is None and predict_language(odd, None).where("lang_pred <> 'und'").count() == 0
    assert predict_language(empty, net).count() == 0


def test_lattice():
    m = Lattice(PIECES)
    known = {p: m.lp[i] for i, p in enumerate(m.pieces)}

    def brute(text):
        if not text:
            return 1.0
        total = math.exp(m.byte * len(text[0].encode())) * brute(text[1:])
        for k in range(1, len(text) + 1):
            if text[:k] in known:
                total += math.exp(known[text[:k]]) * brute(text[k:])
        return total

    words = ["the", "a", "thing.", "été", "日本", "zq😀", "."]
    assert np.allclose(m.marginals(words), [math.log(brute("▁" + w)) for w in words])
    e = m.expected(["the"])
    assert 0.9 < sum(e[i] * len(m.pieces[i]) for i in np.flatnonzero(e)) / 4 <= 1.0001


def test_scores(frame, odd, empty):
    data = [(i, f"the cat and the dog {'Zx' * (i % 5)} word{i % 20}", "en", "s", 0, 0, "") for i in range(120)]
    for df in (frame(data), odd):
        for hot in (10, 200_000):
            have = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in score_documents(df, PIECES, hot=hot).collect()), key=repr)
            rows = [(r.doc_id, [*(r.text or "").encode().lower().split(), END]) for r in df.collect()]
            c = {}
            for d, w in rows:
                if d is not None and zlib.crc32(str(d).encode()) % 10:
                    for t in w:
                        c[t] = c.get(t, 0) + 1
            n, v = sum(c.values()), len(c)
            want = [(d, len(w), sum(t in c for t in w), n, round(sum(math.log10((c.get(t, 0) + 0.1) / (n + 0.1 * (v + 1))) for t in w), 6)) for d, w in rows]
            assert have == sorted(want, key=repr)
    s = {r.doc_id: r.score for r in score_documents(frame(data), PIECES).collect()}
    assert all(math.isfinite(x) and x < 0 for x in s.values())
    assert score_documents(empty, PIECES).count() == 0
