"""The opN queries themselves on the smallest tables: digests by brute force, SQL in DuckDB."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import queries as q
from millrace.llm.packing import WordEncoder
from millrace.llm.secrets import ALLOW, scan_secrets

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
WORD, LOW = re.compile("[^\x20\x09-\x0d]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, rel = q.queries()[name](spark, SF), c.sql(q.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    at = [rel.columns.index(n) for n in names]
    assert sorted(map(str, (tuple(r[i] for i in at) for r in rel.fetchall()))) == sorted(map(str, (tuple(r[n] for n in names) for r in df.collect())))


def test_secrets(spark, texts):
    kinds = {"assign": (re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 8, 2), "access": (re.compile("AKIA[A-Z0-9]+"), 16, 0), "hex": (re.compile("[0-9a-f]+"), 32, 0)}
    got = {r.doc_id: r for r in q.op1_secrets(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        spans = [(m.start(), k, m.end()) for k, (p, n, g) in kinds.items() for m in p.finditer(t) if len(m.group(g)) >= n]
        spans.sort(key=lambda s: (s[0], list(kinds).index(s[1])))
        r = got[d]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == s[1] for s in spans) for k in kinds)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def slow_entropy(text):
    """Entropy spans by the rules, each window's entropy summed anew."""
    allowed = [re.compile(a) for a in ALLOW]
    classes = [(re.compile("[0-9a-fA-F]+"), 24, 3.0), (re.compile("[0-9A-Za-z]+"), 20, 3.6), (re.compile("[0-9A-Za-z+/_=-]+"), 20, 3.7)]
    out = []
    for m in re.finditer("[A-Za-z0-9+/_=-]+", text):
        run = m.group()
        if len(run) < 20 or not re.search("[A-Za-z]", run) or any(a.fullmatch(run) for a in allowed):
            continue
        if re.search("[0-9]", run):
            width, least = next(((w, e) for p, w, e in classes if len(run) >= w and p.fullmatch(run)), (None, None))
        else:
            width, least = (None, None) if run[1:].islower() or run.isupper() else (20, 4.1)
        if width is None:
            continue
        hot = []
        for i in range(len(run) - width + 1):
            counts = Counter(run[i : i + width]).values()
            if -sum(c / width * math.log2(c / width) for c in counts) >= least - 1e-9:
                if hot and i <= hot[-1][1]:
                    hot[-1][1] = i + width
                else:
                    hot.append([i, i + width])
        out += [(m.start() + a, "entropy", m.start() + b) for a, b in hot]
    return out


def test_secret_spans(spark, texts):
    kinds = {"assign": (r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 1), "access": ("AKIA[A-Z0-9]+", 16, 0), "hex": ("[0-9a-f]+", 32, 0)}
    order, rng = [*kinds, "entropy"], np.random.default_rng(5)
    alphabets = ["0123456789abcdef", "ABCDEFabcdef0123", "abcdefghijklmnopqrstuvwxyz", "ABCxyzDEFuvw", "".join(map(chr, range(33, 127))), "aaaaaaaaaab1", "ab12/_+-="]
    made = {-i - 1: " ".join("".join(rng.choice(list(a), rng.integers(1, 90))) for a in rng.choice(alphabets, 12)) for i in range(150)}
    got = {r.doc_id: r.spans for r in q.op1_secrets(spark, SF).collect()}
    scanned = scan_secrets(spark.createDataFrame(list(made.items()), "doc_id long, text string")).collect()
    got |= {r.doc_id: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r.spans) for r in scanned}
    n = 0
    for d, t in (texts | made).items():
        spans = [(m.start(), k, m.end()) for k, (p, least, g) in kinds.items() for m in re.finditer(p, t) if len(m.group(g)) >= least] + slow_entropy(t)
        spans.sort(key=lambda s: (s[0], order.index(s[1])))
        assert got[d] == ",".join(f"{k}:{a}:{b}" for a, k, b in spans), d
        n += sum(s[1] == "entropy" for s in spans)
    assert n > 100


def test_packing(spark, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, used = {}, {}
    for r in q.op5_packing(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == texts.keys()
    for d, t in texts.items():
        ids, at = [*tok.encode(t, add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for spans in used.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 2048


def test_ids_equal_the_tokenizers_on_odd_texts():
    rng = np.random.default_rng(5)
    e = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    parts = [*"aBZéÉİıΣςßẞª²Ⅷ0,.!?$*%&#;:'\"<|>_- \n\t\r中日", "́", "̇", "̸", " ", "‍", "'s", "n't", "<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "GELDİ.", "EVİ,", "Å", "ﬁ", "word", "WORD"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 14))) for _ in range(20_000)]
    want = [np.array(x.ids, dtype="<u4").tobytes() for x in e.tok.encode_batch(texts, add_special_tokens=False)]
    assert all(a == b for k in range(0, len(texts), 500) for a, b in zip(e.many(texts[k : k + 500]), want[k : k + 500], strict=True))


def test_quality_base(spark, texts):
    got = {r.doc_id: r for r in q.op7_quality(spark, SF).collect()}
    for d, t in texts.items():
        w, r = WORD.findall(t), got[d]
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeated = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
        seen, dups = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dups += line in seen
                seen.add(line)
        failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dups, len(repeated), failed)
        assert not (failed and r.kept)


def test_lattice_base(spark, texts):
    tokens = lambda t: [*(x.translate(LOW) for x in WORD.findall(t)), "\n"]
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    count = Counter(x for d, t in texts.items() if not held(d) for x in tokens(t))
    n, v = count.total(), len(count)
    for r in q.op9_lattice(spark, SF).collect():
        w = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(x in count for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r.score < 0 and r.lattice_score < 0


def test_folds(spark, texts):
    for f, m, k in ((q.op2_toxicity, 5, 0), (q.op8_language, 4, 2)):
        out = f(spark, SF)
        assert out.count() == len(texts) and out.where("score < 0 or score > 1 or score is null").isEmpty()
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % m == k) for r in out.select("doc_id", "held_out").collect())


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang")
    said = q.op8_language(spark, SF.replace("0.001", "0.01")).where("held_out").join(docs, "doc_id").where("lang is not null and lang_pred <> 'und'")
    assert said.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.9
