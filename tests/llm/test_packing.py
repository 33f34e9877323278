"""Packing round trips: every id in one piece, sequences gapless and within bounds, little padding."""

import numpy as np
import public_tokenizers
import pytest

from millrace.llm.packing import WordEncoder, cutting_stock, pack, pack_documents, price

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_encoder():
    e = WordEncoder(PATH, limit=40)  # so small that it is emptied again and again
    texts = ["", "Hello, World. It's 12.5% o'clock!", "a\nb  c\t d e", "ΣΑΣ ﬁ é É ß İ é", "...,,. x. ,y .z a.b,c", "<|endoftext|> <|startoftext|>x", "word " * 30 + "unseen. Words, here."]
    for t in texts:
        assert np.frombuffer(e(t), "<u4").tolist() == e.tok.encode(t, add_special_tokens=False).ids, t


def test_price():
    best, count = price(np.array([3, 5]), np.array([0.3, 0.6]), 13)
    assert best == pytest.approx(1.5) and list(count) == [1, 2]


def test_linear_program():
    sizes, demand = np.array([3, 5, 7]), np.array([40.0, 30.0, 20.0])
    patterns, x = cutting_stock(sizes, demand, 10)
    assert np.allclose(patterns.T @ x, demand) and (patterns @ sizes <= 10).all() and x.sum() == pytest.approx(40 * 0.5 + 15 - 10 * 0, abs=8)


@pytest.mark.parametrize("n", [0, 1, 7, 4000])
def test_pack(n):
    rng = np.random.default_rng(n)
    lengths = rng.integers(1, 2049, n)
    out = pack(lengths)
    assert sorted(i for s in out for i in s) == list(range(n))
    assert all(lengths[s].sum() <= 2048 for s in out)
    if n > 1000:
        assert len(out) <= 1.03 * lengths.sum() / 2048 + 1


def test_documents(spark, odd, empty):
    out = pack_documents(odd, PATH, block_tokens=3000).collect()
    tok, by, seqs = WordEncoder(PATH).tok, {}, {}
    for r in out:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        by.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids))
        seqs.setdefault(r.sequence_id, []).append((r.offset, len(ids)))
    for pieces in seqs.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
    want = {}
    for r in odd.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.setdefault((r.doc_id, len(ids)), []).append(ids)
    assert set(want) == set(by)
    for k, copies in want.items():
        assert sum(len(i) for _, i in by[k]) == sum(map(len, copies))
        first = sorted({s: i.tolist() for s, i in by[k]}.items())
        assert [x for _, i in first for x in i] == copies[0]
    assert pack_documents(empty, PATH).count() == 0


def test_encoder_groups():
    """Punctuation tails, special tokens and repeated words in one group, as the tokenizer has them."""
    e = WordEncoder(PATH, limit=20)
    texts = ["", "a$$$ b!!! c?d;e:f", "x<|endoftext|>!y|>#z", "it's!'s a#'s 1%2&3", "é! ß$ Ω;Ω ﬁ:*", "a_!b _? !!, ...;", "\n\n", "a$$$ b!!!"]
    for _ in range(2):
        for t, ids in zip(texts, e.many(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == e.tok.encode(t, add_special_tokens=False).ids, t
        e.forget()
    assert e.many([]) == []
