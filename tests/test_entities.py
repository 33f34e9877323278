"""Mentions, context and aliases against sequential versions."""

import random
import re

from millrace.operators import entities

TRIPLE = "subject string, relation string, object string, confidence double"


def tokens(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def linked(text, names, longest=4):
    """Leftmost, then longest; nothing within what was taken."""
    known, out, at, t = {}, [], 0, tokens(text)
    for n in sorted(names, reverse=True):
        if tokens(n):
            known[" ".join(tokens(n))] = n
    while at < len(t):
        for n in range(min(longest, len(t) - at), 0, -1):
            name = known.get(" ".join(t[at : at + n]))
            if name is not None:
                out.append((at, n, name))
                at += n
                break
        else:
            at += 1
    return out


def world(seed):
    r = random.Random(seed)
    words = list("abcdefgh")
    names = ["A", "a b", "a b c", "b c d e", "c", "d e", "D-E", "e", "h g f e d", "", "zz"] + [" ".join(r.choices(words, k=r.choice((1, 2, 3)))) for _ in range(8)]
    texts = [(i, " ".join(r.choices([*words, "x", "y"], k=r.choice((0, 3, 20))))) for i in range(40)] + [(100, None), (101, "A, B! c")]
    facts = [(r.choice(names), f"r{r.randrange(3)}", r.choice(names), round(r.random(), 2)) for _ in range(60)]
    return names, texts, facts


def test_mentions(spark):
    names, texts, _ = world(1)
    got = entities.mentions(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in names], "name string"))
    assert sorted(map(tuple, got.select("id", "at", "n", "name").collect())) == sorted((i, *m) for i, t in texts for m in linked(t, names))


def test_enrich(spark):
    _, texts, facts = world(2)
    got = {r.id: r.context for r in entities.enrich(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(facts, TRIPLE)).collect()}
    names = {n for f in facts for n in (f[0], f[2])}
    for i, text in texts:
        first = list(dict.fromkeys(m[2] for m in linked(text, names)))[:5]
        said = [" ".join(f[:3]) for e in first for f in sorted((f for f in facts if e in (f[0], f[2])), key=lambda f: (-f[3], f[:3]))[:3]]
        assert got[i] == said[:5], (i, text)


def union_find(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            up[root(a)] = root(b)
    groups = {}
    for x in up:
        groups.setdefault(root(x), set()).add(x)
    aliases = {a for a, b in pairs if a is not None and b is not None and a != b}
    return {x: min(g, key=lambda n: (n in aliases, n)) for g in groups.values() for x in g}


def test_aliases(spark):
    r = random.Random(3)
    pairs = [("usa", "us"), ("us", "united states"), ("america", "us"), ("p", "q"), ("q", "p"), ("two", "x1"), ("two", "x2"), ("own", "own"), (None, "n"), ("n", None)] + [(f"m{r.randrange(30)}", f"m{r.randrange(30)}") for _ in range(20)]
    a = spark.createDataFrame(pairs, "alias string, canonical string")
    want = union_find(pairs)
    assert {x.name: x.canonical for x in entities.canonical_names(a).collect()} == want
    assert want["usa"] == want["america"] == "united states" and want["p"] == want["q"] == "p" and want["x2"] == "x1"
    facts = [("usa", "has", "p", 0.4), ("america", "has", "q", 0.9), ("other", "is", "two", 0.5), ("x1", "is", "other", 0.5)]
    merged = {}
    for s, rel, o, c in facts:
        k = want.get(s, s), rel, want.get(o, o)
        merged[k] = max(c, merged.get(k, 0))
    assert {tuple(x)[:3]: x.confidence for x in entities.merge_aliases(spark.createDataFrame(facts, TRIPLE), a).collect()} == merged
    lists = {x.canonical: x.aliases for x in entities.alias_lists(a).collect()}
    assert lists["united states"] == ["america", "us", "usa"] and "own" not in lists
    none = a.limit(0)
    assert entities.alias_lists(none).collect() == []
