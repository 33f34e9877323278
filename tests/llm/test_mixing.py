"""Budgets against a recursive water level, selections against a direct sort."""

import hashlib

from pyspark.sql import functions as F

from millrace.llm.mixing import leaf_budgets, mix, token_count

def weights():
    return {"domain": F.when(F.col("domain") == "a", 3).otherwise(1), "lang": F.lit(1), "source": F.when(F.col("source") == "s1", 2).otherwise(1)}


def water(budget, caps, weights):
    """Integer water level: children that fill up leave their rest to the others."""
    open_, out = set(range(len(caps))), [0] * len(caps)
    while True:
        left, share = budget - sum(caps[i] for i in range(len(caps)) if i not in open_), sum(weights[i] for i in open_)
        full = {i for i in open_ if caps[i] * share <= weights[i] * left}
        if not full:
            break
        open_ -= full
    left = budget - sum(caps[i] for i in range(len(caps)) if i not in open_)
    share = sum(weights[i] for i in open_)
    return [weights[i] * left // share if i in open_ else caps[i] for i in range(len(caps))]


def test_budgets(spark):
    leaves = [("a", "en", "s1", 100), ("a", "en", "s2", 5), ("a", "de", "s1", 40), ("b", "en", "s1", 1000), ("b", "fr", "s3", 7)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    for budget in (0, 10, 200, 700, 10_000):
        got = {r[:3]: r["budget"] for r in leaf_budgets(df, F.lit(budget), weights(), 2).collect()}
        b = min(budget, 2 * 1152)
        a, other = water(b, [290, 2014], [3, 1])
        a_de, a_en = water(a, [80, 210], [1, 1])
        b_en, b_fr = water(other, [2000, 14], [1, 1])
        s1, s2 = water(a_en, [200, 10], [2, 1])
        assert got == {("a", "en", "s1"): s1, ("a", "en", "s2"): s2, ("a", "de", "s1"): a_de, ("b", "en", "s1"): b_en, ("b", "fr", "s3"): b_fr}, budget


def test_selection(spark, frame):
    data = [(i, "w " * (i % 7 + 1), "en" if i % 2 else None, f"src{i % 3}", 0, 0, "") for i in range(200)]
    docs = frame(data)
    got = sorted((r.doc_id, r.epoch) for r in mix(docs, {}, F.expr("total * 3 div 2"), F.lit("d"), max_epochs=3).collect())
    leaves = {}
    for d in data:
        leaves.setdefault((d[2] or "none", d[3]), []).append((d[0], d[0] % 7 + 1))
    total = {k: sum(n for _, n in v) for k, v in leaves.items()}
    langs = sorted({k[0] for k in leaves})
    budget = sum(total.values()) * 3 // 2
    per = dict(zip(langs, water(budget, [3 * sum(t for k, t in total.items() if k[0] == g) for g in langs], [1] * len(langs)), strict=True))
    want = []
    for g in langs:
        own = sorted(k for k in leaves if k[0] == g)
        for k, b in zip(own, water(per[g], [3 * total[k] for k in own], [1] * len(own)), strict=True):
            whole, rest = divmod(b, total[k])
            order = sorted(leaves[k], key=lambda r: hashlib.md5(f"42|{whole + 1}|{r[0]}".encode()).hexdigest())
            for d, _ in leaves[k]:
                want += [(d, e) for e in range(1, whole + 1)]
            for d, n in order:
                rest -= n
                if rest < 0:
                    break
                want.append((d, whole + 1))
    assert got == sorted(want)


def test_cover_keeps_all(odd, empty):
    out = mix(odd, {}, F.col("cover"), max_epochs=2)
    assert {c for c in out.columns} == {*odd.columns}
    assert out.select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    assert mix(odd, {}, F.lit(0)).where("text is not null and trim(text) <> ''").where("length(text) > 5").count() == 0
    assert mix(empty, {}, F.col("total")).count() == 0


def test_token_count(spark):
    df = spark.createDataFrame([(None,), ("",), (" \x0b\t",), ("a b",), ("\na\x0cb\rc  d ",)], "t string")
    assert [r[0] for r in df.select(token_count(F.col("t"))).collect()] == [0, 0, 0, 2, 4]
