"""The audit against applying the filters one after another."""

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from millrace.llm.filter_audit import FILTERS, ORDERS, audit_filters, failures, first_failures, labelled


def failed(rows):
    """(part, set of failed filters, good, toxic) of (doc_id, text, part, good, toxic) rows."""
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    for d, t, part, good, toxic in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        bad = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > least[t],
        }
        yield part or "", {f for f, b in bad.items() if b}, good, toxic


def brute(rows):
    docs, out = list(failed(rows)), {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                earlier = len([d for d in mine if f in d[1]]) - len(gone)
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), earlier, sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def test_table():
    table = first_failures()
    assert table.shape == (32, 120) and len(set(ORDERS)) == 120
    for mask in range(32):
        for o, order in enumerate(ORDERS):
            assert table[mask, o] == next((i for i, f in enumerate(order) if mask >> FILTERS.index(f) & 1), 5)


@pytest.fixture(scope="module")
def rows():
    long = " ".join(f"w{i}" for i in range(150))
    texts = [long, long, long, f"{long} #", "SHOUT " * 120, "a b", "", None, f"{long} A|B", "x" * 100_000, long.upper(), " ".join(["again"] * 200)]
    out = [(i, t, ("en", "de", None, "")[i % 4], i % 3 == 0, i % 5 == 0) for i, t in enumerate(texts)]
    return [*out, out[1], out[1], (None, long, "en", False, False), (None, long, "en", False, False), (-5, "a b", "fr", True, True)]


def test_counts(spark, rows):
    docs = spark.createDataFrame([(d, t, p, 1, "x") for d, t, p, *_ in rows], "doc_id long, text string, lang string, Mask int, print string")
    labels = spark.createDataFrame([*{(d, int(g), int(x)) for d, _, _, g, x in rows if d is not None}, (3, None, 0), (None, 1, 1), (0, 0, 0)], "doc_id long, quality int, toxic int")
    got = audit_filters(labelled(failures(docs), labels)).collect()
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == brute(rows)
    assert len(got) == 120 * 5 * 4


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "same", "en"), ("a", "same", "en")], "doc_id string, text string, lang string")
    assert {r.doc_id: r["mask"] >> 4 for r in failures(docs).collect()} == {"a": 0, "b": 1}


def test_empty(empty):
    assert audit_filters(failures(empty).withColumns({"good": F.lit(True), "toxic": F.lit(True)})).collect() == []
