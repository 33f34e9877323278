"""Hash trees against a tree built in Python; proofs and differences."""

import hashlib

from millrace.operators import merkle

SCHEMA = "part string, doc_id long, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def root(docs, levels, fan):
    level = {}
    for i, t in docs:
        if i is not None:
            level.setdefault(i, []).append(sha(t or ""))
    level = {i: "".join(sorted(h)) for i, h in level.items()}
    for _ in range(levels):
        up = {}
        for i, h in sorted(level.items()):
            up.setdefault(i // fan, []).append(f"{i}:{h}")
        level = {i: sha(",".join(k)) for i, k in up.items()}
    return sha("".join(h for _, h in sorted(level.items())))


def rows(n):
    return [(p, i * 7 % 1000, f"text {i} of {p}") for p in ("a", "b", None) for i in range(n)] + [("a", 7, "again"), ("a", 7, None), ("a", None, "no id"), ("b", 5000, "far away")]


def test_roots(spark):
    data = rows(60)
    got = {r.part: (r.hash, r.n) for r in merkle.roots(merkle.tree(spark.createDataFrame(data, SCHEMA), 3, 8)).collect()}
    for part in ("a", "b", ""):
        own = [(i, t) for p, i, t in data if (p or "") == part]
        assert got[part] == (root(own, 3, 8), sum(i is not None for i, _ in own))


def test_root_changes_with_any_text(spark):
    data = [("a", i, f"text {i}") for i in range(40)]
    seen = set()
    for k in (None, 0, 17, 39):
        some = [(p, i, t + "!" if i == k else t) for p, i, t in data]
        seen.add(merkle.roots(merkle.tree(spark.createDataFrame(some, SCHEMA), 2, 8)).first()["hash"])
    assert len(seen) == 4


def test_proofs(spark):
    df = spark.createDataFrame(rows(60), SCHEMA)
    nodes = merkle.tree(df, 3, 8)
    asked = [("a", 0, "text 0 of a"), ("a", 14, "text 2 of a"), ("a", 21, "other"), ("b", 5000, "far away"), ("a", 999, "not there"), ("none", 1, "x"), ("b", 28, None)]
    some = spark.createDataFrame(asked, SCHEMA)
    proof = merkle.proofs(nodes, some, 3, 8)
    assert proof.where("level < 3").groupBy("part", "doc_id", "level").count().agg({"count": "max"}).first()[0] <= 8
    got = {(r.part, r.doc_id): r.ok for r in merkle.verify(proof, some, merkle.roots(nodes), 3, 8).collect()}
    assert got == {("a", 0): True, ("a", 14): True, ("a", 21): False, ("b", 5000): True, ("a", 999): False, ("none", 1): False, ("b", 28): False}
    # A forged proof: the asked document's own leaves, but other hashes beside them.
    forged = proof.selectExpr("part", "doc_id", "level", "node", "case when level = 1 then sha2(hash, 256) else hash end as hash")
    assert {r.doc_id for r in merkle.verify(forged, some, merkle.roots(nodes), 3, 8).collect() if r.ok} == {5000}  # alone up to the top, it needs none of them


def test_differences(spark):
    one = [("a", i, f"t{i}") for i in range(300)] + [("b", 1, "x"), ("gone", 5, "y")]
    two = [("a", i, "changed" if i in (8, 250) else f"t{i}") for i in range(300) if i != 99] + [("a", 4000, "new"), ("b", 1, "x"), ("came", 2, "z")]
    tree = lambda d: merkle.tree(spark.createDataFrame(d, SCHEMA), 3, 8)
    got = {tuple(r) for r in merkle.differences(tree(one), tree(two), 3, 8).collect()}
    assert got == {("a", 8, "changed"), ("a", 250, "changed"), ("a", 99, "removed"), ("a", 4000, "added"), ("gone", 5, "removed"), ("came", 2, "added")}
    assert merkle.differences(tree(one), tree(one), 3, 8).collect() == []
