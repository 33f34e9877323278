"""Line dedup against brute force, and its filter and index."""

import re

import numpy as np
import pytest

from millrace.llm.line_dedup import CuckooFilter, LineIndex, line_dedup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs):
    key = lambda s: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", s).translate(LOW)
    owners = {}
    for d, t in docs:
        for s in (t or "").split("\n") if d is not None else ():
            owners.setdefault(key(s), set()).add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        keep = [s for s in lines if d is None or len(key(s)) < 10 or len(owners[key(s)]) < 2 or d == min(owners[key(s)])]
        out.append((d, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.text or "", r.n_lines, r.n_dropped) for r in df.collect()), key=repr)


def test_brute_force(spark, odd):
    out = line_dedup(odd)
    assert got(out) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert "N_Dropped" not in out.columns and "n_dropped" in out.columns and out.count() == odd.count()


def test_hot_line_over_many_parts(spark, frame):
    data = [(i, f"the same long line\nline of {i} alone, long\nshared by {i // 2} and its twin", "en", "s", 0, 0, "") for i in range(300)]
    from millrace.llm import line_dedup as m
    from millrace.runtime import materialize

    docs = frame(data)
    refs = materialize(m.references(docs), "t")
    gone = m.drops(refs, shard_keys=20, part_refs=10)
    assert got(m.drop_lines(docs, gone)) == brute([(d[0], d[1]) for d in data])


def test_empty(empty):
    assert line_dedup(empty).count() == 0


def test_filter():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**62), 2**62, (2, 3000))
    f = CuckooFilter(1000)  # too small: what cannot be placed is stashed, never lost
    f.insert(a, b)
    assert f.contains(a, b).all()
    c, d = rng.integers(-(2**62), 2**62, (2, 3000))
    g = CuckooFilter(3000)
    g.insert(a, b)
    assert g.contains(c, d).mean() < 0.01
    g.delete(a[:1500], b[:1500])
    assert g.contains(a[1500:], b[1500:]).all() and g.contains(a[:1500], b[:1500]).mean() < 0.02


def test_index_is_reversible(spark, frame, tmp_path):
    line = "one line that is long enough"
    first, more = frame([(1, line, "", "", 0, 0, ""), (2, f"{line}\nb", "", "", 0, 0, "")]), frame([(0, line, "", "", 0, 0, ""), (2, line, "", "", 0, 0, "")])
    index = LineIndex(spark, f"file://{tmp_path}/index")
    index.insert(first)
    before = sorted(map(tuple, index.state().collect()))
    assert [r.doc for r in index.drops().collect()] == [2]
    index.insert(more)
    assert sorted(r.doc for r in index.drops().collect()) == [1, 2]
    index.delete(more.where("doc_id = 0"))
    assert sorted(map(tuple, index.state().collect())) == before
    assert [r.doc for r in index.drops().collect()] == [2]


def entries(index):
    return {r.shard: CuckooFilter.load(r.slots, bytes(r.filter)).entries() for r in index.filters().collect()}


def test_index_filters_follow_insertions_and_deletions(spark, frame, tmp_path):
    rows = lambda ids: frame([(i, f"a line only of {i}, long\na line that all documents share\na line of half {i % 2} of them", "", "", 0, 0, "") for i in ids])
    index = LineIndex(spark, f"file://{tmp_path}/index", shards=3, capacity=4)
    index.insert(rows(range(8)))
    before, counts = entries(index), sorted(map(tuple, index.counts().collect()))
    assert sum(map(len, before.values())) == 8 + 1 + 2 == index.counts().count()  # one entry for each distinct key; shards grew from 4
    index.insert(rows(range(6, 40)))
    after = entries(index)
    assert sum(map(len, after.values())) == 40 + 1 + 2
    held = index.counts().collect()
    for shard, f in {r.shard: CuckooFilter.load(r.slots, bytes(r.filter)) for r in index.filters().collect()}.items():
        mine = [r for r in held if r.h2 % 3 == shard]
        assert f.contains(np.array([r.h1 for r in mine]), np.array([r.h2 for r in mine])).all()
    index.delete(rows(range(8, 40)).select("doc_id"))
    assert sorted(map(tuple, index.counts().collect())) == counts
    assert {k: len(v) for k, v in entries(index).items()} == {k: len(v) for k, v in before.items()}
    assert {f for v in entries(index).values() for f, _ in v} == {f for v in before.values() for f, _ in v}
    again = LineIndex(spark, f"file://{tmp_path}/index", shards=3)
    assert again.version() == 3 and sorted(r.doc for r in again.drops().collect()) == sorted(r.doc for r in index.drops().collect())


def test_index_calls_that_stop_can_be_repeated(spark, frame, tmp_path, monkeypatch):
    """Stopped between the log and the filters, a call has changed nothing; repeated, it gives what one call gives."""
    rows = lambda ids: frame([(i, f"a line only of {i}, long\na line that all documents share\na line of third {i % 3} of them", "", "", 0, 0, "") for i in ids])
    index, other = (LineIndex(spark, f"file://{tmp_path}/{n}", shards=3, capacity=8) for n in ("one", "two"))

    def stop(*_):
        raise KeyboardInterrupt

    def stopped(call):
        seen = index.version(), sorted(map(tuple, index.state().collect())), entries(index)
        with monkeypatch.context() as m:
            m.setattr(type(index.spark.range(1).write), "parquet", lambda self, path, *a, f=type(index.spark.range(1).write).parquet, **k: stop() if "/filters/" in path else f(self, path, *a, **k))
            with pytest.raises(KeyboardInterrupt):
                call()
        assert (index.version(), sorted(map(tuple, index.state().collect())), entries(index)) == seen

    steps = [lambda x: x.insert(rows(range(30))), lambda x: x.delete(rows(range(20)).select("doc_id")), lambda x: x.insert(rows(range(25, 40)))]
    for step in steps:
        stopped(lambda step=step: step(index))
        step(index)
        step(other)
        assert sorted(map(tuple, index.state().collect())) == sorted(map(tuple, other.state().collect()))
        held = {r.shard: r.held for r in index.filters().collect()}
        assert sum(held.values()) == index.counts().count() == sum(map(len, entries(index).values()))


def test_index_reads_little_of_a_large_log(spark, frame, tmp_path):
    """An insertion of new keys reads no log of references, a deletion the shards of its documents; a compacted log is one."""
    rows = lambda ids: frame([(i, f"a line only of {i}, long", "", "", 0, 0, "") for i in ids])
    index = LineIndex(spark, f"file://{tmp_path}/index", shards=8, capacity=4000)
    index.insert(rows(range(400)))
    read = []
    index._log = lambda what, shards=None, f=index._log: (read.append((what, shards)), f(what, shards))[1]
    index.insert(rows(range(1000, 1010)))
    assert [r for r in read if r[0] == "refs"] == [("refs", [])]
    read.clear()
    index.delete(rows([5]).select("doc_id"))
    assert [len(r[1]) for r in read if r[0] == "refs"] == [1]
    del index._log
    want = sorted(map(tuple, index.state().collect())), {r.doc for r in index.documents().collect()}
    index.compact()
    assert len(index._live("refs")) == 1
    assert (sorted(map(tuple, index.state().collect())), {r.doc for r in index.documents().collect()}) == want
    index.insert(rows([5, 2000]))
    assert index.documents().count() == len(want[1]) + 2 and len(index._live("refs")) == 2


def test_names_that_clash(spark, frame):
    df = frame([(1, "a line that is long enough", "", "", 0, 0, ""), (2, "a line that is long enough", "", "", 0, 0, "")])
    for c in ("_gone", "_doc", "_kept", "_DOC_"):
        df = df.withColumn(c, df["doc_id"])
    out = line_dedup(df)
    assert {(r.doc_id, r.n_dropped, r["_gone"]) for r in out.collect()} == {(1, 0, 1), (2, 1, 2)}
