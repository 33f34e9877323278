"""Embedding near-dedup over a robust-pruned flat graph.

Only vectors with the same label are compared. Identical vectors are one class.
Classes go to the shards of their `overlap` nearest pivots. Each shard builds a
graph: nearest candidates, robust-pruned (a neighbour that a kept one is closer to,
by the factor alpha, goes). A class's adjacency lists from all its shards are
united. Each shard then runs, for its classes, a greedy beam search from the
shard's medoid (and the class itself) and expands in range: from every hit to
its neighbours that are in range too. Pairs found are verified in double
precision. A sample of queries is compared with brute force over all classes;
while recall is under `target`, the shards overlap more; if it is with an
overlap of 8 too, chunks of each label are compared with each other exactly.

A pair that only one task can find is counted there. Pairs that several shards
(or tasks of a shard) share leave each as lists of neighbours, a row for each
class, which are united before they are counted: it is enough that one of them
finds a pair. The edges that leave a task are a spanning forest. A shard of over
`cap` classes is dealt as chunks, every pair of chunks being a task, so its pairs
are all searched with bounded memory.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and those with a null label or id, link with nothing and are kept
(a null id has a null component); rows that repeat an id are one node of their
components; vectors of different lengths don't link; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import connected_components
from millrace.runtime import bound_batches, materialize

COSINE, OVERLAP, SHARD, CAP, PIVOTS = 0.98, 3, 400, 4000, 20_000
DEGREE, CANDIDATES, ALPHA, BEAM, STEPS = 16, 32, 1.2, 16, 24
AUDIT, TARGET = 200, 0.97
PART = 16384  # pairs looked at at once


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, h1, h2, vec): vec is the float64 vector's bytes; null if it links with nothing."""
    for b in batches:
        ids, labels, vecs = b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()
        h1, h2, out = [], [], []
        for i, label, v in zip(ids.to_pylist(), labels, vecs, strict=True):
            data = None
            if i is not None and label is not None and v and None not in v:
                a = np.array(v, dtype=np.float64)
                if np.isfinite(a).all() and a.any():
                    data = a.tobytes()
            d = xxhash.xxh3_128_digest(data) if data else None
            out.append(data)
            h1.append(int.from_bytes(d[:8], "little", signed=True) if d else None)
            h2.append(int.from_bytes(d[8:], "little", signed=True) if d else None)
        yield pa.record_batch([ids, b.column(1), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "label", "h1", "h2", "vec"])


def _unit(vecs: list[bytes]) -> np.ndarray:
    """Rows scaled to length 1, first by their largest component so that squares neither overflow nor vanish."""
    a = np.frombuffer(b"".join(vecs), dtype=np.float64).reshape(len(vecs), -1)
    a = a / np.abs(a).max(1, keepdims=True)
    return a / np.sqrt((a * a).sum(1, keepdims=True))


def robust_prune(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA, block: int = 256) -> np.ndarray:
    """(n, degree) neighbours of each unit row, -1 where there are fewer."""
    n, c = len(x), min(candidates, len(x) - 1)
    out = np.full((n, degree), -1, dtype=np.int64)
    if c < 1:
        return out
    for lo in range(0, n, block):
        sims = x[lo : lo + block] @ x.T
        sims[np.arange(len(sims)), np.arange(lo, lo + len(sims))] = -np.inf
        near = np.argpartition(-sims, c - 1, axis=1)[:, :c]
        order = np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, 1)
        far = 1 - np.take_along_axis(sims, near, 1)  # distance to the node
        between = 1 - np.matmul(x[near], x[near].transpose(0, 2, 1))
        alive, kept = np.ones(near.shape, bool), np.zeros(len(near), dtype=np.int64)
        for p in range(c):
            take = alive[:, p] & (kept < degree)
            rows = np.flatnonzero(take)
            out[lo + rows, kept[rows]] = near[rows, p]
            kept[rows] += 1
            alive[rows] &= alpha * between[rows, p] > far[rows]
    return out


def range_pairs(x: np.ndarray, adj: np.ndarray, cosine: float, block: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b) of pairs in range, a block of a at a time: beams from the medoid and the query, then expansion from hit to hit."""
    n = len(x)
    y = x.astype(np.float32)
    medoid, bar = int((y @ y.sum(0)).argmax()), cosine - 1e-4
    step = max(16, min(512, 32768 // max(1, adj.shape[1])))  # hubs make lists long
    for lo in range(0, n, block):
        q = np.arange(lo, min(lo + block, n))
        near = np.concatenate([beam_search(y, adj, medoid, i, min(step, int(q[-1]) + 1 - i)) for i in range(lo, int(q[-1]) + 1, step)])
        seeds = np.concatenate([near, adj[q], q[:, None]], 1)
        new, seen = np.zeros(len(q) * n, bool), np.zeros(len(q) * n, bool)
        new[((q - lo)[:, None] * n + seeds)[seeds >= 0]] = True
        while new.any():
            keys, seen = np.flatnonzero(new), seen | new
            new[:] = False
            for some in (keys[k : k + PART] for k in range(0, len(keys), PART)):
                a, b = some // n, some % n
                hit = np.einsum("nd,nd->n", y[lo + a], y[b]) >= bar
                a, b = a[hit], b[hit]
                yield lo + a, b
                nxt = adj[b]
                new[(a[:, None] * n + nxt)[nxt >= 0]] = True
            new &= ~seen


def all_pairs(x: np.ndarray, cosine: float, block: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b) of all pairs in range, a block of a at a time."""
    y = x.astype(np.float32)
    for lo in range(0, len(x), block):
        a, b = np.nonzero(y[lo : lo + block] @ y.T >= cosine - 1e-4)
        yield a + lo, b


def beam_search(y: np.ndarray, adj: np.ndarray, medoid: int, lo: int, block: int = 512) -> np.ndarray:
    """Rows lo to lo + block as queries: the nodes each greedy search from the medoid and the row ends with (-1: none)."""
    q = np.arange(lo, min(lo + block, len(y)))
    starts = np.stack([np.full(len(q), medoid), q], 1)
    starts[q == medoid, 1] = -1
    n, beam = len(q), BEAM
    ids = np.full((n, beam), -1, dtype=np.int64)
    ids[:, :2] = starts
    sims = np.where(ids >= 0, np.einsum("nbd,nd->nb", y[ids], y[q]), -np.inf)
    done = ids < 0
    for _ in range(STEPS):
        best = np.where(done, -np.inf, sims).argmax(1)
        rows = np.flatnonzero(~done[np.arange(n), best])
        if not len(rows):
            break
        at = ids[rows, best[rows]]
        done[rows, best[rows]] = True
        new = adj[at]
        new = np.where((new[:, :, None] == ids[rows][:, None, :]).any(2), -1, new)
        s = np.where(new >= 0, np.einsum("nbd,nd->nb", y[new], y[q[rows]]), -np.inf)
        all_i, all_s = np.concatenate([ids[rows], new], 1), np.concatenate([sims[rows], s], 1)
        all_d = np.concatenate([done[rows], new < 0], 1)
        top = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
        ids[rows], sims[rows], done[rows] = (np.take_along_axis(v, top, 1) for v in (all_i, all_s, all_d))
    return ids


def _join(root: np.ndarray, i: int, near: np.ndarray) -> Iterator[int]:
    """Those of i's neighbours that bring it together with another tree of the forest; root names each row's tree."""
    trees, first = np.unique(root[near], return_index=True)
    for tree, j in zip(trees.tolist(), near[first].tolist(), strict=True):
        if tree != root[i]:
            root[root == tree] = root[i]
            yield j


def _local(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return t["rep"].to_numpy(), _unit(t["vec"].to_pylist())


def _build(t: pa.Table) -> pa.Table:
    """One shard's classes -> (rep, nbrs): the pruned graph's lists, arcs both ways, else a node that is no one's neighbour can't be reached."""
    rep, x = _local(t)
    adj = robust_prune(x.astype(np.float32))
    has = adj.ravel() >= 0
    src, dst = np.repeat(np.arange(len(rep)), adj.shape[1])[has], adj.ravel()[has]
    arcs = np.unique(np.concatenate([src * len(rep) + dst, dst * len(rep) + src]))
    src, dst = arcs // len(rep), arcs % len(rep)
    ends = np.searchsorted(src, np.arange(len(rep) + 1))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rep[dst], pa.int64()))
    return pa.table({"rep": pa.array(rep, pa.int64()), "nbrs": lists})


def _found(t: pa.Table, cosine: float, exact: bool) -> Iterator[pa.RecordBatch]:
    """One shard's classes with united lists -> link counts (b null), forest edges, and lists of (neighbour, size) for what other tasks may find too (more).

    A bit for each pair of the task's classes (at most two chunks) is all that is held of the pairs; the rest is done for a block of classes at a time.
    """
    rep, x = _local(t)
    n = len(rep)
    order = np.argsort(rep)
    lists = t["nbrs"].combine_chunks()
    own = np.repeat(np.arange(n), [0 if v is None else v for v in pc.list_value_length(lists).to_pylist()])
    ids = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
    p = np.minimum(np.searchsorted(rep[order], ids), n - 1)
    here = rep[order[p]] == ids  # of the united lists, what is in this shard
    own, ids = own[here], order[p[here]]
    place = np.arange(len(own)) - np.searchsorted(own, own)
    adj = np.full((n, int(place.max(initial=0)) + 1), -1, dtype=np.int32)
    adj[own, place] = ids
    hits = np.zeros((n, n), bool)
    for a, b in all_pairs(x, cosine) if exact else range_pairs(x, adj, cosine):
        hits[a, b] = hits[b, a] = True
    np.fill_diagonal(hits, False)
    chunk, size = t["chunk"].to_numpy(), t["n"].to_numpy()
    if (chunk != chunk[0]).any():  # pairs within a chunk are those of the task that has it alone
        for c in np.unique(chunk):
            hits[np.ix_(chunk == c, chunk == c)] = False
    table = np.array([s + [-1] * (8 - len(s)) for s in t["shards"].to_pylist()], dtype=np.int64)
    links, root = np.zeros(n, np.int64), np.arange(n)
    for lo in range(0, n, 64):
        edges, heads, more = [], [], []
        for i in range(lo, min(lo + 64, n)):
            near = np.flatnonzero(hits[i])
            near = near[np.einsum("d,nd->n", x[i], x[near]) >= cosine] if len(near) else near
            if not len(near):
                continue
            edges += [(int(rep[i]), int(rep[j])) for j in _join(root, i, near[near > i])]
            common = (((table[i][None, :, None] == table[near][:, None, :]) & (table[i] >= 0)[None, :, None]).sum((1, 2)))
            links[i] = size[near[common == 1]].sum()  # no other task has both
            shared = near[common > 1]
            if len(shared):
                heads.append(int(rep[i]))
                more.append(np.stack([rep[shared], size[shared]], 1).astype(np.int64).tobytes())
        yield _rows([*[i for i, _ in edges], *heads], [*[j for _, j in edges], *[None] * len(heads)], [0] * (len(edges) + len(heads)), [*[None] * len(edges), *more])
    hit = np.flatnonzero(links)
    yield _rows(rep[hit].tolist(), [None] * len(hit), links[hit].tolist(), [None] * len(hit))


def _rows(a: list, b: list, links: list, more: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.int64()), pa.array(more, pa.binary())], names=["a", "b", "links", "more"])


def _search(cosine: float, exact: bool = False):
    def search(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_found(t, cosine, exact))

    return search


def _searched(cosine: float, exact: bool):
    """`_search` that hands on a block's rows when they are there."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _found(pa.Table.from_batches(list(batches)), cosine, exact)

    return search


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, lists of all tasks) -> link counts, each neighbour once."""
    for batch in batches:
        links = []
        for lists in batch.column(1):
            pairs = np.frombuffer(b"".join(v.as_py() for v in lists.values), dtype=np.int64).reshape(-1, 2)
            links.append(int(pairs[np.unique(pairs[:, 0], return_index=True)[1], 1].sum()))
        yield pa.record_batch([batch.column(0), pa.nulls(len(links), pa.int64()), pa.array(links, pa.int64())], names=["a", "b", "links"])


def _assign(pivots: dict, overlap: int):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the shards, ascending, of each class's nearest pivots; a label without pivots is one shard."""
        for b in batches:
            labels, vecs = b.column(0).to_pylist(), b.column(3).to_pylist()
            shards: list[list[int]] = [[0]] * len(labels)
            groups: dict[tuple, list[int]] = {}
            for i, (label, v) in enumerate(zip(labels, vecs, strict=True)):
                groups.setdefault((label, len(v)), []).append(i)
            for key, rows in groups.items():
                ids, p = pivots.value.get(key, (None, None))
                if p is None or len(p) < 2:
                    continue
                k = min(overlap, len(p))
                for some in (rows[i : i + 256] for i in range(0, len(rows), 256)):  # a label may have all pivots
                    s = _unit([vecs[i] for i in some]) @ p.T
                    top = ids[np.argpartition(-s, k - 1, axis=1)[:, :k]]
                    for i, t in zip(some, np.sort(top, 1).tolist(), strict=True):
                        shards[i] = t
            yield pa.record_batch([*b.columns, pa.array(shards, pa.list_(pa.int64()))], names=["label", "rep", "n", "vec", "shards"])

    return assign


def _index(classes: DataFrame, total: int, cosine: float, overlap: int, shard: int, cap: int, exact: bool = False) -> DataFrame:
    """(a, b, links) of all shards, stored."""
    spark = classes.sparkSession
    want = min(PIVOTS, math.ceil(total / shard))  # a bounded sample, whatever the table's size
    share = F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * want / max(1, total)) + 1
    rows = [] if exact else classes.where(share).select("label", "rep", "vec").orderBy("rep").limit(2 * PIVOTS).toArrow().to_pylist()
    groups: dict[tuple, list[tuple[int, bytes]]] = {}
    for k, r in enumerate(rows):
        groups.setdefault((r["label"], len(r["vec"])), []).append((k + 1, r["vec"]))
    pivots = spark.sparkContext.broadcast({g: (np.array([k for k, _ in v]), _unit([d for _, d in v])) for g, v in groups.items()})
    placed = classes.select("label", "rep", "n", "vec").mapInArrow(_assign(pivots, overlap), "label string, rep long, n long, vec binary, shards array<long>")
    placed = materialize(placed.withColumn("shard", F.explode("shards")).withColumn("dim", F.octet_length("vec")), "vec-shards")
    key = ["label", "dim", "shard"]
    chunks = placed.groupBy(*key).agg(F.ceil(F.count("*") / cap).cast("int").alias("chunks"))
    dealt = placed.join(chunks, key).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("ci", F.least("chunk", "o")).withColumn("cj", F.greatest("chunk", "o"))
    task = [*key, "ci", "cj"]
    if exact:  # no pivots, so a label is one shard, and no graph
        ready = dealt.withColumn("nbrs", F.lit(None).cast("array<long>"))
    else:
        lists = dealt.select(*task, "rep", "vec").groupBy(*task).applyInArrow(_build, "rep long, nbrs array<long>")
        united = materialize(lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("nbrs")), "vec-graph")  # a list from each task the class is in
        ready = dealt.join(united, "rep", "left")
    ready = ready.select(*task, "rep", "n", "vec", "shards", "chunk", "chunks", "nbrs")
    found = materialize(ready.groupBy(*task).applyInArrow(_searched(cosine, exact), "a long, b long, links long, more binary"), "vec-found")
    lists = found.where("more is not null").groupBy("a").agg(F.collect_list("more").alias("lists"))
    return materialize(found.where("more is null").drop("more").union(lists.mapInArrow(_unite, "a long, b long, links long")), "vec-links")


def audit_recall(classes: DataFrame, links: DataFrame, total: int, cosine: float, sample: int = AUDIT) -> float:
    """Links found over links there are, of a bounded sample of classes against all classes.

    The lesser of two shares: over all links of the sample, and the mean over its
    classes, so that neither a dense group hides small ones nor the other way round.
    """
    spark = classes.sparkSession
    share = F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(1_000_000)) < int(1_000_000 * sample / max(1, total)) + 1
    some = classes.where(share).select("label", "rep", "vec").limit(2 * sample).toArrow().to_pylist()
    queries = spark.sparkContext.broadcast([(r["label"], r["rep"], r["vec"]) for r in some])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, rep, n, vec = (b.column(k).to_pylist() for k in range(4))
            groups: dict[tuple, list[int]] = {}
            for i, (g, v) in enumerate(zip(label, vec, strict=True)):
                groups.setdefault((g, len(v)), []).append(i)
            q, count = [], []
            for g, r, v in queries.value:
                rows = groups.get((g, len(v)))
                if rows:
                    hit = _unit([vec[i] for i in rows]) @ _unit([v])[0] >= cosine
                    q.append(r)
                    count.append(sum(n[i] for i, h in zip(rows, hit.tolist(), strict=True) if h and rep[i] != r))
            yield pa.record_batch([pa.array(q, pa.int64()), pa.array(count, pa.int64())], names=["a", "there"])

    there = classes.select("label", "rep", "n", "vec").mapInArrow(exact, "a long, there long").groupBy("a").agg(F.sum("there").alias("there")).where("there > 0")
    got = links.where("b is null").groupBy("a").agg(F.sum("links").alias("got"))
    each = there.join(got, "a", "left").select("there", F.least("there", F.coalesce("got", F.lit(0))).alias("got"))
    s = each.agg(F.sum("there").alias("t"), F.sum("got").alias("g"), F.avg(F.col("got") / F.col("there")).alias("mean")).first()
    return min(s["g"] / s["t"], s["mean"]) if s["t"] else 1.0


def vector_groups(table: DataFrame, cosine: float = COSINE, overlap: int = OVERLAP, shard: int = SHARD, cap: int = CAP, target: float = TARGET, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of the table."""
    bound_batches(table.sparkSession)
    clean = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("embedding"))
    clean = materialize(clean.mapInArrow(_clean, "vec_id long, label string, h1 long, h2 long, vec binary"), "vec-clean")
    key = ["label", "h1", "h2"]
    classes = clean.where("vec is not null").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    classes = materialize(classes, "vec-classes")
    total = classes.count()
    while True:
        links = _index(classes, total, cosine, overlap, shard, cap)
        if audit_recall(classes, links, total, cosine) >= target:
            break
        if overlap >= 8:  # the graph does not find enough: all chunks of a label against each other, exactly
            links = _index(classes, total, cosine, 1, shard, cap, exact=True)
            break
        overlap = min(8, overlap + 2)
    parts = connected_components(links.where("b is not null"), "a", "b")
    counts = links.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    known = classes.drop("vec").join(counts, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select(*key, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = clean.drop("vec").join(known, key, "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
