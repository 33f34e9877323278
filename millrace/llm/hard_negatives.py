"""Hard-negative mining on one-dimensional distance keys.

Components become integers, so scores are exact integer inner products. A vector
x is augmented by sqrt(M - |x|^2), M the largest squared length, and a query by 0;
then the squared distance of query and row is |q|^2 + M - 2 score: the largest
scores are the nearest rows. A row's key is (pivot, distance to it), its pivot
being the nearest of some centres. Rows are stored sorted by key, in cells of
consecutive keys of one pivot.

A row within r of a query has a distance to its pivot within r of the query's own
distance to that pivot. So a search scans, for every pivot, the cells that an
interval of keys meets, doubles r, scans the new annuli only, and ends when no
unseen row can be nearer than the k-th found. Searches start from a bound: the
k-th best of a sample of the rows is a score that the k-th best of all can't be
under. Searches of a round are joined to the cells in Spark, and a cell meets at
most `TOGETHER` searches in one task, so neither side of a group is unbounded;
equal keys spread over as many cells as they fill.

Pivots are fitted on the sample (at most `SAMPLE` rows, chosen by hash); every
row is indexed and results are exact whatever the sample is.

Defined cases: a row with a null id, label or vector, or a component that is
null, not finite or 2^22 or more in size, takes no part. Shorter vectors count as
filled up with zeros. An anchor is one search however often its id stands there
(the least label and vector counts); other repeated rows count each, and no row
is a partner of its own id. An empty table gives an empty result. Ids are
integers; other columns are ignored. Scores are exact to 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.retrieval import top
from millrace.runtime import materialize

SCALE, LARGEST = 256, 2.0**22
PIVOTS, SAMPLE, CELL, TOGETHER = 64, 20_000, 1024, 2048
SEARCH = ["anchor", "slot"]


def unpack(vectors: pa.Array, dim: int) -> np.ndarray:
    """Binary int32 vectors, the shorter ones filled up, as rows of doubles."""
    raw = [v.ljust(4 * dim, b"\0") for v in vectors.to_pylist()]
    return np.frombuffer(b"".join(raw), "<i4").reshape(-1, dim).astype(np.float64)


def whole_vectors(vectors: DataFrame, label: Column) -> DataFrame:
    """(vec_id, label, vec, norm) of the rows that take part; vec holds 32-bit integers, norm is the squared length."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ints = [np.floor(SCALE * np.array(v, dtype=np.float64)) for v in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([v.astype("<i4").tobytes() for v in ints], pa.binary()), pa.array([float(v @ v) for v in ints], pa.float64())], names=["vec_id", "label", "vec", "norm"])

    return rows.mapInArrow(pack, "vec_id long, label long, vec binary, norm double")


def centres(points: np.ndarray, n: int, seed: int = 7, rounds: int = 5) -> np.ndarray:
    """Centres of points by Lloyd's rounds; a centre that loses all its points stays where it is."""
    rng = np.random.default_rng(seed)
    out = points[rng.choice(len(points), min(n, len(points)), replace=False)]
    for _ in range(rounds):
        near = ((out**2).sum(1) - 2 * points @ out.T).argmin(1)
        held = np.bincount(near, minlength=len(out))
        sums = np.zeros_like(out)
        np.add.at(sums, near, points)
        out = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], out)
    return out


@dataclass(frozen=True)
class KeyIndex:
    """Rows (cell, pivot, key, vec_id, label, vec) stored by key, and the interval of keys of each cell."""

    rows: DataFrame
    cells: DataFrame
    dim: int
    largest: float
    pivots: np.ndarray
    sample: tuple[np.ndarray, np.ndarray, np.ndarray]  # ids, labels, vectors


def build(packed: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE, cell: int = CELL) -> KeyIndex | None:
    """The index of packed (vec_id, label, vec, norm); None if there are no rows."""
    spark = packed.sparkSession
    whole = packed.agg(F.max(F.octet_length("vec")).alias("bytes"), F.max("norm").alias("norm")).first()
    if whole["norm"] is None:
        return None
    dim, largest = max(1, whole["bytes"] // 4), whole["norm"]
    some = packed.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    points, norms = unpack(some["vec"].combine_chunks(), dim), some["norm"].to_numpy()
    augmented = np.column_stack([points, np.sqrt(np.maximum(largest - norms, 0))])
    middle = centres(augmented, pivots)
    sent = spark.sparkContext.broadcast(middle)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for b in batches:
            n2 = b.column(3).to_numpy()
            x = np.column_stack([unpack(b.column(2), dim), np.sqrt(np.maximum(largest - n2, 0))])
            near = ((p**2).sum(1) - 2 * x @ p.T).argmin(1) if len(x) else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(near.astype(np.int32)), pa.array(np.linalg.norm(x - p[near], axis=1)), *b.columns[:3]], names=["pivot", "key", "vec_id", "label", "vec"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pivot, held = TaskContext.get().partitionId() << 32, None, 0
        for b in batches:
            p = b.column(0).to_numpy()
            out = np.empty(len(p), np.int64)
            for run in np.split(np.arange(len(p)), np.flatnonzero(np.diff(p)) + 1):
                if not len(run):
                    continue
                if p[run[0]] != pivot:
                    now, pivot, held = now + 1, p[run[0]], 0
                out[run] = now + (held + np.arange(len(run))) // cell
                now, held = now + (held + len(run)) // cell, (held + len(run)) % cell
            yield pa.record_batch([pa.array(out), *b.columns], names=["cell", *b.schema.names])

    kind = "pivot int, key double, vec_id long, label long, vec binary"
    keyed = packed.mapInArrow(key, kind).repartitionByRange("pivot", "key", "vec_id").sortWithinPartitions("pivot", "key", "vec_id")
    rows = materialize(keyed.mapInArrow(deal, f"cell long, {kind}"), "keys")
    cells = materialize(rows.groupBy("cell").agg(F.first("pivot").alias("pivot"), F.min("key").alias("low"), F.max("key").alias("high")), "cells")
    return KeyIndex(rows, cells, dim, largest, middle, (some["vec_id"].to_numpy(), some["label"].to_numpy(), points))


def _radius(index: KeyIndex, norm: Column, score: Column) -> Column:
    """The distance at which a row with this score lies."""
    return F.sqrt(F.greatest(norm + index.largest - 2 * score, F.lit(0.0)))


def _bounded(index: KeyIndex, searches: DataFrame, k: int) -> DataFrame:
    """searches with `least`, a score that the k-th best can't be under, the radius `cap` it gives, and the distances `away` of all pivots."""
    sent = searches.sparkSession.sparkContext.broadcast((index.pivots, *index.sample))
    dim = index.dim

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, ids, labels, points = sent.value
        for whole in batches:
            for i in range(0, len(whole), 128):
                b = whole.slice(i, 128)
                c = {n: b.column(j) for j, n in enumerate(b.schema.names)}
                q = unpack(c["vec"], dim)
                s = q @ points.T
                low, high = c["low"].to_numpy().astype(float)[:, None], c["high"].to_numpy().astype(float)[:, None]
                same = c["same"].to_numpy(zero_copy_only=False)[:, None]
                ok = ((labels[None] == c["label"].to_numpy()[:, None]) == same) & (ids[None] != c["anchor"].to_numpy()[:, None]) & (s >= low) & (s <= high)
                s = np.where(ok, s, -np.inf)
                least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(s), -np.inf)
                far = np.sqrt(np.maximum((q**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * q @ pivots[:, :dim].T, 0))
                yield pa.record_batch([*b.columns, pa.array(np.maximum(least, low[:, 0])), pa.array(list(far), pa.list_(pa.float64()))], names=[*b.schema.names, "least", "away"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in searches.schema.fields)
    known = searches.mapInArrow(bound, f"{kind}, least double, away array<double>")
    return known.withColumn("cap", F.least(_radius(index, F.col("norm"), F.col("least")), F.sqrt("norm") + index.largest**0.5))


def nearest(index: KeyIndex, searches: DataFrame, k: int, start: float = 0.25, together: int = TOGETHER) -> DataFrame:
    """(anchor, slot, rank, vec_id, score): the k best rows of each search, exactly.

    searches (anchor, slot, vec, norm, label, same, low, high): rows of the same
    label or of others, with a score from low to high, without the id `anchor`.
    """
    spark, dim = searches.sparkSession, index.dim

    def scan(rows: pa.Table, asked: pa.Table) -> pa.Table:
        ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        anchors = asked["anchor"].to_numpy()
        _, at, back = np.unique(anchors, return_index=True, return_inverse=True)
        s = (unpack(asked["vec"].take(at).combine_chunks(), dim) @ unpack(rows["vec"].combine_chunks(), dim).T)[back]
        low = np.maximum(asked["low"].to_numpy(), asked["least"].to_numpy())
        ok = (s >= low[:, None]) & (s <= asked["high"].to_numpy()[:, None]) & (ids[None] != anchors[:, None])
        ok &= (labels[None] == asked["label"].to_numpy()[:, None]) == asked["same"].to_numpy()[:, None]
        j, i = np.nonzero(ok)
        order = np.lexsort((ids[i], -s[j, i], j))
        j, i = j[order], i[order]
        rank = np.arange(len(j)) - np.searchsorted(j, j)
        j, i = j[rank < k], i[rank < k]
        return pa.table({"anchor": anchors[j], "slot": asked["slot"].to_numpy()[j], "vec_id": ids[i], "score": s[j, i].astype(np.int64)})

    open_ = materialize(_bounded(index, searches, k).withColumns({"seen": F.lit(-1.0), "r": F.col("cap") * start}), "searches")
    found: list[DataFrame] = []
    while n := open_.count():
        groups = -(-n // together)
        slack = (F.col("r") + 1) * 1e-6
        ask = open_.select(*SEARCH, "seen", "r", F.posexplode("away").alias("pivot", "d"))
        reach = lambda r: (F.col("high") >= F.col("d") - r - slack) & (F.col("low") <= F.col("d") + r + slack)
        before = (F.col("seen") >= 0) & reach(F.col("seen"))
        pairs = ask.join(index.cells, "pivot").where(reach(F.col("r")) & ~before).select(*SEARCH, "cell", F.pmod(F.xxhash64("anchor"), F.lit(groups)).alias("g"))
        pairs = materialize(pairs, "pairs")
        left = index.rows.join(pairs.select("cell", "g").distinct(), "cell").select(F.col("cell").alias("c"), F.col("g").alias("h"), "vec_id", "label", "vec")
        right = pairs.join(open_.select(*SEARCH, "vec", "label", "same", "low", "high", "least"), SEARCH)
        got = left.groupBy("c", "h").cogroup(right.groupBy("cell", "g")).applyInArrow(scan, "anchor long, slot int, vec_id long, score long")
        found.append(materialize(got, "found"))
        best = top(reduce(DataFrame.union, found), SEARCH, [F.desc("score"), F.col("vec_id")], k)
        last = best.where(F.col("rank") == k).select(*SEARCH, F.col("score").alias("_kth"))
        nearer = F.when(F.col("_kth").isNull(), F.col("cap")).otherwise(_radius(index, F.col("norm"), F.col("_kth")))  # greatest() skips nulls
        kept = open_.join(last, SEARCH, "left").withColumn("cap", F.least("cap", nearer)).where("cap > r")
        open_ = materialize(kept.withColumns({"seen": F.col("r"), "r": F.least("cap", F.col("r") * 2)}).drop("_kth"), "searches")
    if not found:
        return spark.createDataFrame([], "anchor long, slot int, vec_id long, score long, rank int")
    return top(reduce(DataFrame.union, found), SEARCH, [F.desc("score"), F.col("vec_id")], k)


def mine_negatives(vectors: DataFrame, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, pivots: int = PIVOTS, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each anchor its `positives` best rows of the same label; for each of them
    the `negatives` best rows of other labels whose score is `low` to `high` per
    cent of the positive's.
    """
    packed = materialize(whole_vectors(vectors, label), "vectors")
    index = build(packed, pivots, sample, cell)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors = packed.where(is_anchor).groupBy(F.col("vec_id").alias("anchor")).agg(F.min(F.struct("label", "vec", "norm")).alias("a")).select("anchor", "a.*")
    anchors = materialize(anchors, "anchors")
    side = lambda same, lo, hi: [F.lit(same).alias("same"), lo.cast("double").alias("low"), hi.cast("double").alias("high")]
    every = anchors.select("anchor", F.lit(0).alias("slot"), "vec", "norm", "label", *side(True, F.lit(float("-inf")), F.lit(float("inf"))))
    good = materialize(nearest(index, every, positives), "positives")
    pairs = good.where("score >= 0").select("anchor", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # 100 n >= low p and 100 n <= high p, in whole numbers.
    first, last = F.expr(f"(positive_score * {low} + 99) div 100"), F.expr(f"positive_score * {high} div 100")
    asked = pairs.join(anchors, "anchor").select("anchor", "slot", "vec", "norm", "label", *side(False, first, last))
    bad = nearest(index, asked, negatives)
    return bad.join(pairs, SEARCH).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
