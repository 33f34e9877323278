"""SimHash near-dedup by multi-index hashing over Hamming balls.

Fingerprint: A-Z lower-cased, words [^\\x20\\x09-\\x0D]+, 4-word shingles with
repeats (fewer words: the whole sequence; none: fingerprint zero), XXH64 with
seed 42; a bit is 1 if it is set in over half of the hashes.

Linking at a distance of 4 or less: a fingerprint has two 32-bit segments, so
one segment of a linked pair differs in 2 bits at most, and then the balls of
radius 1 around both segments share a point. Each distinct fingerprint goes to
the 33 points of the ball of each segment (66 rows); fingerprints that meet at
a point are table matches, whose complete distances are verified. A bucket
gives the edges of a spanning forest of its verified links, never its pairs.
A task holds a bucket's distinct fingerprints, 8 bytes each, and compares them
in blocks against blocks; no candidate is dropped. A bucket's work grows with the
square of the distinct fingerprints that share a 32-bit segment but for a bit.

Defined cases: null text has fingerprint zero; rows with a null doc_id belong
to the component of their fingerprint and do not name it; repeated ids and
texts fall together; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.components import connected_components
from millrace.llm.text import words
from millrace.runtime import bound_batches, fresh, materialize

SHINGLE, SEED, DISTANCE, BLOCK = 4, 42, 4, 4096
#: Bits of each byte value, lowest first: one row of votes for a byte.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_HASH = xxhash.xxh64_intdigest


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint."""
    w = words(text)
    if not w:
        return 0
    if len(w) <= k:
        return _HASH(b" ".join(w), SEED)
    size = np.fromiter(map(len, w), np.int64, len(w))
    end = np.cumsum(size + 1) - 1
    start, joined = end - size, b" ".join(w)
    shingles = [joined[a:b] for a, b in zip(start[: 1 - k].tolist(), end[k - 1 :].tolist(), strict=True)]
    h = np.fromiter(map(_HASH, shingles, repeat(SEED)), np.uint64, len(shingles)).view(np.uint8).reshape(-1, 8)
    votes = np.concatenate([np.bincount(h[:, c], minlength=256) @ _BITS for c in range(8)])
    return int(np.packbits(2 * votes > len(shingles), bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def _fingerprints(text: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t) for t in text.to_pylist()], dtype=np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), _fingerprints(F.col(text_col)).alias("fp"))


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.concatenate([[0], 1 << np.arange(32)]).astype(np.uint64)
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        u = fp.view(np.uint64)
        low, high = (u & np.uint64(0xFFFFFFFF))[:, None] ^ flips, ((u >> np.uint64(32))[:, None] ^ flips) | np.uint64(1 << 32)
        for point in (low, high):
            yield pa.record_batch([pa.array(point.ravel().view(np.int64)), pa.array(np.repeat(fp, len(flips)))], names=["point", "fp"])


def _forest(fps: np.ndarray, distance: int, block: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, block against block."""
    root = np.arange(len(fps))
    u = fps.view(np.uint64)
    for i in range(0, len(fps), block):
        for a in range(i, min(i + block, len(fps))):
            for j in range(a + 1, len(fps), block):
                hit = np.flatnonzero(np.bitwise_count(u[j : j + block] ^ u[a]) <= distance) + j
                new = hit[root[hit] != root[a]]
                while len(new):
                    yield int(fps[a]), int(fps[new[0]])
                    root[root == root[new[0]]] = root[a]
                    new = new[root[new] != root[a]]


def _linker(distance: int, block: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by point. A run that a batch cuts in two is carried over."""
        held_p, held_f = np.empty(0, np.int64), np.empty(0, np.int64)
        seen: set[tuple[int, int]] = set()

        def flush(point: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            nonlocal seen
            cut = np.flatnonzero(np.diff(point)) + 1
            lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(point)]])
            many = np.flatnonzero(hi - lo > 1)
            if len(seen) > 500_000:
                seen = set()
            new = []
            for s, e in zip(lo[many].tolist(), hi[many].tolist(), strict=True):
                for pair in _forest(np.sort(fp[s:e]), distance, block):
                    if pair not in seen:
                        seen.add(pair)
                        new.append(pair)
            return pa.record_batch([pa.array([x[0] for x in new], pa.int64()), pa.array([x[1] for x in new], pa.int64())], names=["a", "b"])

        for b in batches:
            point = np.concatenate([held_p, b.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([held_f, b.column(1).to_numpy(zero_copy_only=False)])
            if not len(point):
                continue
            last = int(np.searchsorted(point, point[-1], "left"))
            held_p, held_f = point[last:].copy(), fp[last:].copy()
            if last:
                yield flush(point[:last], fp[:last])
        if len(held_p):
            yield flush(held_p, held_f)

    return link


def hamming_links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(a, b): links of distinct fingerprints (column fp) that hold their components together."""
    if distance > 4:
        raise ValueError("two segments with balls of radius 1 reach a distance of 4")
    points = fps.select("fp").mapInArrow(_balls, "point long, fp long")
    return points.repartition("point").sortWithinPartitions("point").mapInArrow(_linker(distance, block), "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable by links."""
    spark = docs.sparkSession
    bound_batches(spark)
    prints = materialize(fingerprints(docs, id_col, text_col), "simhash")
    firsts = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-first")
    parts = connected_components(hamming_links(firsts, distance))
    named = parts.join(firsts, parts["node"] == firsts["fp"]).select("fp", "component", "first")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    label = named.join(least, "component").select("fp", "component_id")
    whole = firsts.join(label, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return prints.join(whole, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """docs without the rows that are not the first of their component.

    Rows with a null id stay. Of rows that repeat a kept id all stay.
    """
    groups = simhash_groups(docs, id_col, text_col, distance)
    mark = fresh("gone", docs)
    gone = groups.where("doc_id > component_id").select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(gone, docs[id_col] == gone[mark], "left_anti")
