"""Line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line with [\\x20\\x09-\\x0D] stripped at both ends and A-Z
lower-cased. A key of at least `min_chars` code points held by two documents
or more stays only in the document with the smallest id that holds it.

Batch flow: (1) each document gives one reference row per distinct key
(128-bit hash); (2) one aggregation with map-side combine gives the exact
reference-count table (count, smallest and largest document); (3) the keys
held by two documents or more are dealt over shards, and each shard's task
builds a cuckoo filter over its keys, streams the shard's references through
it and confirms the filter's positives in the exact table; (4) the confirmed
references go back to their documents, which drop those lines. A shard with
many references is dealt over several tasks, each with its own copy of the
filter, so that one very common line is no one task's burden.

`LineIndex` is the incremental form: filters and exact references stay in a
folder, insertions and deletions update both, and a deletion undoes an insertion.

Defined cases: null or empty text is one empty line; a null doc_id owns and
loses nothing; rows that repeat a doc_id are the same document; an empty table
gives an empty result; a column that clashes with an output is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.text import WS, key128
from millrace.runtime import bound_batches, fresh, materialize

MIN_CHARS = 10
SHARD_KEYS = 50_000
PART_REFS = 200_000


class CuckooFilter:
    """Cuckoo filter of 16-bit fingerprints, four to a bucket, with deletion.

    Vectorised lookups; insertion kicks entries about and stashes one that it
    cannot place, so it never loses a key. Items are (h1, h2) pairs of
    longs; the exact hashes are kept by the caller's reference table.
    """

    SLOTS, KICKS = 4, 200

    def __init__(self, capacity: int):
        self.n = 1 << max(1, math.ceil(math.log2(max(1, capacity) / (self.SLOTS * 0.8) + 1)))
        self.table = np.zeros((self.n, self.SLOTS), dtype=np.uint16)
        self.stash: list[tuple[int, int]] = []

    def dump(self) -> bytes:
        return self.table.tobytes() + np.array(self.stash, dtype=np.int64).tobytes()

    @classmethod
    def load(cls, n: int, data: bytes) -> CuckooFilter:
        """A filter of n buckets out of what `dump` gave."""
        made, size = cls(1), n * cls.SLOTS * 2
        made.n, made.table = n, np.frombuffer(data[:size], dtype=np.uint16).reshape(n, cls.SLOTS).copy()
        made.stash = [tuple(p) for p in np.frombuffer(data[size:], dtype=np.int64).reshape(-1, 2).tolist()]
        return made

    def entries(self) -> list[tuple[int, int]]:
        """(fingerprint, lesser of its two buckets) of each entry, sorted: the same however entries were kicked about."""
        at, s = np.nonzero(self.table)
        found = [(int(f), int(i)) for f, i in zip(self.table[at, s], at, strict=True)] + self.stash
        return sorted((f, min(i, i ^ int(self._jump(f)))) for f, i in found)

    def _place(self, h1, h2):
        h1, h2 = np.asarray(h1, dtype=np.int64).view(np.uint64), np.asarray(h2, dtype=np.int64).view(np.uint64)
        fp = (h2 >> np.uint64(48)).astype(np.uint16)
        fp = np.where(fp == 0, np.uint16(1), fp)
        i = (h1 & np.uint64(self.n - 1)).astype(np.int64)
        return fp, i, i ^ self._jump(fp)

    def _jump(self, fp):
        return ((np.asarray(fp).astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(self.n - 1)).astype(np.int64)

    def insert(self, h1, h2) -> None:
        fps, a, b = self._place(np.atleast_1d(h1), np.atleast_1d(h2))
        for fp, i, j in zip(fps.tolist(), a.tolist(), b.tolist(), strict=True):
            self._put(fp, i, j)

    def _put(self, fp: int, i: int, j: int) -> None:
        for at in (i, j):
            row = self.table[at]
            for s in range(self.SLOTS):
                if row[s] == 0:
                    row[s] = fp
                    return
        for k in range(self.KICKS):
            s = k % self.SLOTS
            fp, self.table[j, s] = int(self.table[j, s]), fp
            j ^= int(self._jump(fp))
            row = self.table[j]
            for s in range(self.SLOTS):
                if row[s] == 0:
                    row[s] = fp
                    return
        self.stash.append((fp, j))

    def delete(self, h1, h2) -> None:
        """Remove one copy of each item; the items must have been inserted."""
        fps, a, b = self._place(np.atleast_1d(h1), np.atleast_1d(h2))
        for fp, i, j in zip(fps.tolist(), a.tolist(), b.tolist(), strict=True):
            for at in (i, j):
                hit = np.flatnonzero(self.table[at] == fp)
                if len(hit):
                    self.table[at, hit[0]] = 0
                    break
            else:
                self.stash = [x for k, x in enumerate(self.stash) if k != next((m for m, y in enumerate(self.stash) if y[0] == fp and y[1] in (i, j)), -1)]

    def contains(self, h1, h2) -> np.ndarray:
        fp, i, j = self._place(h1, h2)
        hit = (self.table[i] == fp[:, None]).any(1) | (self.table[j] == fp[:, None]).any(1)
        for f, at in self.stash:
            hit |= (fp == f) & ((i == at) | (j == at))
        return hit


def line_keys(text: str, min_chars: int) -> set[tuple[int, int]]:
    keys = {k for line in text.split("\n") if len(k := line.strip(WS)) >= min_chars}
    return {key128(k) for k in {k.encode().lower() for k in keys}}


REFS = T.StructType([T.StructField("doc", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])


def references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, h1, h2): one row for each distinct key of each document row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, h1, h2 = [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for x, y in line_keys(t, min_chars):
                    doc.append(d)
                    h1.append(x)
                    h2.append(y)
            yield pa.record_batch([pa.array(x, pa.int64()) for x in (doc, h1, h2)], names=["doc", "h1", "h2"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null and text is not null")
    return narrow.mapInArrow(scan, REFS)


def reference_counts(refs: DataFrame) -> DataFrame:
    """The exact table: (h1, h2, refs, first_doc, last_doc)."""
    return refs.groupBy("h1", "h2").agg(F.count("*").alias("refs"), F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, part, kind): a shard's keys (kind 0), then its references (kind 1)."""
    at, keys, filt, table = None, [], None, None
    for b in batches:
        shard, part, kind, h1, h2, doc = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        if not len(shard):
            continue
        cut = np.flatnonzero(np.diff(shard) | np.diff(part) | np.diff(kind)) + 1
        for lo, hi in zip([0, *cut], [*cut, len(shard)], strict=True):
            if at != (shard[lo], part[lo]):
                at, keys, filt, table = (shard[lo], part[lo]), [], None, None
            if kind[lo] == 0:
                keys.append((h1[lo:hi].copy(), h2[lo:hi].copy(), doc[lo:hi].copy()))
                continue
            if filt is None:
                if not keys:
                    continue
                k1, k2, first = (np.concatenate(x) for x in zip(*keys, strict=True))
                order = np.lexsort((k2, k1))
                table = (k1[order], k2[order], first[order])
                filt = CuckooFilter(len(k1))
                filt.insert(k1, k2)
            a, c, d = h1[lo:hi], h2[lo:hi], doc[lo:hi]
            hit = filt.contains(a, c)
            a, c, d = a[hit], c[hit], d[hit]
            pos = np.searchsorted(table[0], a, "left")
            drop, todo = np.zeros(len(a), bool), np.ones(len(a), bool)
            while todo.any():  # keys that share h1 follow one another
                p = np.minimum(pos, len(table[0]) - 1)
                todo &= (pos < len(table[0])) & (table[0][p] == a)
                found = todo & (table[1][p] == c)
                drop |= found & (table[2][p] < d)
                todo &= ~found
                pos = pos + 1
            if drop.any():
                key = [x.tobytes() + y.tobytes() for x, y in zip(a[drop], c[drop], strict=True)]
                yield pa.record_batch([pa.array(d[drop]), pa.array(key, pa.binary())], names=["doc", "key"])


def drops(refs: DataFrame, shard_keys: int = SHARD_KEYS, part_refs: int = PART_REFS) -> DataFrame:
    """(doc, key): the references that go. refs must be a stored table: it is read twice."""
    counts = materialize(reference_counts(refs).where("first_doc < last_doc"), "line-dups")
    shards = max(1, math.ceil(counts.count() / shard_keys))
    shard = F.pmod(F.col("h2"), F.lit(shards)).alias("shard")
    load = counts.select(shard, "refs").groupBy("shard").agg(F.ceil(F.sum("refs") / part_refs).cast("int").alias("parts"))
    keys = counts.select(shard, "h1", "h2", F.col("first_doc").alias("doc")).join(load, "shard")
    keys = keys.select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "h1", "h2", "doc")
    held = refs.select(shard, "h1", "h2", "doc").join(load, "shard")
    held = held.select("shard", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "h1", "h2", "doc")
    both = keys.union(held).repartition("shard", "part").sortWithinPartitions("shard", "part", "kind")
    return both.mapInArrow(_confirm, "doc long, key binary")


KEPT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])


def _without(min_chars: int):
    @F.arrow_udf(KEPT)
    def without(text: pa.Array, gone: pa.Array) -> pa.Array:
        out, total, dropped = [], [], []
        for t, g in zip(text.to_pylist(), gone.to_pylist(), strict=True):
            lines = (t or "").split("\n")
            keep = lines
            if g:
                g = set(g)
                keep = [x for x in lines if len(k := x.strip(WS)) < min_chars or b"".join(v.to_bytes(8, "little", signed=True) for v in key128(k.encode().lower())) not in g]
            out.append("\n".join(keep) if g else (t or ""))
            total.append(len(lines))
            dropped.append(len(lines) - len(keep))
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], names=["text", "n_lines", "n_dropped"])

    return without.asNondeterministic()  # else a filter on its result runs it a second time


def drop_lines(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with text_col replaced, n_lines and n_dropped set. gone: (doc, key)."""
    doc, keys, kept = (fresh(name, docs) for name in ("doc", "gone", "kept"))
    mine = gone.groupBy(F.col("doc").alias(doc)).agg(F.collect_set("key").alias(keys))
    cols = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    wide = docs.select(*cols).join(mine, docs[id_col] == mine[doc], "left").withColumn(kept, _without(min_chars)(F.col(text_col), F.col(keys)))
    return wide.select(*[F.col(kept)["text"].alias(c) if c == text_col else F.col(c) for c in cols], F.col(kept)["n_lines"].alias("n_lines"), F.col(kept)["n_dropped"].alias("n_dropped"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """docs without repeated lines, and n_lines (before), n_dropped."""
    bound_batches(docs.sparkSession)
    refs = materialize(references(docs, id_col, text_col, min_chars), "line-refs")
    return drop_lines(docs, drops(refs), id_col, text_col, min_chars)


FILTERS = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("slots", T.IntegerType()), T.StructField("held", T.LongType()), T.StructField("filter", T.BinaryType())])
DOCS = T.StructType([T.StructField("doc", T.LongType()), T.StructField("delta", T.IntegerType()), T.StructField("shards", T.ArrayType(T.IntegerType()))])
PROBED = "h1 long, h2 long, maybe boolean"


def _opened(row: pa.Table) -> CuckooFilter:
    return CuckooFilter.load(row["slots"][0].as_py(), row["filter"][0].as_py())


def _pairs(keys: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return keys["h1"].to_numpy(), keys["h2"].to_numpy()


def _probe(filters: pa.Table, keys: pa.Table) -> pa.Table:
    maybe = _opened(filters).contains(*_pairs(keys)) if keys.num_rows and filters.num_rows else np.zeros(keys.num_rows, bool)
    return pa.table({"h1": keys["h1"], "h2": keys["h2"], "maybe": pa.array(maybe)})


def _updated(delete: bool):
    def update(filters: pa.Table, keys: pa.Table) -> pa.Table:
        if not filters.num_rows:
            raise ValueError("a key of a shard without a filter")
        f, held = _opened(filters), filters["held"][0].as_py()
        if keys.num_rows:
            (f.delete if delete else f.insert)(*_pairs(keys))
            held += -keys.num_rows if delete else keys.num_rows
        return pa.table({"shard": filters["shard"], "slots": filters["slots"], "held": pa.array([held], pa.int64()), "filter": pa.array([f.dump()], pa.binary())})

    return update


class LineIndex:
    """A reversible index of line references in a folder: sharded cuckoo filters over an exact log.

    A version is what one call adds: `refs/vN`, (doc, h1, h2, delta) sorted by shard of
    the key, +1 for what an insertion adds and -1 for what a deletion takes; `docs/vN`,
    the documents concerned and the shards that hold their references; and
    `filters/vN`, a cuckoo filter for each shard with one entry for each distinct key
    that some document holds. The filters are written last, and a version counts once
    they are complete: a call that was stopped left nothing that is read, and is
    repeated as it was.

    insert probes the new documents' keys in the filters: a key that the filter
    lacks is new for certain, and only those it may hold are looked up, in the logs of
    their shards. New keys are entered. delete reads the shards of its documents and
    takes out the keys that no other document holds. So after an insertion and its
    deletion filters and counts are what they were. Shards whose filter would fill over
    `LOAD` are built anew, twice as large, from their exact keys. `compact` writes
    the state as one log, which later calls start from.

    Documents that are held already, and null ids and texts, are not inserted.
    """

    LOAD = 0.85

    def __init__(self, spark: SparkSession, path: str, shards: int = 16, capacity: int = SHARD_KEYS):
        self.spark, self.path, self.shards = spark, path, shards
        refs = [*REFS.fields, T.StructField("delta", T.IntegerType()), T.StructField("shard", T.IntegerType())]
        self.schemas = {"refs": T.StructType(refs), "docs": DOCS, "filters": FILTERS}
        if self.version() < 0:
            empty = CuckooFilter(capacity)
            none = spark.createDataFrame([], T.StructType(refs[:4]))
            self._write(none, spark.createDataFrame([(k, empty.n, 0, bytearray(empty.dump())) for k in range(shards)], FILTERS))

    def _versions(self, what: str) -> list[int]:
        """The complete versions of a folder, in order."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        root = hadoop(f"{self.path}/{what}")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(p.getName()[1:]) for p in found if fs.exists(hadoop(p, "_SUCCESS")))

    def version(self) -> int:
        """The newest complete version; -1 if there is none."""
        return max(self._versions("filters"), default=-1)

    def _live(self, what: str) -> list[str]:
        """The folders of a log that make up the state: the newest whole one and what came after it."""
        now = self.version()
        whole = max((v for v in self._versions("whole") if v <= now), default=0)
        return [f"{self.path}/{what}/v{v}" for v in range(whole, now + 1)]

    def _log(self, what: str, shards: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(self.schemas[what]).parquet(*self._live(what))
        return rows if shards is None else rows.where(F.col("shard").isin(shards))

    def filters(self) -> DataFrame:
        return self.spark.read.schema(FILTERS).parquet(f"{self.path}/filters/v{self.version()}")

    def state(self, shards: list[int] | None = None) -> DataFrame:
        """(doc, h1, h2) of what is held, in some shards or all."""
        return self._log("refs", shards).groupBy("doc", "h1", "h2").agg(F.sum("delta").alias("n")).where("n > 0").select("doc", "h1", "h2")

    def documents(self) -> DataFrame:
        """(doc, shards) of the documents held."""
        return self._log("docs").groupBy("doc").agg(F.sum("delta").alias("n"), F.array_distinct(F.flatten(F.collect_list("shards"))).alias("shards")).where("n > 0").select("doc", "shards")

    def counts(self) -> DataFrame:
        """The exact reference counts of what is held."""
        return reference_counts(self.state())

    def _shard(self) -> Column:
        return F.pmod("h2", F.lit(self.shards)).cast("int")

    def _sharded(self, keys: DataFrame) -> DataFrame:
        return keys.select("h1", "h2", self._shard().alias("shard"))

    def _touched(self, keys: DataFrame) -> list[int]:
        return [r[0] for r in keys.select(self._shard()).distinct().collect()]  # at most a row a shard

    def _with_filters(self, filters: DataFrame, keys: DataFrame, f, schema) -> DataFrame:
        return filters.groupBy("shard").cogroup(self._sharded(keys).groupBy("shard")).applyInArrow(f, schema)

    def _write(self, refs: DataFrame, filters: DataFrame, whole: bool = False) -> None:
        """The next version, of refs (doc, h1, h2, delta); its filters, which complete it, come last."""
        n = self.version() + 1
        sharded = refs.withColumn("shard", self._shard())
        sharded.repartitionByRange("shard").sortWithinPartitions("shard").write.mode("overwrite").parquet(f"{self.path}/refs/v{n}")
        docs = sharded.groupBy("doc").agg(F.max("delta").alias("delta"), F.array_sort(F.collect_set("shard")).alias("shards"))
        docs.write.mode("overwrite").parquet(f"{self.path}/docs/v{n}")
        if whole:
            self.spark.createDataFrame([(n,)], "version int").write.mode("overwrite").parquet(f"{self.path}/whole/v{n}")
        filters.write.mode("overwrite").parquet(f"{self.path}/filters/v{n}")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        bound_batches(self.spark)
        new = references(docs, id_col, text_col).distinct().join(self.documents().select("doc"), "doc", "left_anti")
        new = materialize(new, "line-new")
        probed = materialize(self._with_filters(self.filters(), new.select("h1", "h2").distinct(), _probe, PROBED), "line-probed")
        maybe = probed.where("maybe").select("h1", "h2")
        known = maybe.join(self.state(self._touched(maybe)).select("h1", "h2"), ["h1", "h2"], "left_semi")
        fresh = materialize(probed.select("h1", "h2").join(known, ["h1", "h2"], "left_anti"), "line-fresh")
        filters, keys = self._roomy(fresh)
        self._write(new.select("doc", "h1", "h2", F.lit(1).alias("delta")), self._with_filters(filters, keys, _updated(False), FILTERS))

    def _roomy(self, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The filters and the keys to enter; shards that would be too full begin anew with all their keys."""
        filters = self.filters()
        more = self._sharded(fresh).groupBy("shard").agg(F.count("*").alias("more"))
        room = F.col("slots") * (CuckooFilter.SLOTS * self.LOAD)
        full = [r.asDict() for r in filters.join(more, "shard").where(F.col("held") + F.col("more") > room).select("shard", (F.col("held") + F.col("more")).alias("n")).collect()]  # at most a row a shard
        if not full:
            return filters, fresh
        bare = [(r["shard"], (e := CuckooFilter(2 * r["n"])).n, 0, bytearray(e.dump())) for r in full]
        over = [r["shard"] for r in full]
        rest = filters.where(~F.col("shard").isin(over))
        again = self.state(over).select("h1", "h2").distinct()
        return rest.union(self.spark.createDataFrame(bare, FILTERS)), fresh.union(again).distinct()

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> None:
        bound_batches(self.spark)
        gone = ids.select(F.col(id_col).cast("long").alias("doc")).distinct().join(self.documents(), "doc")
        gone = materialize(gone, "line-deleted")
        shards = [r[0] for r in gone.select(F.explode("shards")).distinct().collect()]  # at most a row a shard
        state = self.state(shards)
        refs = materialize(state.join(gone.select("doc"), "doc", "left_semi"), "line-gone")
        left = state.join(gone.select("doc"), "doc", "left_anti").select("h1", "h2")
        dead = materialize(refs.select("h1", "h2").distinct().join(left, ["h1", "h2"], "left_anti"), "line-dead")
        self._write(refs.select("doc", "h1", "h2", F.lit(-1).alias("delta")), self._with_filters(self.filters(), dead, _updated(True), FILTERS))

    def compact(self) -> None:
        """Write the state as one log; later calls read nothing before it."""
        self._write(materialize(self.state(), "line-whole").withColumn("delta", F.lit(1)), materialize(self.filters(), "line-filters"), whole=True)

    def drops(self) -> DataFrame:
        """The references that go in the present state, as in the batch form."""
        return drops(materialize(self.state(), "line-state"))
