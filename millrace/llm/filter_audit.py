"""Filter interaction audit: what each filter removes at each place of each order of the filters.

A document's failures are a mask of five bits. A table, computed once, says for
each of the 32 masks and 120 orders at which step a document goes (5: never).
mapInArrow indexes the table by the documents' masks, np.bincount counts removals
by part, order and step, for all documents and for those with either label, and
the tasks' partial counts are summed. What else is asked follows from these sums:
a document that fails a step's filter without being removed there is redundant.

A repeated text fails by ids alone: the smallest id of each text is found by an
aggregation with map-side combine, and documents meet it by (text hash, id), so a
text that a third of all rows share is no hot key of a join. The hash has 128 bits.

Defined cases: null text is empty, a null part the empty string; a null id is
never larger than another, so its row doesn't fail by repetition and has no
labels; of rows with equal id and text none is larger. A document with several
label rows has a label if any of them gives it. An empty table has no parts and
gives no rows. Other columns are ignored; ids may have any type with an order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.runtime import bound_batches, materialize

FILTERS = "ABCDE"
ORDERS = tuple("".join(p) for p in permutations(FILTERS))
STEPS = len(FILTERS)
#: Characters of which none may stand in a text (filter D). Fixed values.
SYMBOLS = re.compile(r"[#$%&*|]")
CAPITALS = re.compile(r"[A-Z]+")
#: Parts whose counts a task holds before it hands them on.
HELD = 64


def first_failures() -> np.ndarray:
    """[mask, order]: the index of the first step whose filter the mask fails, STEPS if it fails none."""
    table = np.full((1 << STEPS, len(ORDERS)), STEPS, dtype=np.int64)
    for o, order in enumerate(ORDERS):
        for step in reversed(range(STEPS)):
            table[np.arange(1 << STEPS) >> FILTERS.index(order[step]) & 1 == 1, o] = step
    return table


def text_mask(text: str) -> int:
    """Bits of the filters that a text fails by itself: A to D."""
    words = text.encode().split()
    capitals = sum(map(len, CAPITALS.findall(text)))
    return (len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1 | (100 * capitals > 10 * len(text)) << 2 | bool(SYMBOLS.search(text)) << 3


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: Column | str = "lang") -> DataFrame:
    """(doc_id, part, mask): a row for each document, with the mask of all five filters."""
    bound_batches(docs.sparkSession)
    part = F.col(part) if isinstance(part, str) else part
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            masks = pa.array([text_mask(t) for t in texts], pa.int32())
            prints = pa.array([hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts], pa.binary())
            yield pa.record_batch([b.column(0), b.column(1), masks, prints], names=["doc_id", "part", "mask", "print"])

    schema = T.StructType([*source.schema.fields[:2], T.StructField("mask", T.IntegerType()), T.StructField("print", T.BinaryType())])
    narrow = materialize(source.mapInArrow(measure, schema), "masks")
    first = narrow.groupBy("print").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    repeated = F.col("first").isNull() & F.col("doc_id").isNotNull()
    joined = narrow.join(first, ["print", "doc_id"], "left")
    return joined.select("doc_id", "part", (F.col("mask") + F.when(repeated, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))


def count_failures(masks: DataFrame) -> DataFrame:
    """(part, cell, n, good, toxic), summed over all rows of masks (part, mask, good, toxic).

    Cells: order * 6 + step for removals (step 5: kept to the end), then one
    for each mask. Zero cells aren't written.
    """
    first, n_orders, n_masks = first_failures(), len(ORDERS), 1 << STEPS
    width = n_orders * (STEPS + 1) + n_masks

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def give() -> Iterator[pa.RecordBatch]:
            for name, sums in held.items():
                cells = np.flatnonzero(sums[0])
                yield pa.record_batch([pa.array([name] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), *[pa.array(s[cells]) for s in sums]], names=["part", "cell", "n", "good", "toxic"])
            held.clear()

        for b in batches:
            codes = b.column(0).dictionary_encode()
            parts, part = codes.dictionary.to_pylist(), codes.indices.to_numpy()
            mask = b.column(1).to_numpy()
            at = part[:, None] * width + np.arange(n_orders) * (STEPS + 1) + first[mask]
            own = part * width + n_orders * (STEPS + 1) + mask
            for k, some in enumerate((slice(None), b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False))):
                sums = np.bincount(at[some].ravel(), minlength=len(parts) * width) + np.bincount(own[some], minlength=len(parts) * width)
                for name, s in zip(parts, sums.reshape(len(parts), width), strict=True):
                    held.setdefault(name, np.zeros((3, width), np.int64))[k] += s
            if len(held) > HELD:
                yield from give()
        yield from give()

    partial = masks.select("part", "mask", "good", "toxic").mapInArrow(count, "part string, cell int, n long, good long, toxic long")
    return partial.groupBy("part", "cell").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def audit_filters(masks: DataFrame) -> DataFrame:
    """A row for each part, order and step, from masks (part, mask, good, toxic).

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley; counts are of documents within the part.
    """
    sums = materialize(count_failures(masks), "audit")
    base = len(ORDERS) * (STEPS + 1)
    mask = F.col("cell") - base
    fails = [F.sum(F.when((F.col("cell") >= base) & (mask.bitwiseAND(1 << f) != 0), F.col("n"))) for f in range(STEPS)]
    alone = [F.sum(F.when(mask == 1 << f, F.col("n"))) for f in range(STEPS)]
    parts = sums.groupBy("part").agg(
        F.sum(F.when(F.col("cell") >= base, F.col("n"))).alias("total"),
        F.array(*[F.coalesce(f, F.lit(0)) for f in fails]).alias("fails"),
        F.array(*[F.coalesce(a, F.lit(0)) for a in alone]).alias("alone"),
    )
    grid = parts.select("*", F.posexplode(F.array(*map(F.lit, ORDERS))).alias("order", "filter_order"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(1), F.lit(STEPS))).alias("step"))
    grid = grid.withColumn("cell", F.col("order") * (STEPS + 1) + F.col("step") - 1).withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    each = grid.join(sums, ["part", "cell"], "left").withColumns({"removed": zero("n"), "good_lost": zero("good"), "toxic_lost": zero("toxic")})
    upto = W.partitionBy("part", "filter_order").orderBy("step")
    letter = F.instr(F.lit(FILTERS), F.col("filter"))
    return each.select(
        "part", "filter_order", "step",
        (F.col("total") - F.sum("removed").over(upto)).alias("kept"), "removed",
        (F.element_at("fails", letter) - F.col("removed")).alias("redundant"),
        F.element_at("alone", letter).alias("unique_fails"), "good_lost", "toxic_lost",
        F.sum("removed").over(W.partitionBy("part", "filter")).alias("shapley"),
    )


def labelled(masks: DataFrame, labels: DataFrame, good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """masks with the flags good and toxic: whether a label row of the document has 1 there."""
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    flags = labels.groupBy("doc_id").agg(one(good).alias("good"), one(toxic).alias("toxic"))
    return masks.join(flags, "doc_id", "left").select("part", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
