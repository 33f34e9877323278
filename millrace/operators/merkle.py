"""Hash trees over a table's texts: a lock of a release that any single document can be checked against.

A node of level l covers the ids that are equal when divided by FAN ** l, so a
tree's shape depends on ids alone and trees of two releases match node by node. A
node's hash is that of its children's numbers and hashes in order, at most FAN of
them; no row holds more, however large a part is. Levels are written, each a
FANth of the one before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.runtime import materialize

FAN, LEVELS = 256, 4


def _over(children: DataFrame, fan: int) -> DataFrame:
    """The nodes above (part, node, hash, n)."""
    up = children.groupBy("part", F.floor(F.col("node") / fan).cast("long").alias("up"))
    kids = F.array_sort(F.collect_list(F.struct("node", "hash")))
    text = F.array_join(F.transform(kids, lambda k: F.concat_ws(":", k["node"].cast("string"), k["hash"])), ",")
    return up.agg(F.sha2(text, 256).alias("hash"), F.sum("n").alias("n")).withColumnRenamed("up", "node")


def leaves(docs: DataFrame) -> DataFrame:
    """(part, node, hash, n) of docs (part, doc_id, text): one for each id; rows that share an id, sorted by hash, are one leaf.

    A null text hashes as an empty one, a null part is the empty string; null ids take no part.
    """
    each = docs.where("doc_id is not null").select(F.coalesce("part", F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("node"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return each.groupBy("part", "node").agg(F.array_join(F.array_sort(F.collect_list("h")), "").alias("hash"), F.count("*").alias("n"))


def tree(docs: DataFrame, levels: int = LEVELS, fan: int = FAN) -> DataFrame:
    """(part, level, node, hash, n) of all nodes; level 0 are documents. Ids of fan ** levels or more leave several nodes at the top."""
    nodes = [materialize(leaves(docs), "leaves")]
    for _ in range(levels):
        nodes.append(materialize(_over(nodes[-1], fan), "nodes"))
    return reduce(DataFrame.union, [n.select("part", F.lit(i).alias("level"), "node", "hash", "n") for i, n in enumerate(nodes)])


def roots(nodes: DataFrame) -> DataFrame:
    """(part, hash, n): the hash over a part's top nodes, one for ids below fan ** levels."""
    top = nodes.join(F.broadcast(nodes.agg(F.max("level").alias("level"))), "level")
    kids = F.array_sort(F.collect_list(F.struct("node", "hash")))
    return top.groupBy("part").agg(F.sha2(F.array_join(F.transform(kids, lambda k: k["hash"]), ""), 256).alias("hash"), F.sum("n").alias("n"))


def proofs(nodes: DataFrame, asked: DataFrame, levels: int = LEVELS, fan: int = FAN) -> DataFrame:
    """(part, doc_id, level, node, hash): for each of asked (part, doc_id) the children of every node above it, and the top nodes.

    With them its root can be computed from the text alone: fan rows a level at most,
    and one top node for ids below fan ** levels.
    """
    tops = nodes.where(F.col("level") == levels)
    parts = [asked.select("part", "doc_id").join(tops, "part").select("part", "doc_id", "level", "node", "hash")]
    for level in range(levels):
        kids = nodes.where(F.col("level") == level).withColumn("up", F.floor(F.col("node") / fan).cast("long"))
        want = asked.select("part", "doc_id", F.floor(F.col("doc_id") / fan ** (level + 1)).cast("long").alias("up"))
        parts.append(want.join(kids, ["part", "up"]).select("part", "doc_id", "level", "node", "hash"))
    return reduce(DataFrame.union, parts)


def verify(proof: DataFrame, docs: DataFrame, tops: DataFrame, levels: int = LEVELS, fan: int = FAN) -> DataFrame:
    """(part, doc_id, ok): whether docs (part, doc_id, text) are what the roots `tops` (part, hash) were made of.

    Bottom up: the document's own hash takes its place among the proof's leaves, the
    hash over them its place a level higher, and the last one must be the root.
    """
    now = leaves(docs).select("part", F.col("node").alias("doc_id"), F.col("node").alias("own"), F.col("hash").alias("h"))
    for level in range(levels + 1):
        kids = proof.where(F.col("level") == level).select("part", "doc_id", "node", "hash")
        held = now.join(kids, ["part", "doc_id"], "left").withColumn("hash", F.when(F.col("node") == F.col("own"), F.col("h")).otherwise(F.col("hash")))
        listed = F.array_sort(F.collect_list(F.when(F.col("node").isNotNull(), F.struct("node", "hash"))))
        below = F.array_join(F.transform(listed, lambda k: F.concat_ws(":", k["node"].cast("string"), k["hash"])), ",")
        text = below if level < levels else F.array_join(F.transform(listed, lambda k: k["hash"]), "")
        # Without the document among them the nodes prove nothing about it.
        found = F.max(F.coalesce(F.col("node") == F.col("own"), F.lit(False)))
        now = held.groupBy("part", "doc_id", F.floor(F.col("own") / fan).cast("long").alias("up")).agg(F.when(found, F.sha2(text, 256)).alias("h")).withColumnRenamed("up", "own")
    top = tops.select("part", F.col("hash").alias("root"))
    return now.join(top, "part", "left").select("part", "doc_id", F.coalesce(F.col("h") == F.col("root"), F.lit(False)).alias("ok"))


def differences(a: DataFrame, b: DataFrame, levels: int = LEVELS, fan: int = FAN) -> DataFrame:
    """(part, doc_id, change) between two trees: added, removed or changed documents.

    From the top only the children of unequal nodes are looked at, so two large
    releases that differ in little cost little.
    """
    open_: DataFrame | None = None
    for level in range(levels, -1, -1):
        one, two = (t.where(F.col("level") == level).select("part", "node", "hash", F.floor(F.col("node") / fan).cast("long").alias("up")) for t in (a, b))
        if open_ is not None:
            one, two = (t.join(open_, ["part", "up"], "left_semi") for t in (one, two))
        both = one.select("part", "node", F.col("hash").alias("h1")).join(two.select("part", "node", F.col("hash").alias("h2")), ["part", "node"], "full")
        unequal = materialize(both.where(~F.col("h1").eqNullSafe(F.col("h2"))), "unequal")
        open_ = unequal.select("part", F.col("node").alias("up"))
    change = F.when(F.col("h1").isNull(), "added").when(F.col("h2").isNull(), "removed").otherwise("changed")
    return unequal.select("part", F.col("node").alias("doc_id"), change.alias("change"))
