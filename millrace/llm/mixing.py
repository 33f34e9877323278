"""Mixing sources to target weights, natively: hierarchical budgets and seeded epochs.

A token budget goes down a domain-language-source tree. At each node it is
dealt to the children by weight; a child cannot take more than its subtree
holds over `max_epochs` epochs, and what it cannot take goes to its siblings by
weight. As a node never gets more than its subtree holds, a shortage moves to
an ancestor's siblings only when the whole subtree is short. This water level
is found exactly with integer arithmetic and window sums: no iteration.

A leaf with budget b and n tokens takes b div n whole epochs and, of the next
one, the prefix that fits, in the order of that epoch's seeded hash. The prefix
ends at a cutoff hash for each leaf: hashes are first summed in 4096 buckets
for each leaf, and only the bucket at the cutoff is sorted, so no task holds a
leaf. The cutoffs, one row a leaf, then select the rows in one narrow scan.

Only DataFrame and SQL functions run here.

Defined cases: null text has no tokens; null domain, language or source is
the value "none" of its level; rows that repeat a doc_id stand or fall
together; an empty table or a budget of 0 gives an empty result; a leaf
without tokens gives no rows in a partial epoch, and its rows count as one whole
epoch; columns `epoch` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.runtime import fresh, materialize

SEED, MAX_EPOCHS, BUCKETS = 42, 4, 4096
LEVELS = ("domain", "lang", "source")


def token_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ of the text; null has none."""
    trimmed = F.trim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))).otherwise(0).cast("long")


def domain_of(source: Column, domains: int = 4) -> Column:
    """The default tree's domain of a source: its number modulo `domains`."""
    return F.concat(F.lit("d"), F.coalesce(F.pmod(F.regexp_extract(source, "([0-9]+)$", 1).try_cast("long"), F.lit(domains)), F.lit(0)).cast("string"))


def _deal(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """nodes (parent..., child, cap, weight, budget of the parent) -> budget of the child. Integers throughout."""
    order = W.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), F.col(child))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy(*parent)
    full = F.col("cap").cast("decimal(38,0)") * F.col("heavier") <= F.col("weight").cast("decimal(38,0)") * (F.col("budget") - F.col("lighter"))
    level = (
        nodes.withColumn("lighter", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("heavier", F.sum("weight").over(after))
        .withColumn("full", full)
        .withColumn("left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0)))
        .withColumn("share", F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole), F.lit(1)))
    )
    dealt = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("cast(cast(weight as decimal(38,0)) * left div share as bigint)"))
    return level.withColumn("dealt", dealt).select(*parent, child, F.col("dealt").alias("budget"))


def _nodes(leaves: DataFrame, depth: int, weights: dict[str, Column]) -> DataFrame:
    """The tree's nodes at a depth: (root, path..., cap, tokens, weight)."""
    path = LEVELS[: depth + 1]
    nodes = leaves.groupBy(*path).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    return nodes.withColumn("weight", F.greatest(weights.get(path[-1], F.lit(1)).cast("long"), F.lit(1))).withColumn("root", F.lit(1))


def leaf_budgets(leaves: DataFrame, budget: Column, weights: dict[str, Column], max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(domain, lang, source, tokens, budget) of leaves (domain, lang, source, tokens).

    weights: for each level the weight of a node among its siblings, an
    integer expression over its path and `tokens`, the tokens below it
    (missing or under 1: 1). budget: an expression over `total`, all tokens,
    and `cover`, the least budget whose shares cut no leaf's first epoch short.
    """
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    share, keys = None, ["root"]
    for depth, child in enumerate(LEVELS):
        part = _nodes(leaves, depth, weights)
        own = part.withColumn("share", F.col("weight") / F.sum("weight").over(W.partitionBy(*keys)))
        path = list(LEVELS[: depth + 1])
        own = own.select("root", *path, F.col("share"), "tokens")
        share = own if share is None else own.join(share.select(*keys, F.col("share").alias("above")), keys).select("root", *path, (F.col("share") * F.col("above")).alias("share"), "tokens")
        keys = path
    cover = share.agg(F.coalesce(F.ceil(F.max(F.col("tokens") / F.col("share")) * 1.0001) + 1000, F.lit(0)).alias("cover"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"), F.lit(1).alias("root"))
    at = cover.select(F.least(budget.cast("long"), F.col("total") * max_epochs).alias("budget"), "root")
    keys = ["root"]
    for depth, child in enumerate(LEVELS):
        at = _deal(_nodes(leaves, depth, weights).join(at, keys), keys, child)
        keys = list(LEVELS[: depth + 1])
    return leaves.select(*LEVELS, "tokens").join(at, list(LEVELS))


def order_hash(seed: int, epoch: Column, doc_id: Column) -> Column:
    """The row's place in a seeded epoch: md5 over seed, epoch and id, in hexadecimal."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("none"))))


def plan_mix(narrow: DataFrame, weights: dict[str, Column], budget: Column, seed: int = SEED, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(domain, lang, source, tokens, budget, whole, cutoff): how much of each leaf goes in.

    narrow: (doc_id, domain, lang, source, tokens), stored; weights and
    budget as in leaf_budgets. `whole` epochs go in wholly, and of the next one the rows whose order_hash
    is at most `cutoff` (null: none).
    """
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    dealt = leaf_budgets(materialize(leaves, "mix-leaves"), budget, weights, max_epochs)
    plan = materialize(
        dealt.withColumn("whole", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(1).cast("long")).withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0)),
        "mix-plan",
    )
    h = order_hash(seed, F.col("whole") + 1, F.col("doc_id"))
    rows = narrow.join(plan.where("rest > 0").select(*LEVELS, "whole", "rest"), list(LEVELS)).withColumn("h", h).withColumn("bucket", F.substring("h", 1, 3))
    sums = rows.groupBy(*LEVELS, "bucket").agg(F.sum("tokens").alias("n"), F.max("rest").alias("rest"))
    past = sums.withColumn("upto", F.sum("n").over(W.partitionBy(*LEVELS).orderBy("bucket")))
    edge = past.where("upto - n <= rest").groupBy(*LEVELS).agg(F.max_by(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before")), "bucket").alias("at")).select(*LEVELS, F.col("at.bucket").alias("bucket"), F.col("at.before").alias("before"))
    inside = W.partitionBy(*LEVELS).orderBy("h").rangeBetween(W.unboundedPreceding, W.currentRow)
    last = rows.join(edge, [*LEVELS, "bucket"]).withColumn("upto", F.col("before") + F.sum("tokens").over(inside)).where("upto <= rest")
    cut = last.groupBy(*LEVELS).agg(F.max("h").alias("inner"))
    ends = edge.join(cut, list(LEVELS), "left").select(*LEVELS, F.coalesce("inner", "bucket").alias("cutoff"))  # a bucket's prefix is below all its hashes
    return materialize(plan.drop("rest").join(ends, list(LEVELS), "left"), "mix-cutoffs")


def mix(docs: DataFrame, weights: dict[str, Column], budget: Column, domain: Column | None = None, seed: int = SEED, max_epochs: int = MAX_EPOCHS, tokens: Column | None = None) -> DataFrame:
    """docs' rows, each as often as it is selected, with `epoch` (from 1)."""
    level = {"domain": domain_of(F.col("source")) if domain is None else domain, "lang": F.col("lang"), "source": F.col("source")}
    level = {k: F.coalesce(v.cast("string"), F.lit("none")) for k, v in level.items()}
    count = token_count(F.col("text")) if tokens is None else tokens
    narrow = materialize(docs.select("doc_id", *[v.alias(k) for k, v in level.items()], count.cast("long").alias("tokens")), "mix-rows")
    plan = plan_mix(narrow, weights, budget, seed, max_epochs)
    own = [c for c in docs.columns if c.lower() != "epoch"]
    at = {k: fresh(k, docs) for k in (*LEVELS, "whole", "cutoff")}
    leaf = plan.select(*[F.col(k).alias(v) for k, v in at.items()])
    wide = docs.join(leaf, [level[k] == F.col(at[k]) for k in LEVELS])
    times = F.col(at["whole"]) + F.when(order_hash(seed, F.col(at["whole"]) + 1, F.col("doc_id")) <= F.col(at["cutoff"]), 1).otherwise(0)
    return wide.select(*own, F.explode(F.sequence(F.lit(1), F.when(times > 0, times).cast("int"))).alias("epoch"))
