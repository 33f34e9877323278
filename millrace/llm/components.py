"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is two aggregations with map-side combine and one equi-join, so a
node with very many neighbours is never gathered into one row. Its edges meet in
the join by the node; Spark splits that partition when it passes its skew threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.runtime import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v. Large: link larger neighbours to the smallest one; small: the others."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node reachable.

    edges: two BIGINT columns. Null ends and loops link nothing; an empty
    table gives an empty result. Raises if max_rounds is reached, rather than
    returning unfinished components.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("ok"))
    e = materialize(e.where("ok and u > v").select("u", "v").distinct(), "cc")
    mark = None
    for _ in range(max_rounds):
        s = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if s["n"] == 0 or (s["n"], s["h"]) == mark:
            break
        mark = (s["n"], s["h"])
        e = materialize(_star(_star(e, True), False), "cc")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
