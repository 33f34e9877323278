"""Star clusters of entities that share facts, in the order in which entities were first named.

The rule is sequential: in that order, an entity that is in no cluster yet gathers
all entities in none that share a (relation, other end) with it; enough of them
are a cluster. Here the same clusters come out of rounds. An entity's turn depends
only on earlier entities within two steps: one step away they could take it, two
steps away they could take its neighbours. So in a round all undecided entities
with no earlier undecided one within two steps have their turn at once; their
neighbourhoods don't overlap. Two steps are four aggregations over the table of
(entity, fact), whose rows are never paired with each other: minima go from
entities to facts and back.

Facts of very many entities are hubs. A hub's rows are dealt over as many salts as
its size asks for and its minima are sent to each, so no join has it as one key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.runtime import materialize

FACT = ["relation", "other"]
#: Rows of a fact under one salt.
HUB = 50_000


def _kept(rows: DataFrame, tag: str) -> DataFrame:
    """What is written has few bytes for its rows, so it is joined by sort and merge: as a broadcast it would go through the driver."""
    return materialize(rows, tag).hint("merge")


def _facts(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(x, name) of entities, x the place of the first mention, and (x, relation, other), each once."""
    ends = triples.select((F.col("ord") * 2).alias("at"), F.col("subject").alias("name"), "relation", F.col("object").alias("far")).union(triples.select(F.col("ord") * 2 + 1, "object", "relation", "subject"))
    ends = ends.where("name is not null and far is not null and relation is not null")
    names = _kept(ends.groupBy("name").agg(F.min("at").alias("x")), "names")
    facts = ends.join(names, "name").select("x", "relation", "far").join(names.select(F.col("name").alias("far"), F.col("x").alias("other")), "far")
    return names.select("x", "name"), facts.select("x", *FACT).distinct()


def _shared(facts: DataFrame) -> DataFrame:
    """Facts that can still join entities: of two or more, one of them undecided; `s` is the row's salt of `salts`."""
    rows = facts.groupBy(*FACT).agg(F.count("*").alias("n"), F.max("open").alias("any"))
    kept = rows.where("n > 1 and any").select(*FACT, F.ceil(F.col("n") / HUB).cast("int").alias("salts"))
    mine = facts.select("x", *FACT, "open").join(_salted(kept), FACT)
    return mine.where(F.pmod(F.xxhash64("x"), "salts") == F.col("s"))


def _salted(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("s"))


def _to_facts(rows: DataFrame, value: str) -> DataFrame:
    """The least value of each fact's rows, under each of its salts."""
    return _salted(rows.groupBy(*FACT, "salts").agg(F.min(value).alias("least"))).drop("salts")


def star_clusters(triples: DataFrame, min_size: int = 3, least: float = 0.5, max_rounds: int = 1000) -> DataFrame:
    """(center, entity, size): the clusters' members, of triples (ord, subject, relation, object, confidence).

    ord numbers triples in the order of insertion, each number once. Triples under
    `least`, or with a null end, relation or confidence, don't count. Clusters have
    at least min_size (2 or more) members, the centre among them; other entities have
    no row. An empty table gives an empty result. Raises if max_rounds is reached.
    """
    if min_size < 2:
        raise ValueError("a cluster has two members or more")
    names, facts = _facts(triples.where(F.col("confidence") >= least))
    rows = _kept(_shared(facts.withColumn("open", F.lit(True))), "facts")
    made: list[DataFrame] = []
    for _ in range(max_rounds):
        if rows.isEmpty():
            break
        salt = [*FACT, "s"]
        near = rows.join(_to_facts(rows.where("open"), "x"), salt).groupBy("x").agg(F.min("least").alias("near"))
        far = rows.join(_to_facts(rows.join(near, "x"), "near"), salt).groupBy("x").agg(F.min("least").alias("far"), F.first("open").alias("open"))
        turns = _kept(far.where("open and far = x").select("x"), "turns")
        held = _to_facts(rows.join(turns, "x"), "x").withColumnRenamed("least", "center")
        members = _kept(rows.join(held, salt).select("center", "x").distinct(), "members")  # the centre is one of its facts' entities
        sizes = members.groupBy("center").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
        cluster = _kept(members.join(sizes, "center"), "cluster")
        made.append(cluster)
        rest = rows.join(cluster.select("x"), "x", "left_anti").join(turns.withColumn("had", F.lit(True)), "x", "left")
        rows = _kept(_shared(rest.select("x", *FACT, (F.col("open") & F.col("had").isNull()).alias("open"))), "facts")
    else:
        raise RuntimeError(f"clusters did not settle in {max_rounds} rounds")
    out = triples.sparkSession.createDataFrame([], "center long, x long, size long")
    for part in made:
        out = out.union(part.select("center", "x", "size"))
    centre = names.select(F.col("x").alias("center"), F.col("name").alias("center_name"))
    return out.join(names, "x").join(centre, "center").select(F.col("center_name").alias("center"), F.col("name").alias("entity"), "size")


def cluster_relations(triples: DataFrame, clusters: DataFrame, most: int = 10, least: float = 0.5) -> DataFrame:
    """(center, relations): the first `most` relations, by name, of the facts of a cluster's members."""
    used = triples.where(F.col("confidence") >= least)
    ends = used.select(F.col("subject").alias("entity"), "relation").union(used.select("object", "relation"))
    each = clusters.select("center", "entity").join(ends.distinct(), "entity").select("center", "relation").distinct()
    return each.groupBy("center").agg(F.slice(F.array_sort(F.collect_list("relation")), 1, most).alias("relations"))
