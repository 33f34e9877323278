"""Knowledge-graph operators over triple tables (subject, relation, object, confidence)."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as X
from millrace.runtime import fresh, materialize

_FOUR = Decimal("0.0001")


def fold_confidence(observed: DataFrame, keys: list[str], order: list[str], value: str = "confidence", least: float = 0.5) -> DataFrame:
    """Upsert fold: c <- round(min(1, c + (1 - c) x / 2), 4) over a triple's observations in order; x under `least` is refused.

    A task streams through its triples' sorted observations and holds one value, so
    a triple of very many observations is no large row. Null keys are keys; a null x
    is refused; observations that are equal in `order` count in any order.
    """
    n = len(keys)
    rows = observed.where(F.col(value) >= least).select(*keys, *order, F.col(value).cast("double").alias(fresh("x", observed)))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, c, seen = None, 0.0, 0

        def made(some: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([k[i] for k, _, _ in some], kinds[i]) for i in range(n)]
            return pa.record_batch([*columns, pa.array([v for _, v, _ in some], pa.float64()), pa.array([m for _, _, m in some], pa.int32())], names=[*keys, "confidence", "mentions"])

        for b in batches:
            kinds, out = [f.type for f in b.schema][:n], []
            for *key, x in zip(*[b.column(i).to_pylist() for i in range(n)], b.columns[-1].to_pylist(), strict=True):
                if key != now:
                    if seen:
                        out.append((now, c, seen))
                    now, c, seen = key, x, 1
                else:
                    c, seen = float(Decimal(repr(min(1.0, c + (1 - c) * x * 0.5))).quantize(_FOUR, ROUND_HALF_UP)), seen + 1
            yield made(out)
        if seen:
            yield made([(now, c, seen)])

    kind = T.StructType([*[observed.schema[k] for k in keys], T.StructField("confidence", T.DoubleType()), T.StructField("mentions", T.IntegerType())])
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(fold, kind)


def contradictions(triples: DataFrame) -> DataFrame:
    """(subject, relation) with several objects: the objects, sorted, and the most confident one."""
    found = triples.groupBy("subject", "relation").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("object")).alias("objects"), F.min(F.struct(-F.col("confidence"), "object")).alias("best"))
    return found.where(F.size("objects") > 1).select("subject", "relation", "n", "objects", F.col("best.object").alias("preferred"))


def analytics(triples: DataFrame) -> DataFrame:
    ends = triples.select(F.col("subject").alias("e")).union(triples.select("object")).distinct().agg(F.count("*").alias("entities"))
    return triples.agg(F.count("*").alias("triples"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.count_distinct("relation").alias("relations")).join(F.broadcast(ends)).withColumn("density", F.round(F.col("triples") / (F.col("entities") * F.col("entities")), 9))


def neighbourhood(triples: DataFrame, start: DataFrame, hops: int = 2, fan: int = 20, least: float = 0.5) -> DataFrame:
    """(entity, hop): entities within `hops` of the start entities, at most `fan` edges of a node, by confidence."""
    both = triples.where(F.col("confidence") >= least).select(F.col("subject").alias("a"), F.col("object").alias("b"), "confidence").union(triples.where(F.col("confidence") >= least).select("object", "subject", "confidence"))
    edges = both.withColumn("rn", F.row_number().over(W.partitionBy("a").orderBy(F.desc("confidence"), "b"))).where(F.col("rn") <= fan).select("a", "b")
    seen = start.select("entity", F.lit(0).alias("hop"))
    front = seen
    for hop in range(1, hops + 1):
        front = front.join(edges, front["entity"] == edges["a"]).select(F.col("b").alias("entity"), F.lit(hop).alias("hop")).distinct()
        seen = seen.union(front)
    return seen.groupBy("entity").agg(F.min("hop").alias("hop"))


def merge_entities(triples: DataFrame, aliases: DataFrame) -> DataFrame:
    """Triples with aliases (alias, canonical) rewritten at both ends; of equal triples the most confident."""
    s, o = aliases.select(F.col("alias").alias("subject"), F.col("canonical").alias("_s")), aliases.select(F.col("alias").alias("object"), F.col("canonical").alias("_o"))
    named = triples.join(s, "subject", "left").join(o, "object", "left")
    return named.groupBy(F.coalesce("_s", "subject").alias("subject"), "relation", F.coalesce("_o", "object").alias("object")).agg(F.max("confidence").alias("confidence"))


def ranked_triples(triples: DataFrame, tokens: list[str], limit: int = 20) -> DataFrame:
    """.6 token overlap + .4 confidence, over .1, best first."""
    held = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "subject", "relation", "object")), F.lit("[a-z0-9]+"), 0))
    overlap = F.size(F.array_intersect(held, F.array(*map(F.lit, tokens)))) / max(1, len(tokens))
    scored = triples.where(overlap > 0).withColumn("score", F.round(0.6 * overlap + 0.4 * F.col("confidence"), 6)).where("score > 0.1")
    return scored.orderBy(F.desc("score"), "subject", "relation", "object").limit(limit)


def ancestors(nodes: DataFrame) -> DataFrame:
    """(id, depth, cyclic) of a parent table (id, parent): steps to the root, and whether the walk never ends.

    Pointer doubling: after round r a node points 2^r steps up and knows how many
    steps those are; in the next round it takes over its target's pointer and adds
    its steps. A walk of d steps ends in log2(d) + 1 rounds, and one that is still
    open when 2^r passes the number of nodes meets itself. Ended walks are written
    once; a round reads and writes open ones. depth is null for walks that don't
    end; a parent that isn't a node, or null, ends a walk. Ids are unique; rows with
    a null id take no part.
    """
    own = nodes.where("id is not null")
    known = own.select(F.col("id").alias("k"))
    up = materialize(own.join(known, own["parent"] == known["k"], "left").select("id", F.col("k").alias("at"), F.when(F.col("k").isNull(), 0).otherwise(1).cast("long").alias("depth")), "parents")
    ended = [up.where("at is null").select("id", "depth")]
    walks, steps, n = up.where("at is not null"), 1, up.count()
    while steps <= n and not walks.isEmpty():
        target = walks.select(F.col("id").alias("t"), F.col("at").alias("beyond"), F.col("depth").alias("more"))
        for part in ended:
            target = target.union(part.select("id", F.lit(None), "depth"))
        moved = walks.join(target, walks["at"] == target["t"]).select("id", F.col("beyond").alias("at"), (F.col("depth") + F.col("more")).alias("depth"))
        moved = materialize(moved, "walks")
        ended.append(moved.where("at is null").select("id", "depth"))
        walks, steps = moved.where("at is not null"), steps * 2
    out = walks.select("id", F.lit(None).cast("long").alias("depth"), F.lit(True).alias("cyclic"))
    for part in ended:
        out = out.union(part.select("id", "depth", F.lit(False)))
    return out


def entity_mentions(triples: DataFrame, limit: int = 100) -> DataFrame:
    """The entities with most triples at either end."""
    ends = triples.select(F.col("subject").alias("entity")).union(triples.select("object"))
    return ends.groupBy("entity").agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), "entity").limit(limit)


def pruned(triples: DataFrame, most: int, by: list) -> DataFrame:
    """All but the rows that come last beyond `most` in the order `by`: a top-k, so no global sort is kept."""
    return triples.orderBy(*by).limit(most)


#: What joins subject and object, and the relation's name, in order. Fixed values.
_S, _T = "([A-Z][a-zA-Z0-9\\s]{1,40})", "([A-Z][a-zA-Z0-9\\s]{1,30})"
TRIPLE_PATTERNS = (
    ("is", f"(?i){_S}\\s+is\\s+(?:a|an|the)?\\s*([a-zA-Z][^\\.\\,]{{2,60}})"),
    ("has", f"(?i){_S}\\s+has\\s+([a-zA-Z][^\\.\\,]{{2,60}})"),
    ("uses", f"(?i){_S}\\s+uses?\\s+([a-zA-Z][^\\.\\,]{{2,60}})"),
    ("created", f"(?i){_S}\\s+(?:created|made|built)\\s+([a-zA-Z][^\\.\\,]{{2,60}})"),
    ("works_at", f"(?i){_T}\\s+works?\\s+(?:at|for)\\s+{_S}"),
    ("located_in", f"(?i){_S}\\s+(?:located|based)\\s+in\\s+{_S}"),
    ("part_of", f"(?i){_S}\\s+(?:belongs\\s+to|is\\s+part\\s+of)\\s+{_S}"),
    ("contains", f"(?i){_S}\\s+contains?\\s+([a-zA-Z][^\\.\\,]{{2,50}})"),
    ("means", "(?i)([A-Z][a-zA-Z0-9]{1,30})\\s+means?\\s+([a-zA-Z][^\\.\\,]{2,60})"),
    ("causes", f"(?i){_S.replace('A-Z', 'a-zA-Z', 1)}\\s+causes?\\s+([a-zA-Z][^\\.\\,]{{2,60}})"),
    ("depends_on", f"(?i){_S}\\s+(?:depends\\s+on|requires?)\\s+([a-zA-Z][^\\.\\,]{{2,50}})"),
    ("produces", f"(?i){_S}\\s+(?:produces?|generates?)\\s+([a-zA-Z][^\\.\\,]{{2,50}})"),
    ("contradicts", f"(?i){_S}\\s+contradicts?\\s+([a-zA-Z][^\\.\\,]{{2,60}})"),
    ("precedes", f"(?i){_S}\\s+(?:precedes?|comes?\\s+before)\\s+{_S}"),
    ("similar_to", f"(?i){_S}\\s+(?:is\\s+)?similar\\s+to\\s+{_S}"),
    ("instance_of", f"(?i){_T}\\s+is\\s+an?\\s+instance\\s+of\\s+{_S}"),
    ("derived_from", f"(?i){_S}\\s+(?:is\\s+)?derived\\s+from\\s+{_S}"),
    ("enables", f"(?i){_S}\\s+enables?\\s+([a-zA-Z][^\\.\\,]{{2,50}})"),
    ("inhibits", f"(?i){_S}\\s+(?:inhibits?|prevents?)\\s+([a-zA-Z][^\\.\\,]{{2,50}})"),
    ("named", f"(?i){_T}\\s+(?:is\\s+)?named\\s+{_T}"),
)


#: What must stand in a text for the pattern of a relation to match.
_VERBS = {
    "is": "is", "has": "has", "uses": "uses?", "created": "(?:created|made|built)", "works_at": "works?", "located_in": "(?:located|based)", "part_of": "(?:belongs|part)", "contains": "contains?", "means": "means?", "causes": "causes?",
    "depends_on": "(?:depends|requires?)", "produces": "(?:produces?|generates?)", "contradicts": "contradicts?", "precedes": "(?:precedes?|comes?)", "similar_to": "similar", "instance_of": "instance", "derived_from": "derived", "enables": "enables?",
    "inhibits": "(?:inhibits?|prevents?)", "named": "named",
}


def extract_triples(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows' other columns with subject, relation, object: a row for each match of a pattern, each triple of a row once.

    A pattern runs, once, over texts that hold its verb between white space; its two
    groups are read from its matches, which match alike by themselves.
    """
    cut = lambda c: F.substring(F.regexp_replace(c, "^\\s+|\\s+$", ""), 1, 60)
    kind = "array<struct<subject:string,relation:string,object:string>>"

    def of(relation: str, pattern: str):
        group = lambda m, n: cut(F.regexp_extract(m, pattern, n))
        found = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: F.struct(group(m, 1).alias("subject"), F.lit(relation).alias("relation"), group(m, 2).alias("object")))
        return F.when(F.col(text).rlike(f"(?i)\\s{_VERBS[relation]}\\s"), found).otherwise(F.array().cast(kind))

    found = F.flatten(F.array(*[of(r, p) for r, p in TRIPLE_PATTERNS]))
    long = F.filter(found, lambda t: (F.length(t["subject"]) > 2) & (F.length(t["object"]) > 2))
    same = lambda t, u: (F.lower(t["subject"]) == F.lower(u["subject"])) & (t["relation"] == u["relation"]) & (F.lower(t["object"]) == F.lower(u["object"]))
    keep = [c for c in rows.columns if c != text]
    listed = rows.select(*keep, long.alias("_t"))
    first = lambda listed: F.filter(listed, lambda t, i: ~F.exists(F.slice(listed, 1, i), lambda u: same(t, u)))
    # An inner explode would put a filter over its array below, where all is found again.
    return listed.select(*keep, F.explode_outer(X.let(F.col("_t"), first)).alias("_t")).where("_t is not null").select(*keep, "_t.*")


