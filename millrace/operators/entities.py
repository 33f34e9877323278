"""Entities in texts and under several names: linking mentions to facts, and aliases of aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators.components import connected_components
from millrace.runtime import materialize


def mentions(texts: DataFrame, names: DataFrame, longest: int = 4) -> DataFrame:
    """(id, at, n, name): names (name) that stand in texts (id, text), leftmost first, the longest of those that begin there, none within another.

    Names and texts meet as lower-cased alphanumeric tokens: each run of up to
    `longest` tokens of a text is joined to the names, so the names may be any
    number and none is broadcast but by Spark's own size check. Names of more tokens
    aren't found. Null texts have no mentions; ids are unique.
    """
    tokens = texts.select("id", X.alnum_tokens(F.coalesce("text", F.lit(""))).alias("t"))
    run = lambda n: F.transform(F.sequence(F.lit(0), F.size("t") - n), lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice("t", i + 1, n), " ").alias("k")))
    runs = F.concat(*[F.when(F.size("t") >= n, run(n)).otherwise(F.array().cast("array<struct<at:int,n:int,k:string>>")) for n in range(1, longest + 1)])
    known = names.select("name", F.array_join(X.alnum_tokens(F.col("name")), " ").alias("k")).where("k <> ''").groupBy("k").agg(F.min("name").alias("name"))
    met = tokens.select("id", F.inline(runs)).join(known, "k").select("id", "at", "n", "name")
    # A text's mentions are one row: it held the text.
    listed = met.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("m"), "name"))).alias("l"))
    none = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,m:int,name:string>>").alias("kept"))
    step = lambda a, x: F.when(x["at"] >= a["end"], F.struct((x["at"] - x["m"]).alias("end"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a)
    kept = listed.select("id", F.inline(F.aggregate("l", none, step)["kept"]))
    return kept.select("id", "at", (-F.col("m")).alias("n"), "name")


def enrich(texts: DataFrame, triples: DataFrame, entities: int = 5, facts: int = 3, most: int = 5) -> DataFrame:
    """(id, context): what the graph says about the entities that a text names.

    Of each of a text's first `entities` different entities the `facts` most
    confident triples they take part in, `most` in all, as "subject relation object".
    A text without known entities has an empty context. A frequent entity's triples
    are cut to the best before they are shuffled.
    """
    ends = triples.select(F.col("subject").alias("name"), "subject", "relation", "object", "confidence").union(triples.where("subject <> object").select("object", "subject", "relation", "object", "confidence"))
    by = W.partitionBy("name").orderBy(F.desc("confidence"), "subject", "relation", "object")
    best = materialize(ends.where("name is not null").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= facts).select("name", "rank", F.concat_ws(" ", "subject", "relation", "object").alias("fact")), "facts")
    found = mentions(texts, best.select("name").distinct()).groupBy("id", "name").agg(F.min("at").alias("at"))
    first = found.withColumn("nth", F.row_number().over(W.partitionBy("id").orderBy("at"))).where(F.col("nth") <= entities)
    said = first.join(best, "name").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("nth", "rank", "fact"))).alias("l"))
    context = F.transform(F.slice("l", 1, most), lambda x: x["fact"])
    return texts.select("id").join(said, "id", "left").select("id", F.coalesce(context, F.array().cast("array<string>")).alias("context"))


def canonical_names(aliases: DataFrame) -> DataFrame:
    """(name, canonical) of all names in aliases (alias, canonical), aliases of aliases included.

    Names that any chain of aliases connects are one entity, so an alias with two
    canonical names makes those one. Its name is the smallest that isn't an alias
    itself, or, where all are (a circle), the smallest. Null names and a name that is
    its own alias say nothing.
    """
    pairs = aliases.where("alias is not null and canonical is not null and alias <> canonical").select("alias", "canonical")
    of = materialize(connected_components(pairs, "alias", "canonical"), "names")
    marked = of.join(pairs.select(F.col("alias").alias("node"), F.lit(True).alias("is_alias")).distinct(), "node", "left")
    head = marked.groupBy("component").agg(F.min(F.struct(F.coalesce("is_alias", F.lit(False)).alias("a"), F.col("node").alias("canonical"))).alias("h"))
    return of.join(head, "component").select(F.col("node").alias("name"), F.col("h.canonical").alias("canonical"))


def merge_aliases(triples: DataFrame, aliases: DataFrame) -> DataFrame:
    """Triples with every name as its canonical one; of triples that become equal the most confident."""
    names = materialize(canonical_names(aliases), "canonical")
    s = names.select(F.col("name").alias("subject"), F.col("canonical").alias("_s"))
    o = names.select(F.col("name").alias("object"), F.col("canonical").alias("_o"))
    named = triples.select("subject", "relation", "object", "confidence").join(s, "subject", "left").join(o, "object", "left")
    return named.groupBy(F.coalesce("_s", "subject").alias("subject"), "relation", F.coalesce("_o", "object").alias("object")).agg(F.max("confidence").alias("confidence"))


def alias_lists(aliases: DataFrame) -> DataFrame:
    """(canonical, aliases): each entity's other names, by alphabet; names of one entity are few."""
    return canonical_names(aliases).where("name <> canonical").groupBy("canonical").agg(F.array_sort(F.collect_list("name")).alias("aliases"))
