"""Retrieval: fusion, ranking metrics, chunking, query rewriting. BM25 is in `inverted`, vectors in `vector_index`."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def top(rows: DataFrame, keys: list[str], by: list[Column], k: int, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*by))).where(F.col(name) <= k)


def fuse(dense: DataFrame, sparse: DataFrame, keys: list[str], k: int = 5, least: float = 0.25, pool: int = 24) -> DataFrame:
    """.7 dense + .3 sparse / (largest sparse of the query), best `pool`, then top-k of `least` or more; the first always stays."""
    both = dense.withColumnRenamed("score", "d").join(sparse.withColumnRenamed("score", "s"), keys, "full")
    most = F.greatest(F.max("s").over(W.partitionBy(keys[0])), F.lit(1e-9))
    scored = both.withColumn("score", F.round(0.7 * F.coalesce("d", F.lit(0.0)) + 0.3 * F.coalesce("s", F.lit(0.0)) / most, 6))
    return top(scored, [keys[0]], [F.desc("score"), F.col(keys[1])], min(k, pool)).where((F.col("score") >= least) | (F.col("rank") == 1)).drop("d", "s")


def ranking_metrics(ranked: DataFrame, n_relevant: DataFrame, k: int = 10) -> DataFrame:
    """One row: MRR, mean rank (a miss is k + 1), NDCG, hit rate. ranked (query_id, rank, relevant), n_relevant (query_id, n)."""
    hits = ranked.where(F.col("rank") <= k).groupBy("query_id").agg(
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("relevant"), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    each = n_relevant.where("n > 0").join(hits, "query_id", "left").select(
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"),
        F.coalesce("first", F.lit(k + 1)).alias("pos"),
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
        F.col("first").isNotNull().cast("double").alias("hit"),
    )
    return each.agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(n) for c, n in (("rr", "mrr"), ("pos", "mean_rank"), ("ndcg", "ndcg"), ("hit", "hit_rate"))])


def chunk_texts(most: int = 512, least_words: int = 4, carry: bool = True):
    """A UDF: greedy packing of sentences into chunks, each starting with the last word of the one before."""
    import re

    cut = re.compile(r"(?<=[.!?])\s+")

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def chunks(text: pa.Array) -> pa.Array:
        out = []
        for t in text.to_pylist():
            made, held = [], ""
            for s in cut.split((t or "").strip()):
                if held and len(held) + 1 + len(s) > most:
                    made.append(held)
                    held = f"{held.split()[-1]} {s}" if carry else s
                else:
                    held = f"{held} {s}".strip()
            if held:
                made.append(held)
            out.append([c for c in made if len(c.split()) >= least_words])
        return pa.array(out, pa.list_(pa.string()))

    return chunks


def rewrite_query(query: Column, history: Column) -> Column:
    """If the query holds a pronoun, the first it/this/that becomes the last capitalised word of the history."""
    nouns = F.regexp_extract_all(history, F.lit("(?:^|[^A-Za-z])([A-Z][a-z]{2,})"), 1)
    noun = F.when(F.size(nouns) > 0, F.element_at(nouns, -1))
    found = F.regexp_extract(query, "(?i)^(.*?)(?<![A-Za-z])(?:it|this|that)(?![A-Za-z])", 0)
    word = F.regexp_extract(found, "(?i)(it|this|that)$", 1)
    return F.when((F.length(found) > 0) & noun.isNotNull(), F.concat(F.substring(found, F.lit(1), F.length(found) - F.length(word)), noun, F.substring(query, F.length(found) + 1, F.length(query)))).otherwise(query)
