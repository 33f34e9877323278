"""Retrieval in several rounds: a frontier of open questions, each with a stop of its own.

A leg is a function from queries (query_id, text) to rows (query_id, id, score,
rank, text). A round asks the legs for all open questions at once, in Spark, keeps
of rows that begin alike the first, writes what is new, and closes the questions
that have enough. Only the number of open questions reaches the driver; rows grow
with questions times rounds times what a leg returns for one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as X
from millrace.operators import retrieval, vector_index
from millrace.operators.inverted import TextIndex
from millrace.runtime import bound_batches, materialize

Leg = Callable[[DataFrame], DataFrame]
_FOUND = "query_id long, hop int, leg int, id long, score double, rank int, text string"


def keep_first(rows: DataFrame, seen: DataFrame | None = None, prefix: int = 80) -> DataFrame:
    """Of a query's rows (query_id, leg, rank, id, score, text) whose texts begin alike, the first by leg and rank; none that `seen` has."""
    first = rows.groupBy("query_id", F.left("text", F.lit(prefix)).alias("_start")).agg(F.min(F.struct("leg", "rank", "id", "score", "text")).alias("_r"))
    if seen is not None:
        first = first.join(seen.select("query_id", F.left("text", F.lit(prefix)).alias("_start")).distinct(), ["query_id", "_start"], "left_anti")
    return first.select("query_id", "_r.*")


def _ask(legs: list[Leg], queries: DataFrame) -> DataFrame:
    """The rows of all legs, each with the leg's number."""
    parts = [leg(queries).select("query_id", F.lit(n).alias("leg"), "rank", "id", "score", F.coalesce("text", F.lit("")).alias("text")) for n, leg in enumerate(legs)]
    return reduce(DataFrame.union, parts)


def evidence_loop(questions: DataFrame, legs: list[Leg], loops: int = 10, enough: int = 3, shown: int = 300, gaps: int = 5, refine: int = 3) -> tuple[DataFrame, DataFrame]:
    """Collect evidence until there is enough, no gap is left or the rounds are spent.

    questions (query_id, text). A round's gap are the question's words of four
    letters or more that none of the round's rows (their first `shown` characters)
    holds, by alphabet; the first `refine` of the first `gaps` join the question in
    the next round. Returns evidence (query_id, hop, leg, rank, id, score, text),
    each beginning once for a question, and rounds (query_id, hop, found, coverage,
    gap), one row for each round of a question. A question without words gets one
    round without rows. Null texts are empty.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), 0))
    open_ = materialize(questions.select("query_id", F.coalesce("text", F.lit("")).alias("question"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0).cast("long").alias("coverage")), "open")
    evidence: DataFrame | None = None
    rounds: list[DataFrame] = []
    for hop in range(loops):
        found = materialize(_ask(legs, open_.select("query_id", "text")).withColumn("text", F.left("text", F.lit(shown))), "legs")
        new = materialize(keep_first(found, evidence).withColumn("hop", F.lit(hop)), "evidence")
        evidence = new if evidence is None else evidence.unionByName(new)
        asked = open_.select("query_id", F.explode(words(F.col("question"))).alias("w"))
        held = found.select("query_id", F.explode(words(F.col("text"))).alias("w")).distinct()
        # A question has few words: what one lacks is a row.
        lacking = asked.join(held, ["query_id", "w"], "left_anti").groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list("w")), 1, gaps).alias("gap"))
        counts = new.groupBy("query_id").agg(F.count("*").alias("found"))
        now = open_.drop("text").join(counts, "query_id", "left").join(lacking, "query_id", "left")
        now = now.withColumns({"found": F.coalesce("found", F.lit(0)), "gap": F.coalesce("gap", F.array().cast("array<string>"))})
        now = materialize(now.withColumn("coverage", F.col("coverage") + F.col("found")), "rounds")
        rounds.append(now.select("query_id", F.lit(hop).alias("hop"), "found", "coverage", "gap"))
        going = now.where((F.col("coverage") < enough) & (F.size("gap") > 0))
        more = F.concat_ws(" ", "question", F.array_join(F.slice("gap", 1, refine), " "))
        open_ = materialize(going.select("query_id", "question", more.alias("text"), "coverage"), "open")
        if open_.isEmpty():
            break
    return evidence, reduce(DataFrame.union, rounds)


def hop_search(queries: DataFrame, legs: list[Leg], k: int = 5, hops: int = 3, least: float = 0.25, step: float = 0.1, words: int = 8, more: int = 3) -> DataFrame:
    """(query_id, place, id, hop, score, confidence): the legs' rows, and what further hops add where they are weak.

    The legs' rows, first leg first, are cut to k. A query whose best score is under
    `least` + `step` times the hop's number asks the last leg again, with the first
    `words` words of four letters or more of the row that the hop is at (the first
    row, then the second); its first `more` rows that begin like none so far come
    after the others. At the end the first k count; confidence is their mean score.
    """
    first = materialize(keep_first(_ask(legs, queries.select("query_id", "text"))), "first")
    merged = retrieval.top(first, ["query_id"], [F.col("leg"), F.col("rank"), F.col("id")], k, "place").withColumn("hop", F.lit(1))
    merged = materialize(merged.select("query_id", "place", "hop", "id", "score", "text"), "merged")
    seen, best = first.select("query_id", "text"), merged.where("place = 1").select("query_id", F.col("score").alias("best"))
    for hop in range(1, hops):
        weak = best.where(F.col("best") < least + step * hop).select("query_id")
        asks = merged.where(F.col("place") == hop).join(weak, "query_id").select("query_id", F.array_join(F.slice(F.regexp_extract_all("text", F.lit("[a-zA-Z]{4,}"), 0), 1, words), " ").alias("text"))
        asks = materialize(asks.where("text <> ''"), "asks")
        if asks.isEmpty():
            break
        found = _ask(legs[-1:], asks).where(F.col("rank") <= more)
        new = materialize(keep_first(found, seen), "hop")
        size = merged.groupBy("query_id").agg(F.max("place").alias("size"))
        placed = retrieval.top(new, ["query_id"], [F.col("rank"), F.col("id")], more, "nth").join(size, "query_id")
        merged = materialize(merged.unionByName(placed.select("query_id", (F.col("size") + F.col("nth")).alias("place"), F.lit(hop + 1).alias("hop"), "id", "score", "text")), "merged")
        seen = seen.union(new.select("query_id", "text"))
    last = merged.where(F.col("place") <= k)
    mean = last.groupBy("query_id").agg(F.round(F.avg("score"), 3).alias("confidence"))
    return last.join(mean, "query_id").select("query_id", "place", "id", "hop", "score", "confidence")


@lru_cache(200_000)
def _place(word: str, places: int) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % places


def hashed(text: Column, places: int = 64) -> Column:
    """Counts of a text's words, lower-cased, hashed into a number of places; not normalised. Null is empty."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def encode(words: pa.Array) -> pa.Array:
        out = [np.bincount([_place(w, places) for w in some], minlength=places).astype(float).tolist() if some else [0.0] * places for some in words.to_pylist()]
        return pa.array(out, pa.list_(pa.float64()))

    return encode(X.words(F.lower(F.coalesce(text, F.lit("")))))


def text_leg(docs: DataFrame, k: int) -> Leg:
    """BM25 over docs (id, text)."""
    index = TextIndex.create(docs.sparkSession)
    index.add(docs.select(F.col("id").alias("doc_id"), "text"))
    texts = docs.select("id", "text")

    def leg(queries: DataFrame) -> DataFrame:
        found = materialize(index.search(queries, k), "found")  # as its size is known, Catalyst needn't deal the texts
        return found.join(texts, found["doc_id"] == texts["id"]).select("query_id", "id", "score", "rank", "text")

    return leg


def hybrid_leg(docs: DataFrame, k: int, pool: int = 24) -> Leg:
    """.7 cosine of hashed words and .3 BM25 over docs (id, text); scores under .25 only in the first place."""
    bound_batches(docs.sparkSession)
    texts = docs.select("id", "text")
    index = TextIndex.create(docs.sparkSession)
    index.add(texts.select(F.col("id").alias("doc_id"), "text"))
    vectors = materialize(texts.select(F.col("id").alias("vec_id"), hashed(F.col("text")).alias("embedding")), "hashed")

    def leg(queries: DataFrame) -> DataFrame:
        asked = materialize(queries.select(F.col("query_id").alias("vec_id"), hashed(F.col("text")).alias("embedding")), "asked")
        # Queries and documents are numbered apart: a query's number must not hide the document of the same number.
        away = asked.withColumn("vec_id", -F.col("vec_id") - 1)
        dense = vector_index.exact_top(vectors, away, pool).withColumn("query_id", -F.col("query_id") - 1).drop("rank")
        sparse = index.search(queries, pool).select("query_id", F.col("doc_id").alias("vec_id"), "score")
        fused = materialize(retrieval.fuse(materialize(dense, "dense"), materialize(sparse, "sparse"), ["query_id", "vec_id"], k, pool=pool), "fused")
        return fused.join(texts, fused["vec_id"] == texts["id"]).select("query_id", "id", "score", "rank", "text")

    return leg
