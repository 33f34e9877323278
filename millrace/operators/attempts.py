"""Attempts at one question, in clusters of claims that say the same."""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

FIELDS = ("subject", "predicate", "numbers", "negation", "key", "tokens")


def agreement(a: Row, b: Row) -> float:
    """`checks.claims_agree` of two rows."""
    if a.negation or b.negation:
        return float(a.negation and b.negation)
    numbered = bool(a.numbers) and bool(b.numbers)
    if numbered and a.numbers != b.numbers:
        return 0.0
    if a.key == b.key or (a.subject == b.subject and numbered):
        return 1.0
    if a.subject == b.subject and a.predicate != b.predicate:
        return 0.0
    one, two = set(a.tokens), set(b.tokens)
    mixed = 0.5 * len(one & two) / max(1, len(one | two)) + 0.3 * (a.subject == b.subject) + 0.2 * (a.predicate == b.predicate)
    return floor(mixed * 10_000 + 0.5) / 10_000


@F.udtf(returnType="q long, nth long, head long")
class ClaimClusters:
    """Over a question's claims in order: a claim joins the first cluster whose first claim it agrees with, or begins one."""

    def __init__(self) -> None:
        self.heads: list[Row] = []

    def eval(self, claim: Row, least: float) -> Iterator[tuple[int, int, int]]:
        for head in self.heads:
            if agreement(claim, head) >= least:
                yield claim.q, claim.nth, head.nth
                return
        self.heads.append(claim)
        yield claim.q, claim.nth, claim.nth


def cluster_claims(claims: DataFrame, least: float = 0.7) -> DataFrame:
    """(q, nth, head) of claims (q, nth, subject, predicate, numbers, negation, key, tokens).

    q is the question, nth the attempt's number, unique within it; head is the
    number of its cluster's first claim. A question's claims are read in order by one
    task, which keeps the heads alone: as many rows as there are different claims.
    Rows with a null q or nth take no part.
    """
    rows = claims.where("q is not null and nth is not null").select(F.col("q").cast("long").alias("q"), F.col("nth").cast("long").alias("nth"), *FIELDS)
    return ClaimClusters(rows.asTable().partitionBy("q").orderBy("nth"), F.lit(least))


#: A strategy and the kind of evidence it keeps alone where there is any; none: all kinds. Fixed values.
STRATEGIES = {"baseline": None, "retrieval_focused": "chunk", "memory_focused": "memory", "knowledge_focused": "fact", "thin_evidence": None}


def perturbed(evidence: DataFrame) -> DataFrame:
    """evidence (q, kind, nth, ...) under each strategy, with `strategy`.

    A focused strategy keeps its kind where the question has rows of it, else all;
    thin evidence is the first row of each kind, nth being 1. Other columns stay.
    """
    kinds = [k for k in STRATEGIES.values() if k]
    has = evidence.groupBy("q").agg(*[F.max(F.coalesce(F.col("kind") == k, F.lit(False))).alias(f"has_{k}") for k in kinds])
    rows = evidence.join(has, "q").withColumn("strategy", F.explode(F.array(*map(F.lit, STRATEGIES))))
    keep = F.when(F.col("strategy") == "thin_evidence", F.col("nth") == 1)
    for name, kind in STRATEGIES.items():
        if kind:
            keep = keep.when(F.col("strategy") == name, (F.col("kind") == kind) | ~F.col(f"has_{kind}"))
    return rows.where(keep.otherwise(True)).drop(*[f"has_{k}" for k in kinds])
