"""Claim clusters against the fold, with the agreement of the column expression."""

import random

from millrace.functions import checks as K
from millrace.operators.attempts import cluster_claims
from pyspark.sql import functions as F


def test_clusters(spark):
    r = random.Random(2)
    phrases = ["top_k is 5", "top_k is 7", "the top k equals 5.", "I don't have enough information", "insufficient evidence here", "cats chase mice", "cats chase small mice", "dogs chase cats", "reset your password via the email link", "", "clear_session removes the session history", "the goal split pauses the parent"]
    rows = [(q, n, r.choice(phrases)) for q in range(12) for n in r.sample(range(50), r.choice((1, 5, 20)))] + [(None, 1, "x"), (99, None, "x")]
    claims = spark.createDataFrame(rows, "q long, nth long, answer string").select("q", "nth", K.claim(F.col("answer")).alias("c")).cache()
    pairs = claims.alias("a").join(claims.alias("b"), "q").where("a.nth <> b.nth").select("q", F.col("a.nth").alias("x"), F.col("b.nth").alias("y"), K.claims_agree(F.col("a.c"), F.col("b.c")).alias("v"))
    agree = {(p.q, p.x, p.y): p.v for p in pairs.collect()}
    want = {}
    for q in range(12):
        heads = []
        for n in sorted(n for p, n, _ in rows if p == q):
            head = next((h for h in heads if agree[q, n, h] >= 0.7), None)
            if head is None:
                heads.append(head := n)
            want[q, n] = head
    got = {(x.q, x.nth): x.head for x in cluster_claims(claims.select("q", "nth", "c.*")).collect()}
    assert got == want
    assert len(set(want.values())) > 3
