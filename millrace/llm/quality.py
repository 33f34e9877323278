"""Quality rules by weak supervision, natively.

Text statistics give eight rules; each votes for (+1) or against (-1) a
document or abstains (0). Expectation-maximisation over the histogram of vote
patterns, of at most 3^8 rows whatever the input, estimates how accurate each
kind of vote of each rule is among good and among bad documents, and the share
of good ones; a document's posterior probability of being good follows from
its votes. A prior worth PULL of all documents keeps the two classes from
drifting to some other division of the corpus. The whole of it is DataFrame and SQL
functions: the EM is one fold over an array, in one row.

Repeated 5-word windows are found in each text by sorting (hash, position)
pairs, only in texts where two windows share a hash; windows of one text with the
same XXH64 value count as equal. All other statistics are exact.

Defined cases: null or empty text has no words and is not kept; null or
repeated ids are judged row by row; an empty table gives an empty result;
columns that clash with an output are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.runtime import materialize

WINDOW, MIN_WORDS, ROUNDS = 5, 10, 25
PRIOR, LOW, HIGH, PULL = 0.9, 0.5, 0.999, 0.02
#: Starting shares of votes against, abstentions and votes for. Fixed values.
GOOD, BAD = (0.01, 0.19, 0.8), (0.3, 0.15, 0.55)

SPACE = " \t\n\x0b\x0c\r"


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_chars, n_letters, n_upper, n_ends)."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.trim(F.col("body"), F.lit(SPACE))
    words = F.when(F.length(trimmed) > 0, F.split(trimmed, "[\\x20\\x09-\\x0D]+")).otherwise(F.expr("cast(array() as array<string>)"))
    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    base = docs.select(F.col(id_col).alias("doc_id"), body.alias("body")).select("doc_id", "body", words.alias("w"), lines.alias("lines"))
    n = F.size("w")
    window = F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(*[F.element_at("w", (i + k).cast("int")) for k in range(WINDOW)]))
    counted = base.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length("body").cast("long").alias("n_chars"),
        F.regexp_count("body", F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("body", "\\P{L}+", "")).cast("long").alias("n_letters"),
        F.regexp_count("body", F.lit("[!?]")).cast("long").alias("n_exclaims"),
        F.regexp_count("body", F.lit("[.!?][\"')\\]]*(?:[\\x20\\x09-\\x0D]|$)")).cast("long").alias("n_ends"),
        F.when(n >= WINDOW, window).otherwise(F.expr("cast(array() as array<bigint>)")).alias("g"),
    )
    pairs = F.sort_array(F.zip_with("g", F.sequence(F.lit(1), F.size("g")), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sorted_ = counted.withColumn("s", F.when((F.size("g") > 1) & (F.size(F.array_distinct("g")) < F.size("g")), pairs)).drop("g")
    hash_at = lambda i: F.try_element_at("s", i.cast("int"))["h"]
    twice = F.filter(F.sequence(F.lit(1), F.size("s")), lambda k: ((k > 1) & (hash_at(F.greatest(k - 1, F.lit(1))) == hash_at(k))) | (hash_at(k + 1) == hash_at(k)))
    placed = sorted_.withColumn("p", F.when(F.col("s").isNotNull(), F.sort_array(F.transform(twice, lambda k: F.element_at("s", k.cast("int"))["i"])))).drop("s")
    gaps = F.aggregate(F.sequence(F.lit(2), F.size("p")), F.lit(WINDOW).cast("long"), lambda acc, k: acc + F.least(F.lit(WINDOW), F.element_at("p", k.cast("int")) - F.element_at("p", (k - 1).cast("int"))))
    return placed.withColumn("n_repeat_words", F.when(F.size("p") > 1, gaps).otherwise(0).cast("long")).drop("p")


def rule_votes() -> dict[str, Column]:
    """The rules, by name: +1 for, -1 against, 0 abstains. Thresholds are fixed values."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_chars"), F.lit(1))
    mean = F.col("word_chars") / words
    votes = {
        "length": (F.col("n_words") >= 20, F.col("n_words") < 10),
        "letters": (F.col("n_letters") / chars >= 0.7, F.col("n_letters") / chars < 0.6),
        "word_length": (mean.between(3, 14), (mean < 2) | (mean > 24)),
        "symbols": (F.col("n_symbols") / words <= 0.02, F.col("n_symbols") / words > 0.15),
        "repeats": ((100 * F.col("n_repeat_words") <= 5 * words) & (F.col("n_dup_lines") == 0), (100 * F.col("n_repeat_words") > 15 * words) | (F.col("n_dup_lines") >= 5)),
        "capitals": (F.col("n_upper") / chars <= 0.1, F.col("n_upper") / chars > 0.3),
        "exclaims": (F.col("n_exclaims") / words <= 0.05, F.col("n_exclaims") / words > 0.3),
        "sentences": (F.col("n_ends") * 60 >= words, (F.col("n_ends") == 0) & (words > 80)),
    }
    return {k: F.when(good, 1).when(bad, -1).otherwise(0) for k, (good, bad) in votes.items()}


def fit_accuracies(votes: DataFrame, n_rules: int, rounds: int = ROUNDS) -> DataFrame:
    """One row (prior, good, bad): EM over a table with `v`, an array of n_rules votes.

    good and bad hold, for each rule in turn, the shares of votes against,
    abstentions and votes for among good and among bad documents.
    """
    hist = votes.groupBy("v").agg(F.count("*").cast("double").alias("n"))
    rows = hist.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("rows"))  # at most 3^n_rules

    def start(shares: tuple[float, ...]) -> str:
        return "array(" + ", ".join(f"{x!r}D" for x in shares * n_rules) + ")"

    def shares(weight: str, shares_at_start: str) -> str:
        total = f"aggregate(e, 0D, (a, x) -> a + x.n * {weight})"
        mine = f"aggregate(e, 0D, (a, x) -> a + CASE WHEN element_at(x.v, CAST(j div 3 AS INT) + 1) = j % 3 - 1 THEN x.n * {weight} ELSE 0D END)"
        return f"transform(sequence(0, {3 * n_rules - 1}), j -> ({mine} + pull * element_at({shares_at_start}, j + 1)) / ({total} + pull))"

    step = f"""
      aggregate(sequence(1, {rounds}), named_struct('prior', {PRIOR}D, 'good', {start(GOOD)}, 'bad', {start(BAD)}),
        (p, t) -> transform(array(transform(rows, r -> named_struct('v', r.v, 'n', r.n, 'q', {posterior_sql("p.prior", "p.good", "p.bad", "r.v", n_rules)}))), e -> named_struct(
          'prior', greatest({LOW}D, least({HIGH}D, aggregate(e, 0D, (a, x) -> a + x.n * x.q) / greatest(1D, aggregate(e, 0D, (a, x) -> a + x.n)))),
          'good', {shares("x.q", start(GOOD))},
          'bad', {shares("(1 - x.q)", start(BAD))}))[0]) AS fit"""
    pull = f"{PULL}D * aggregate(rows, 0D, (a, x) -> a + x.n) + 1 AS pull"
    return rows.selectExpr("rows", pull).selectExpr(step).selectExpr("fit.prior AS prior", "fit.good AS good", "fit.bad AS bad")


def posterior_sql(prior: str, good: str, bad: str, v: str, n_rules: int) -> str:
    """SQL for the probability of good, given the fit and the votes."""
    term = f"ln(element_at({good}, k * 3 + element_at({v}, k + 1) + 2)) - ln(element_at({bad}, k * 3 + element_at({v}, k + 1) + 2))"
    return f"1 / (1 + exp(-(ln({prior}) - ln(1 - {prior}) + aggregate(sequence(0, {n_rules - 1}), 0D, (s, k) -> s + {term}))))"


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """text_stats and base_failed, posterior, kept of every row."""
    rules = rule_votes()
    stats = materialize(text_stats(docs, id_col, text_col), "quality")
    voted = stats.withColumn("v", F.array(*rules.values()))
    fit = fit_accuracies(voted, len(rules)).first()
    literal = lambda shares: "array(" + ", ".join(f"{x!r}D" for x in shares) + ")"
    posterior = F.expr(posterior_sql(f"{fit['prior']!r}D", literal(fit["good"]), literal(fit["bad"]), "v", len(rules)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = voted.withColumn("posterior", posterior).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least)).drop("v")
