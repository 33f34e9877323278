"""Queries: signatures and cross-source duplicates, admission, releases and their checks, inputs, arithmetic."""

from __future__ import annotations

import ast
import math
import operator
import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import checks as K
from millrace.functions import text as X
from millrace.functions.cleaners import strip
from millrace.operators import memory, merkle, similarity
from millrace.plans.catalog import HAS_PII, N_WORDS, docs, query
from millrace.plans.checking import sql_cases
from millrace.plans.cleaning import SPACES, sql_words
from millrace.plans.kit import Rows, literal
from millrace.runtime import materialize, table

col = F.col

# --- signatures ---

P61 = "2305843009213693951::HUGEINT"


def _signature_sql(source: str) -> str:
    """sig(id, source, sig) of source(id, source, text) by the same permutations; MD5 is taken as two halves, 2^64 being 8 modulo 2^61 - 1."""
    ab = ", ".join(f"({i}, {a}::HUGEINT, {b}::HUGEINT)" for i, (a, b) in enumerate(similarity.permutations()))
    return rf"""ab(i, a, b) AS (VALUES {ab}), flat AS (SELECT id, source, trim(regexp_replace(lower(text), '{SPACES}', ' ', 'g')) AS t FROM {source}),
  grams AS (SELECT DISTINCT id, source, unnest(CASE WHEN length(t) < 5 THEN [t] ELSE list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5)) END) AS g FROM flat WHERE t <> ''),
  h AS (SELECT id, source, ((('0x' || substr(md5(g), 1, 16))::UBIGINT::HUGEINT % {P61}) * 8 + ('0x' || substr(md5(g), 17, 16))::UBIGINT::HUGEINT % {P61}) % {P61} AS h FROM grams),
  slots AS (SELECT id, source, i, min((a * h + b) % {P61}) AS v FROM h, ab GROUP BY id, source, i), sig AS (SELECT id, source, list(v::BIGINT ORDER BY i) AS sig FROM slots GROUP BY id, source)"""


@query(f"WITH c AS (SELECT conv_id * 1000 + turn AS id, role AS source, text FROM conversations), {_signature_sql('c')} SELECT id, len(sig)::INTEGER AS n, sha256(array_to_string(sig, ',')) AS signature FROM sig")
def minhash_signatures(spark, sf):
    """128 permutations over 5-character shingles of each turn."""
    c = table(spark, sf, "conversations").select((col("conv_id") * 1000 + col("turn")).alias("id"), X.squeeze(F.lower("text")).alias("t")).where("t <> ''")
    return c.select("id", similarity.minhash()(col("t")).alias("sig")).select("id", F.size("sig").alias("n"), F.sha2(F.array_join("sig", ","), 256).alias("signature"))


_BASE = "the harbour master counted every vessel that entered the bay between dawn and noon and wrote its name tonnage and cargo into a heavy ledger bound in green cloth before the clerk carried it to the office on the hill"
NEAR = Rows(
    "near",
    "id int, source string, text string",
    (
        (1, "A", _BASE), (2, "B", _BASE.upper() + "  "), (3, "B", _BASE.replace("green", "brown")), (4, "C", "nothing of the kind stands here at all, only other words about trains"), (5, "A", "nothing of the kind stands here at all, only other words about trains"),
        (6, "A", _BASE), (7, "C", "abc"), (8, "B", "abc"), (9, "C", " "), (10, "C", _BASE[:90]),
    ),
).over("benchmark", "t.item_id", True, id="t.item_id * 100 + p.id", text="t.text || ' ' || p.text")


@query(f"""WITH {NEAR.cte}, {_signature_sql('near')}, bands AS (SELECT id, source, k, sig[k * 4 + 1 : k * 4 + 4] AS key FROM sig, (SELECT unnest(range(32)) AS k)),
  pairs AS (SELECT DISTINCT x.id AS a, y.id AS b FROM bands x JOIN bands y ON x.k = y.k AND x.key = y.key AND x.source < y.source),
  gone AS (SELECT DISTINCT b FROM pairs JOIN sig p ON a = p.id JOIN sig q ON b = q.id WHERE len(list_filter(list_zip(p.sig, q.sig), lambda z: z[1] = z[2])) / 128.0 >= 0.85) SELECT id, source, id NOT IN (SELECT b FROM gone) AS kept FROM sig""")
def cross_source_dedup(spark, sf):
    """Texts of later sources go that are near one of an earlier source: each benchmark text with ten endings in three sources."""
    return similarity.cross_source_duplicates(NEAR.df(spark, sf), materialize)


@query()
def cross_source_documents(spark, sf):
    """The same over all documents and their sources."""
    return similarity.cross_source_duplicates(docs(spark, sf).select(col("doc_id").alias("id"), "source", "text"), materialize)


@query("SELECT doc_id, len(s)::INTEGER AS n, list_sum(list_transform(s, lambda g: length(g)))::BIGINT AS chars FROM (SELECT doc_id, list_distinct(CASE WHEN length(text) < 5 THEN [text] ELSE list_transform(range(1, length(text) - 3), lambda i: substr(text, i, 5)) END) AS s FROM documents)")
def character_shingles(spark, sf):
    """Distinct 5-character shingles of each text, as a count."""
    return docs(spark, sf).select("doc_id", similarity.character_shingles()(col("text")).alias("s")).select("doc_id", "s.n", "s.chars")


@query(f"""WITH t AS (SELECT conv_id, turn, unnest({sql_words('lower(text)')}) AS w FROM conversations), b AS (SELECT conv_id, turn, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS k, count(*) AS n FROM t GROUP BY 1, 2, 3),
  l AS (SELECT *, sqrt(sum(n * n) OVER (PARTITION BY conv_id, turn)) AS norm FROM b) SELECT conv_id, turn, k, round(n / norm, 6)::DOUBLE AS v FROM l""")
def hashed_vectors(spark, sf):
    """Texts as normalised counts of words hashed into 64 places."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(X.words(F.lower("text"))).alias("w"))
    k = F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long") % 64
    b = t.groupBy("conv_id", "turn", k.alias("k")).agg(F.count("*").alias("n"))
    norm = b.groupBy("conv_id", "turn").agg(F.sqrt(F.sum(col("n") * col("n"))).alias("norm"))
    return b.join(norm, ["conv_id", "turn"]).select("conv_id", "turn", "k", F.round(col("n") / col("norm"), 6).alias("v"))


# --- admission ---

DAY = 86400.0
HISTORY = Rows(
    "history",
    "owner string, at int, text string, ts double",
    (("u", 0, "I prefer the dark editor theme", 100_000.0), ("u", 1, "The quarterly budget meeting is on Friday", 100_000.0), ("u", 2, "My dog sleeps on the sofa", 0.0)),
).over("customer", "t.c_custkey", True, owner="p.owner || t.c_custkey")
CANDIDATES = Rows(
    "candidates",
    "id int, owner string, text string, kind string, hint double, now double",
    (
        (1, "u", "  ", "fact", 1.0, 150_000.0), (2, "u", "ok thanks", "fact", 1.0, 150_000.0), (3, "u", "I prefer the dark editor theme", "preference", 1.0, 150_000.0), (4, "u", "Actually I meant to say the light one", "fact", 1.0, 150_000.0),
        (5, "u", "I prefer the very dark editor themes", "preference", 1.0, 150_000.0), (6, "u", "The big quarterly budget meeting is on Fridays", "fact", 0.2, 150_000.0), (7, "u", "The big quarterly budget meeting is on Fridays", "goal", 2.0, 300_000.0), (8, "u", "My old dog sleeps on the sofas", "episodic", 0.0, 300_000.0),
        (9, "v", "zzz qqq", "fact", 0.1, 1.0), (10, "v", "Important goal: always remember that the policy deadline must never be changed, note that the budget is fixed", "goal", 2.0, 1.0), (11, "u", "Important goal: I always prefer to remember that the policy deadline must change", "goal", 2.0, 150_000.0),
        (12, "u", "The team will travel to the coast and should pack warm clothes", "project", 1.5, 150_000.0), (13, "u", "a walk", "episodic", 0.0, 150_000.0),
    ),
).over("customer", "t.c_custkey", True, id="t.c_custkey * 100 + p.id", owner="p.owner || t.c_custkey")
@query()
def admission_policy(spark, sf):
    """What the policy says of candidate memories of every customer; SQL can't match blocks of texts."""
    return memory.admissions(CANDIDATES.df(spark, sf), HISTORY.df(spark, sf)).select("id", "reason")


# --- releases ---


@query(f"""WITH k AS (SELECT source, count(*) AS raw, count(*) FILTER (WHERE length(trim(text)) > 0) AS clean, count(DISTINCT sha256(text)) AS dedup, count(*) FILTER (WHERE {N_WORDS} >= 8) AS approved, sum(octet_length(encode(text))) AS bytes, min(sha256(text)) AS least FROM documents GROUP BY source)
  SELECT source, raw, clean, dedup, approved, round(approved * 100.0 / raw, 1)::DOUBLE AS retention, floor(bytes / 3.8)::BIGINT AS tokens, least AS sha256 FROM k""")
def source_manifests(spark, sf):
    """Each source's counts by stage, retention, tokens and a checksum."""
    # Copies are counted first, by hash, so that no text is sorted or sent.
    texts = docs(spark, sf).groupBy("source", F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("raw"), F.count_if(F.length(F.trim("text")) > 0).alias("clean"), F.count_if(X.has_words(col("text"), 8)).alias("approved"), F.sum(F.octet_length("text")).alias("bytes"))
    k = texts.groupBy("source").agg(*[F.sum(c).alias(c) for c in ("raw", "clean", "approved", "bytes")], F.count("sha256").alias("dedup"), F.min("sha256").alias("sha256"))
    return k.select("source", "raw", "clean", "dedup", "approved", F.round(col("approved") * 100.0 / col("raw"), 1).alias("retention"), F.floor(col("bytes") / 3.8).cast("long").alias("tokens"), "sha256")


SPLIT_SQL = "sp AS (SELECT doc_id, lang, source, text, floor(length(text) / 3.8)::BIGINT AS tokens, CASE WHEN b < 5 THEN 'test' WHEN b < 10 THEN 'val' ELSE 'train' END AS split FROM (SELECT *, ('0x' || substr(sha256('42:' || doc_id), 1, 6))::BIGINT % 100 AS b FROM documents))"


def _splits(spark, sf):
    b = F.conv(F.substring(X.stable_rank(col("doc_id")), 1, 6), 16, 10).cast("long") % 100
    split = F.when(b < 5, "test").when(b < 10, "val").otherwise("train")
    return docs(spark, sf).select("doc_id", "lang", "source", "text", F.floor(F.length("text") / 3.8).cast("long").alias("tokens"), split.alias("split"))


@query(f"WITH {SPLIT_SQL} SELECT split, count(*) AS docs, sum(tokens)::BIGINT AS tokens, array_to_string(list_sort(list(DISTINCT lang)), ',') AS categories, count(DISTINCT source) AS sources, min(sha256(text)) AS checksum FROM sp GROUP BY split")
def release_manifest(spark, sf):
    """A release's splits: documents, tokens, categories, sources, checksum."""
    return _splits(spark, sf).groupBy("split").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("categories"), F.count_distinct("source").alias("sources"), F.min(F.sha2("text", 256)).alias("checksum"))


@query(f"""WITH {SPLIT_SQL}, h AS (SELECT split, sha256(lower(trim(text))) AS h FROM sp), c AS (SELECT (SELECT count(DISTINCT split) FROM sp) AS splits, (SELECT count(*) FROM (SELECT h FROM h WHERE split = 'train' INTERSECT SELECT h FROM h WHERE split = 'val')) AS leak_v, (SELECT count(*) FROM (SELECT h FROM h WHERE split = 'train' INTERSECT SELECT h FROM h WHERE split = 'test')) AS leak_t, (SELECT sum(tokens) FROM sp) AS tokens)
  SELECT 'splits_exist' AS name, splits = 3 AS passed, splits::BIGINT AS n FROM c UNION ALL SELECT 'no_train_val_leakage', leak_v = 0, leak_v FROM c UNION ALL SELECT 'no_train_test_leakage', leak_t = 0, leak_t FROM c UNION ALL SELECT 'tokens_within_budget', tokens <= 1000000000, tokens::BIGINT FROM c""")
def release_checks(spark, sf):
    """The checks of a release, a row each: splits, leakage by intersection, budget."""
    s = materialize(_splits(spark, sf).select("split", "tokens", F.sha2(F.lower(F.trim("text")), 256).alias("h")), "splits")
    of = lambda k: s.where(col("split") == k).select("h")
    leak = lambda k: of("train").intersect(of(k)).agg(F.count("*").alias("n"))
    row = lambda name, df, ok: df.select(F.lit(name).alias("name"), ok.alias("passed"), col("n").cast("long").alias("n"))
    n = col("n")
    return (
        row("splits_exist", s.agg(F.count_distinct("split").alias("n")), n == 3)
        .union(row("no_train_val_leakage", leak("val"), n == 0))
        .union(row("no_train_test_leakage", leak("test"), n == 0))
        .union(row("tokens_within_budget", s.agg(F.sum("tokens").alias("n")), n <= 1_000_000_000))
    )


_FIRST = "sha256('42:' || doc_id)"


@query(f"""WITH o AS (SELECT *, row_number() OVER (ORDER BY {_FIRST}) AS rn FROM documents), c AS (SELECT count(*) AS n, avg({N_WORDS})::DOUBLE AS words, count(*) FILTER (WHERE rn <= 100 AND {HAS_PII}) AS pii, avg(({N_WORDS} >= 8)::INT)::DOUBLE AS good, sum(length(text))::DOUBLE / sum({N_WORDS}) AS fertility FROM o)
  SELECT 'min_paragraphs' AS name, n >= 50 AS passed FROM c UNION ALL SELECT 'no_pii', pii = 0 FROM c UNION ALL SELECT 'quality_rate', good >= 0.95 FROM c UNION ALL SELECT 'avg_word_count', words >= 10 FROM c UNION ALL SELECT 'fertility', fertility >= 3.0 FROM c""")
def corpus_validation(spark, sf):
    """The checks of a corpus, a row each; personal data are looked for in the first hundred texts by a seeded hash."""
    d = docs(spark, sf).select(X.approx_tokens(col("text")).alias("w"), F.length("text").alias("chars"), X.has_pii(col("text")).alias("pii"), X.stable_rank(col("doc_id")).alias("h"))
    d = materialize(d, "validation")
    c = d.agg(F.count("*").alias("n"), F.avg("w").alias("words"), F.avg((col("w") >= 8).cast("int")).alias("good"), (F.sum("chars") / F.sum("w")).alias("fertility"))
    pii = d.orderBy("h").limit(100).agg(F.count_if("pii").alias("pii"))
    one = c.join(F.broadcast(pii))
    checks = {"min_paragraphs": col("n") >= 50, "no_pii": col("pii") == 0, "quality_rate": col("good") >= 0.95, "avg_word_count": col("words") >= 10, "fertility": col("fertility") >= 3.0}
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("passed")) for k, v in checks.items()])).alias("c")).select("c.*")


MANIFESTS = Rows(
    "manifests",
    "id int, body string, actual string",
    (
        (1, '{"release_id": "v1", "release_date": "d", "released_by": "x", "checksums": {"train": "sha256:abc"}, "sources": [], "split_ratios": [0.9, 0.05, 0.05], "shuffle_seed": 42}', "abc"),
        (2, '{"release_id": "v2", "checksums": {"train": "sha256:abc"}, "sources": [], "split_ratios": [0.9, 0.05]}', "abd"),
        (3, '{}', "x"),
    ),
).over("documents", "t.doc_id", id="t.doc_id", actual="CASE WHEN t.doc_id % 5 = 0 THEN p.actual || t.doc_id ELSE p.actual END")
NEEDED = ("release_id", "release_date", "released_by", "checksums", "sources", "split_ratios", "shuffle_seed")


@query(f"""WITH {MANIFESTS.cte}, e AS (SELECT id, list_filter([{', '.join(f"CASE WHEN (body -> '$.{f}') IS NULL THEN 'Missing required field: {f}' END" for f in NEEDED)}, CASE WHEN abs(list_sum(CAST(body -> '$.split_ratios' AS DOUBLE[])) - 1) > 0.01 THEN 'split_ratios' END,
  CASE WHEN replace((body ->> '$.checksums.train'), 'sha256:', '') <> actual THEN 'Checksum mismatch' END], lambda x: x IS NOT NULL) AS errors FROM manifests) SELECT id, len(errors) = 0 AS valid, array_to_string(errors, '; ') AS errors FROM e""")
def manifest_validation(spark, sf):
    """What is wrong with release manifests."""
    at = lambda f: F.get_json_object("body", f"$.{f}")
    ratios = F.aggregate(F.from_json(at("split_ratios"), "array<double>"), F.lit(0.0), lambda a, x: a + x)
    made = [*(F.when(at(f).isNull(), f"Missing required field: {f}") for f in NEEDED), F.when(F.abs(ratios - 1) > 0.01, "split_ratios"), F.when(F.replace(at("checksums.train"), F.lit("sha256:"), F.lit("")) != col("actual"), "Checksum mismatch")]
    errors = F.filter(F.array(*made), lambda x: x.isNotNull())
    return MANIFESTS.df(spark, sf).select("id", (F.size(errors) == 0).alias("valid"), F.array_join(errors, "; ").alias("errors"))


def _tree_sql(name: str, rows: str) -> str:
    """CTEs {name}0 to {name}4 with a hash tree's levels over rows (part, doc_id, text)."""
    parts = [f"{name}0 AS (SELECT part, doc_id AS node, string_agg(h, '' ORDER BY h) AS hash FROM (SELECT part, doc_id, sha256(coalesce(text, '')) AS h FROM ({rows})) GROUP BY 1, 2)"]
    parts += [f"{name}{i + 1} AS (SELECT part, node // {merkle.FAN} AS node, sha256(string_agg(node || ':' || hash, ',' ORDER BY node)) AS hash FROM {name}{i} GROUP BY 1, 2)" for i in range(merkle.LEVELS)]
    return ", ".join(parts)


@query(f"""WITH {SPLIT_SQL}, {_tree_sql("t", "SELECT coalesce(source, '') AS part, doc_id, text FROM sp WHERE lang IN ('en', 'de')")}, r AS (SELECT part, sha256(string_agg(hash, '' ORDER BY node)) AS hash FROM t{merkle.LEVELS} GROUP BY part)
  SELECT r.part AS source, tokens, hash FROM r JOIN (SELECT coalesce(source, '') AS part, sum(tokens)::BIGINT AS tokens FROM sp WHERE lang IN ('en', 'de') GROUP BY 1) USING (part)""")
def release_lock(spark, sf):
    """The lock of a release: the root of a hash tree over each source's documents, for the chosen languages."""
    s = _splits(spark, sf).where(col("lang").isin("en", "de")).withColumn("part", F.coalesce("source", F.lit("")))
    root = merkle.roots(merkle.tree(s.select("part", "doc_id", "text")))
    return s.groupBy("part").agg(F.sum("tokens").alias("tokens")).join(root, "part").select(col("part").alias("source"), "tokens", "hash")


@query("""SELECT part, doc_id, CASE WHEN h1 IS NULL THEN 'added' WHEN h2 IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT coalesce(source, '') AS part, doc_id, sha256(text) AS h1 FROM documents WHERE lang <> 'es') a
  FULL JOIN (SELECT coalesce(source, '') AS part, doc_id, sha256(CASE WHEN n_chars % 7 = 0 THEN text || '.' ELSE text END) AS h2 FROM documents WHERE lang <> 'fr') b USING (part, doc_id) WHERE h1 IS DISTINCT FROM h2""")
def release_differences(spark, sf):
    """What differs between two releases, by their hash trees: one has other languages, and some texts are longer."""
    d = docs(spark, sf).withColumn("part", F.coalesce("source", F.lit("")))
    new = d.where("lang <> 'fr'").withColumn("text", F.when(col("n_chars") % 7 == 0, F.concat("text", F.lit("."))).otherwise(col("text")))
    return merkle.differences(merkle.tree(d.where("lang <> 'es'").select("part", "doc_id", "text")), merkle.tree(new.select("part", "doc_id", "text")))


@query("SELECT coalesce(source, '') AS part, doc_id, n_chars % 3 <> 0 AS ok FROM documents WHERE doc_id % 50 = 0")
def release_proofs(spark, sf):
    """Whether every fiftieth document is what the lock says, by proofs; some texts are changed first."""
    d = docs(spark, sf).select(F.coalesce("source", F.lit("")).alias("part"), "doc_id", "text", "n_chars")
    nodes = materialize(merkle.tree(d.select("part", "doc_id", "text")), "tree")
    some = d.where("doc_id % 50 = 0").select("part", "doc_id", F.when(col("n_chars") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(col("text")).alias("text"))
    return merkle.verify(merkle.proofs(nodes, some), some, merkle.roots(nodes))


RUNS = Rows(
    "runs",
    "id int, locked boolean, checksum string, expected string, free_gb double, tokens long, target long, open_shards int, step int, last_step int",
    ((1, True, "a", "a", 50.0, 10, 100, 3, 5, 5), (2, False, "a", "b", 1.0, 10, 100, 0, 5, 7), (3, True, "a", "a", 20.0, 200, 100, 1, 0, 0)),
).over("supplier", "t.s_suppkey", id="t.s_suppkey", free_gb="p.free_gb - t.s_suppkey % 30", step="p.step + t.s_suppkey % 2")
RESUME = (("release_locked", "locked"), ("checksum", "checksum = expected"), ("disk", "free_gb >= 10"), ("budget_left", "tokens < target"), ("shards_left", "open_shards > 0"), ("step_known", "step = last_step"))


@query(f"WITH {RUNS.cte}, c AS ({' UNION ALL '.join(f"SELECT id, '{k}' AS name, {e} AS passed FROM runs" for k, e in RESUME)}) SELECT id, name, passed, bool_and(passed) OVER (PARTITION BY id) AS may_resume FROM c")
def resume_checks(spark, sf):
    """Whether runs may resume: a row for each check."""
    r = RUNS.df(spark, sf)
    every = F.expr(" and ".join(f"({e})" for _, e in RESUME))
    return r.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.expr(e).alias("passed")) for k, e in RESUME])).alias("c"), every.alias("may_resume")).select("id", "c.*", "may_resume")


@query("SELECT stage, n FROM (SELECT 'raw' AS stage, count(*) AS n FROM documents UNION ALL SELECT 'clean', count(*) FILTER (WHERE length(trim(text)) >= 32) FROM documents UNION ALL SELECT 'dedup', count(DISTINCT sha256(text)) FILTER (WHERE length(trim(text)) >= 32) FROM documents UNION ALL SELECT 'approved', count(DISTINCT sha256(text)) FILTER (WHERE length(trim(text)) >= 200) FROM documents)")
def stage_report(spark, sf):
    """What each stage of the corpus pipeline leaves, in one pass."""
    long = lambda n: F.length(F.trim("text")) >= n
    h = F.sha2("text", 256)
    one = docs(spark, sf).agg(F.count("*").alias("raw"), F.count_if(long(32)).alias("clean"), F.count_distinct(F.when(long(32), h)).alias("dedup"), F.count_distinct(F.when(long(200), h)).alias("approved"))
    return one.unpivot([], ["raw", "clean", "dedup", "approved"], "stage", "n")


# --- inputs ---

PATHS = Rows("paths", "id int, path string, exists boolean", ((1, "a.PDF", True), (2, "b.png", True), (3, "c.wav", True), (4, "hello there", False), (5, "d.xyz", True), (6, "e.py", True), (7, "f.docx", False))).over("pages", "t.page_id", id="t.page_id", path="t.url || '/' || p.path")
KINDS = {"document": (".pdf", ".docx", ".txt", ".md", ".csv", ".xlsx", ".xls", ".json", ".yaml", ".toml", ".log", ".py"), "image": (".png", ".jpg", ".jpeg", ".bmp", ".tiff", ".webp"), "voice": (".wav", ".mp3", ".m4a", ".ogg", ".flac")}


@query(f"WITH {PATHS.cte}, s AS (SELECT *, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS ext FROM paths) SELECT id, {sql_cases([(f'exists AND ext IN {v}', literal(k)) for k, v in KINDS.items()], "'text'")} AS kind FROM s")
def input_kinds(spark, sf):
    """What an input is, by its suffix if it is a file."""
    ext = F.lower(F.regexp_extract("path", "(\\.[^./]+)$", 1))
    return PATHS.df(spark, sf).select("id", K.cases([(col("exists") & ext.isin(*v), F.lit(k)) for k, v in KINDS.items()], F.lit("text")).alias("kind"))


@query("SELECT page_id, contains(lower(url), 'the') AS by_name FROM pages WHERE contains(lower(url), 'the') OR contains(lower(html), 'the') ORDER BY page_id LIMIT 10")
def file_search(spark, sf):
    """The first ten pages with a word in their name, else in their text."""
    named = F.contains(F.lower("url"), F.lit("the"))
    return table(spark, sf, "pages").where(named | F.contains(F.lower("html"), F.lit("the"))).orderBy("page_id").limit(10).select("page_id", named.alias("by_name"))


@query(f"SELECT doc_id, len(w)::INTEGER + 2 AS n, 1 AS first, 2 AS last, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS total FROM (SELECT doc_id, {sql_words('text')} AS w FROM documents) WHERE len(w) > 0")
def token_stream(spark, sf):
    """Each document as one sequence of ids between BOS and EOS; a word's length stands for its id."""
    from millrace.functions import arrays as A

    ids = F.concat(F.array(F.lit(A.BOS)), F.transform(X.words(col("text")), F.length), F.array(F.lit(A.EOS)))
    t = docs(spark, sf).select("doc_id", ids.alias("ids")).where(F.size("ids") > 2)
    total = F.aggregate("ids", F.lit(0), lambda a, x: a + x) - A.BOS - A.EOS
    return t.select("doc_id", F.size("ids").alias("n"), col("ids")[0].alias("first"), F.element_at("ids", -1).alias("last"), total.cast("long").alias("total"))


LINES = Rows("lines", "n int, line string", ((1, '{"instruction": "a", "response": "b"}'), (2, '{"instruction": "a"}'), (3, "not json"), (4, '{"instruction": "", "response": "c", "more": 1}'))).over("documents", "t.doc_id", n="t.doc_id", line="replace(p.line, '\"a\"', '\"' || PLAIN(t.text) || '\"')")


@query(f"WITH {LINES.cte} SELECT n, CASE WHEN NOT json_valid(line) THEN 'invalid JSON' WHEN line ->> '$.instruction' IS NULL OR line ->> '$.response' IS NULL THEN 'missing field' ELSE 'ok' END AS state FROM lines")
def instruction_lines(spark, sf):
    """Lines of an instruction file: fit, or why not, by line."""
    v = F.try_parse_json("line")
    has = lambda f: F.get_json_object("line", f"$.{f}").isNotNull()
    return LINES.df(spark, sf).select("n", F.when(v.isNull(), "invalid JSON").when(~has("instruction") | ~has("response"), "missing field").otherwise("ok").alias("state"))


SUMS = Rows("sums", "id int, expression string", ((1, "what is @ + 3 * 4"), (2, "compute (7 - @) ^ 2 / 5"), (3, "10 % 4 + 7 // @"), (4, "-@ + 1"), (5, "@ / 0"), (6, "no numbers"), (7, "(sqrt(16) + abs(-@))"), (8, "@ + import os"))).over("customer", "t.c_custkey", id="t.c_custkey", which="p.id", k="t.c_custkey % 9 + 1", expression="replace(p.expression, '@', '' || (t.c_custkey % 9 + 1))")
_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow, ast.Mod: operator.mod, ast.FloorDiv: operator.floordiv, ast.USub: operator.neg, ast.UAdd: operator.pos}
_FUNCTIONS = {f.__name__: f for f in (math.sqrt, math.log, math.sin, math.cos, math.tan, abs, round, math.floor, math.ceil, math.exp)}


def evaluate(expression: str) -> float | None:
    """The value of the arithmetic in a text; None where there is none or it can't be computed. Only numbers, operators and ten functions are known."""

    def of(node) -> float:
        match node:
            case ast.Expression(body=b):
                return of(b)
            case ast.Constant(value=int() | float() as v):
                return v
            case ast.BinOp(left=a, op=o, right=b) if type(o) in _OPERATORS:
                return _OPERATORS[type(o)](of(a), of(b))
            case ast.UnaryOp(op=o, operand=a) if type(o) in _OPERATORS:
                return _OPERATORS[type(o)](of(a))
            case ast.Call(func=ast.Name(id=f), args=args) if f in _FUNCTIONS:
                return _FUNCTIONS[f](*map(of, args))
        raise ValueError(type(node).__name__)

    found = re.search(r"[0-9(][0-9a-z+\-*/%(). ,_]*", expression.lower().replace("^", "**"))
    try:
        return float(of(ast.parse(found.group(0).strip(), mode="eval"))) if found else None
    except (ValueError, SyntaxError, ArithmeticError, TypeError):
        return None


@F.arrow_udf(T.DoubleType())
def calculate(expression: pa.Array) -> pa.Array:
    return pa.array([None if e is None else evaluate(e) for e in expression.to_pylist()], pa.float64())


@query(f"WITH {SUMS.cte} SELECT id, CASE which WHEN 1 THEN k + 3 * 4 WHEN 2 THEN (7 - k) ** 2 / 5 WHEN 3 THEN 10 % 4 + 7 // k WHEN 4 THEN k + 1 WHEN 7 THEN sqrt(16) + abs(-k) END::DOUBLE AS value FROM sums")
def arithmetic(spark, sf):
    """Arithmetic in messages; the search for it begins at a digit or a bracket, so a sign in front is left out."""
    return SUMS.df(spark, sf).select("id", calculate(col("expression")).alias("value"))


PARTS = Rows("parts", "id int, body string", ((1, "a b\nc"), (2, " padded "), (3, ""))).over("conversations", "t.conv_id * 31 + t.turn", doc="t.conv_id", id="t.turn", body="CASE WHEN p.body = '' THEN p.body ELSE p.body || t.text || ' ' END")


@query(f"WITH {PARTS.cte} SELECT doc, count(*) AS n, sha256(string_agg(regexp_replace(body, '^[ \\t\\n]+|[ \\t\\n]+$', '', 'g'), '|' ORDER BY id)) AS text FROM parts WHERE body <> '' GROUP BY doc")
def section_text(spark, sf):
    """A document's sections as one text; a conversation's turns stand for them."""
    p = PARTS.df(spark, sf).where("body <> ''").groupBy("doc").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("id", strip(col("body")).alias("b")))).alias("l"))
    return p.select("doc", "n", F.sha2(F.array_join(F.transform("l", lambda x: x["b"]), "|"), 256).alias("text"))
