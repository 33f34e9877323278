"""The opN queries: each applies its operator to a whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import licenses
from millrace.llm.filter_audit import audit_filters, failures, labelled
from millrace.llm.hard_negatives import mine_negatives
from millrace.llm.langid import fit_language, predict_language
from millrace.llm.lattice import score_documents
from millrace.llm.line_dedup import line_dedup
from millrace.llm.mixing import mix, token_count
from millrace.llm.packing import pack_documents
from millrace.llm.quality import judge
from millrace.llm.secrets import scan_secrets
from millrace.llm.simhash import simhash_groups
from millrace.llm.toxicity import fit_grammar, score_toxicity
from millrace.llm.vectors import vector_groups
from millrace.runtime import table


def held_out(m: int, k: int) -> Column:
    """Whether crc32(doc_id as text) mod m is k; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % m == k, F.lit(False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_grammar(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = """
WITH lines AS (
  SELECT doc_id, pos, parts[pos] AS line,
         translate(trim(parts[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts,
               unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos
        FROM documents)),
firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM lines WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) > 1)
SELECT l.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE l.doc_id > f.first_doc) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos)
              FILTER (WHERE f.first_doc IS NULL OR l.doc_id = f.first_doc), '')) AS kept_sha256
FROM lines l LEFT JOIN firsts f ON l.key = f.key GROUP BY l.doc_id
"""


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Where the public tokenizers lie is a parameter of the operators; the queries take it from the installed package.
def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", kind("assign"), kind("access"), kind("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), kind("entropy"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    length = (F.octet_length("ids") / 4).cast("long").alias("length")
    return pieces.select("doc_id", "start", length, F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fifths of all tokens by target weights; (doc_id, epoch, n_tokens) of every selected row."""
    weights = {
        "domain": F.when(F.col("domain") == "d0", 2).otherwise(3),
        "lang": F.when(F.col("lang") == "en", 5).when(F.col("lang") == "de", 3).otherwise(2),
        "source": F.lit(1),
    }
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", token_count(F.col("text")).alias("n_tokens"))
    mixed = mix(docs, weights, F.expr("total * 3 div 5"), tokens=F.col("n_tokens"))
    return mixed.select("doc_id", "lang", "source", "epoch", "n_tokens")


def _deal_sql(parent: str, child: str, keys: str, on: str) -> str:
    """One level of the tree: the same integer water level."""
    return f"""
{child}_level AS (
  SELECT n.*, p.budget,
         coalesce(sum(n.cap) OVER (PARTITION BY {keys} ORDER BY n.cap::DOUBLE / n.weight, n.{child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lighter,
         sum(n.weight) OVER (PARTITION BY {keys} ORDER BY n.cap::DOUBLE / n.weight, n.{child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavier
  FROM {child}_nodes n JOIN {parent} p ON {on}),
{child}_full AS (SELECT n.*, cap::HUGEINT * heavier <= weight::HUGEINT * (budget - lighter) AS whole FROM {child}_level n),
{child}_budget AS (
  SELECT n.* EXCLUDE (budget), CASE WHEN whole THEN cap ELSE (weight::HUGEINT * (budget - coalesce(sum(CASE WHEN whole THEN cap END) OVER (PARTITION BY {keys}), 0))
         // coalesce(sum(CASE WHEN NOT whole THEN weight END) OVER (PARTITION BY {keys}), 1))::BIGINT END AS budget
  FROM {child}_full n)"""


OP6_SQL = f"""
WITH rows AS (
  SELECT doc_id, lang, source, coalesce(lang, 'none') AS l, coalesce(source, 'none') AS s,
         'd' || coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 4, 0) AS d,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT d, l, s, sum(n_tokens)::BIGINT AS tokens FROM rows GROUP BY d, l, s),
top AS (SELECT least(sum(tokens) * 3 // 5, sum(tokens) * 4)::BIGINT AS budget FROM leaves),
d_nodes AS (SELECT d, sum(tokens * 4)::BIGINT AS cap, CASE d WHEN 'd0' THEN 2 ELSE 3 END AS weight FROM leaves GROUP BY d),
l_nodes AS (SELECT d, l, sum(tokens * 4)::BIGINT AS cap, CASE l WHEN 'en' THEN 5 WHEN 'de' THEN 3 ELSE 2 END AS weight FROM leaves GROUP BY d, l),
s_nodes AS (SELECT d, l, s, sum(tokens * 4)::BIGINT AS cap, 1 AS weight FROM leaves GROUP BY d, l, s),
{_deal_sql("top", "d", "1", "true")},
{_deal_sql("d_budget", "l", "n.d", "n.d = p.d")},
{_deal_sql("l_budget", "s", "n.d, n.l", "n.d = p.d AND n.l = p.l")},
plan AS (
  SELECT s.d, s.l, s.s, CASE WHEN v.tokens > 0 THEN s.budget // v.tokens ELSE 1 END AS whole,
         CASE WHEN v.tokens > 0 THEN s.budget % v.tokens ELSE 0 END AS rest
  FROM s_budget s JOIN leaves v ON s.d = v.d AND s.l = v.l AND s.s = v.s),
placed AS (
  SELECT r.*, p.whole, p.rest,
         sum(n_tokens) OVER (PARTITION BY r.d, r.l, r.s ORDER BY md5('42|' || (p.whole + 1) || '|' || coalesce(doc_id::VARCHAR, 'none')) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM rows r JOIN plan p ON r.d = p.d AND r.l = p.l AND r.s = p.s)
SELECT doc_id, lang, source, unnest(range(1, (whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END + 1)::BIGINT))::INTEGER AS epoch, n_tokens FROM placed
"""


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 9).alias("posterior"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    said = predict_language(docs, fit_language(docs))
    return said.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op9_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return scored.withColumn("held_out", F.coalesce("held_out", F.lit(False)))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_groups(table(spark, sf_dir, "embeddings"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of `license_spans`: base columns are of its phrases, labels and score of all spans."""
    found = licenses.license_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["phrase"])
    listed = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"])
    score = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"), listed(F.col("spans")).alias("labels"), score,
    )


def _op11_sql() -> str:
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    split = f"regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    listed = ", ".join(f"({i}, '{t.label}', {t.phrase}, {t.slack}, {t.least}, {t.k}, '{t.text}')" for i, t in enumerate(licenses.TEMPLATES))
    return f"""
WITH templates AS (SELECT *, {split.format("body")} AS w FROM (VALUES {listed}) t(template, label, phrase, slack, least, k, body)),
docs AS (SELECT row_number() OVER () AS doc, doc_id, {split.format("coalesce(text, '')")} AS w FROM documents),
sizes AS (SELECT DISTINCT k FROM templates),
grams AS (SELECT doc, k, pos, array_to_string(w[pos + 1:pos + k], ' ') AS gram FROM (SELECT doc, k, w, unnest(range(0, len(w) - k + 1)) AS pos FROM docs, sizes)),
places AS (SELECT template, k, place, array_to_string(w[place + 1:place + k], ' ') AS gram FROM (SELECT template, k, w, unnest(range(0, len(w) - k + 1)) AS place FROM templates)),
hits AS (SELECT doc, template, pos, place, pos - place AS diagonal FROM grams JOIN places USING (k, gram)),
apart AS (SELECT h.*, dense_rank() OVER d AS nth FROM hits h WINDOW d AS (PARTITION BY doc, template ORDER BY diagonal)),
jumps AS (SELECT doc, template, diagonal, CASE WHEN diagonal - lag(diagonal) OVER d > t.slack THEN 1 ELSE 0 END AS jump
  FROM (SELECT DISTINCT doc, template, diagonal FROM hits) JOIN templates t USING (template) WINDOW d AS (PARTITION BY doc, template ORDER BY diagonal)),
joined AS (SELECT doc, template, diagonal, sum(jump) OVER (PARTITION BY doc, template ORDER BY diagonal) AS grp FROM jumps),
spans AS (
  SELECT h.doc, t.label, t.phrase, min(h.pos) AS start, count(DISTINCT h.place) / (len(t.w) - t.k + 1) AS score
  FROM hits h JOIN joined j USING (doc, template, diagonal) JOIN templates t ON h.template = t.template
  GROUP BY h.doc, t.template, t.label, t.phrase, t.slack, t.least, t.k, t.w, j.grp
  HAVING count(DISTINCT h.place) >= t.least * (len(t.w) - t.k + 1) AND max(h.pos) + t.k - min(h.pos) <= len(t.w) + 2 * t.slack)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, count(*) FILTER (WHERE s.phrase) AS n_base,
  min(s.start) FILTER (WHERE s.phrase) AS first_word, max(s.start) FILTER (WHERE s.phrase) AS last_word,
  coalesce(string_agg(DISTINCT s.label, ',' ORDER BY s.label) FILTER (WHERE s.phrase), '') AS base_labels,
  coalesce(string_agg(DISTINCT s.label, ',' ORDER BY s.label), '') AS labels, coalesce(max(s.score), 0.0)::DOUBLE AS score
FROM docs d LEFT JOIN spans s USING (doc) GROUP BY d.doc, d.doc_id, d.w
"""


def op12_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(labelled(failures(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


OP12_SQL = """
WITH f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step]) - bits[step] AS earlier, filter_order[step] AS filter
  FROM (SELECT *, unnest(range(1, 6)) AS step FROM orders)),
texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
masks AS (
  SELECT part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) THEN 16 ELSE 0 END AS mask,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic
  FROM texts),
counts AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM masks GROUP BY part, mask),
cells AS (
  SELECT part, filter_order, step, filter,
    sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM cells
"""


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER best)::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scores s USING (anchor_id) WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER best <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op6_mixing": OP6_SQL, "op11_licenses": _op11_sql(), "op12_filters": OP12_SQL, "op13_negatives": OP13_SQL}
