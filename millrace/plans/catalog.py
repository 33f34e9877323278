"""The named queries over the driver's tables, each with the SQL that should give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions import vectors as V
from millrace.operators import audit, corpus, graph, inverted, memory, retrieval, similarity, vector_index
from millrace.runtime import materialize, table
from millrace.sources import files
from millrace.streaming import events as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NOW = 1_800_000_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# SQL fragments shared by several equivalents.
WS = r"[ \t\n\r\f\x0B]+"
SQUEEZE = f"trim(regexp_replace(text, '{WS}', ' ', 'g'))"
N_WORDS = f"(CASE WHEN {SQUEEZE} = '' THEN 0 ELSE len(string_split({SQUEEZE}, ' ')) END)"
CLEAN = r"""trim(regexp_replace(regexp_replace(translate(regexp_replace(regexp_replace(T, '<[^>]+>', ' ', 'g'), 'https?://[^ \t\n\r\f\x0B]+|www\.[^ \t\n\r\f\x0B]+', ' ', 'g'),
  chr(160) || chr(65279) || '“”’–—', '  ""''--'), '[^\x09\x0A\x0D\x20-\x7E\x{A0}-\x{24F}]', ' ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g'))"""
RANK = "sha256('42:' || doc_id::VARCHAR)"
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "card": r"(?:[0-9][ -]?){13,16}",
    "secret": r"(?i)(?:api[_-]?key|secret|password|token|passwd)[ \t]*[=:][ \t]*[^ \t\n\r]+",
    "sk": r"sk-[A-Za-z0-9]{20,}",
    "gh": r"ghp_[A-Za-z0-9]{36}",
}
HAS_PII = "(" + " OR ".join(f"regexp_matches(text, '{p}')" for p in PII.values()) + ")"
ENTROPY = """CASE WHEN length(text) = 0 THEN 0.0 ELSE coalesce((SELECT -sum((c::DOUBLE / length(text)) * log2(c::DOUBLE / length(text)))
  FROM (SELECT count(*) AS c FROM (SELECT unnest(string_split(text, '')) AS ch) GROUP BY ch)), 0.0) END"""
METRICS = rf"""
m AS (SELECT doc_id, lang, length(text) AS chars, length(text) - length(regexp_replace(text, '\p{{L}}', '', 'g')) AS alpha,
  length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS digits,
  length(text) - length(regexp_replace(text, '[^\x09\x0A\x0D\x20-\x7E\x{{A0}}-\x{{24F}}]', '', 'g')) AS odd,
  len(regexp_extract_all(text, '[|/_\\]{{3,}}|[Il1]{{5,}}|[0O]{{5,}}')) AS ocr, {N_WORDS} AS n_words, e.entropy,
  list_filter(string_split_regex(text, '\r\n|[\n\r\x0B\f\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]'), lambda s: regexp_matches(s, '[^ \t\n\r\f\x0B]')) AS lines, text
  FROM documents LEFT JOIN (SELECT id, -sum((c::DOUBLE / n) * log2(c::DOUBLE / n)) AS entropy FROM (
    SELECT doc_id AS id, ch, count(*) AS c, sum(count(*)) OVER (PARTITION BY doc_id) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY doc_id, ch) GROUP BY id) e ON doc_id = e.id),
r AS (SELECT *, alpha::DOUBLE / chars AS alpha_ratio, digits::DOUBLE / chars AS digit_ratio, odd::DOUBLE / chars AS nonprintable_ratio, ocr::DOUBLE / greatest(n_words, 1) AS ocr_noise_ratio,
  len(list_filter(lines, lambda s: len(list_filter(lines, lambda u: u = s)) > 1))::DOUBLE / greatest(len(lines), 1) AS repeated_line_ratio FROM m),
q AS (SELECT *, (least(1.0, alpha_ratio * 1.4) + least(1.0, greatest(0.0, entropy / 5.0)) + (1 - least(1.0, nonprintable_ratio * 20)) + (1 - least(1.0, repeated_line_ratio * 2)) + (1 - least(1.0, ocr_noise_ratio * 4))) / 5.0 AS quality_score FROM r)"""


def sql_round(name: str, digits: int) -> Column:
    """A number rounded as DuckDB rounds it, by its product with a power of ten; Spark rounds the decimals that are printed, another value at some ties. A zero keeps its sign."""
    x = F.col(name)
    return F.when(x == 0, x).otherwise(F.round(x * 10.0**digits) / 10.0**digits).alias(name)


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


# --- cleaning and canonical rows ---


@query(f"SELECT doc_id, sha256({CLEAN.replace('T,', 'text,', 1)}) AS cleaned, length({CLEAN.replace('T,', 'text,', 1)}) AS n FROM documents")
def clean_text(spark, sf):
    t = X.clean_text(F.col("text"))
    return docs(spark, sf).select("doc_id", F.sha2(t, 256).alias("cleaned"), F.length(t).cast("long").alias("n"))


@query(f"SELECT page_id, {CLEAN.replace('T,', 'html,', 1)} AS body FROM pages")
def clean_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.clean_text(F.col("html")).alias("body"))


@query(rf"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10)),
  '<[^>]+>', ' ', 'g'), '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), 'https?://[^ \t\n\r]+', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g')) AS body
  FROM (SELECT page_id, html FROM pages)""".replace("trim(regexp_replace(regexp_replace(", "trim(regexp_replace(regexp_replace(regexp_replace(", 1).replace(", '[ \\t]{2,}', ' ', 'g'))", ", '[ \\t]{2,}', ' ', 'g'), '[ \\t]+(\\n|$)', '\\1', 'g'))", 1))
def clean_markup(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.clean_lines(F.col("html"), redact=False).alias("body"))


@query(f"SELECT doc_id, 'doc/' || doc_id || '.txt' AS relative_path, sha256('doc/' || doc_id || '.txt' || chr(10) || text) AS id, sha256(text) AS checksum, length(text) AS chars, {N_WORDS} AS tokens FROM documents")
def canonical_doc(spark, sf):
    return corpus.canonical(docs(spark, sf))


@query("SELECT doc_id, (unnest(range(len(string_split(text, chr(10))))))::INTEGER AS para_idx, trim(unnest(string_split(text, chr(10)))) AS paragraph FROM documents QUALIFY paragraph <> ''".replace(" QUALIFY paragraph <> ''", "").join(("SELECT * FROM (", ") WHERE paragraph <> ''")))
def paragraph_split(spark, sf):
    return files.paragraphs(docs(spark, sf).select("doc_id", "text"), separator="\n")


# --- dedup ---


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY sha256(text))")
def dedup_exact(spark, sf):
    return corpus.keep_first(docs(spark, sf), F.sha2("text", 256)).select("doc_id", "lang", "source")


@query(f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY lower({SQUEEZE})")
def dedup_normalised(spark, sf):
    return docs(spark, sf).groupBy(F.lower(X.squeeze(F.col("text"))).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("k")


@query("""SELECT source, count(*) AS total, count(*) FILTER (WHERE kept) AS kept, round(100.0 * count(*) FILTER (WHERE kept) / count(*), 4) AS retention
  FROM (SELECT source, doc_id = min(doc_id) OVER (PARTITION BY text) AS kept FROM documents) GROUP BY ROLLUP (source)""")
def dup_report(spark, sf):
    d = docs(spark, sf).select("doc_id", "source", F.sha2("text", 256).alias("h"))
    firsts = d.groupBy("h").agg(F.min("doc_id").alias("first"))
    kept = d.join(firsts, "h").withColumn("kept", F.col("doc_id") == F.col("first"))
    return kept.rollup("source").agg(F.count("*").alias("total"), F.count_if("kept").alias("kept"), F.round(100.0 * F.count_if("kept") / F.count("*"), 4).alias("retention"))


SIMHASH_SQL = """
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t FROM documents),
h AS (SELECT doc_id, t, count(*) AS c, ('0x' || substr(md5(t), 17, 16))::UBIGINT AS v FROM tok GROUP BY doc_id, t),
votes AS (SELECT doc_id, b, sum(CASE WHEN (v >> b) & 1 = 1 THEN c ELSE -c END) AS s FROM h, (SELECT unnest(range(64))::UTINYINT AS b) GROUP BY doc_id, b),
fp AS (SELECT doc_id, sum(CASE WHEN s >= 0 THEN (1::UBIGINT << b)::HUGEINT ELSE 0 END)::UBIGINT AS u FROM votes GROUP BY doc_id)"""


def _prints(spark, sf):
    return docs(spark, sf).select("doc_id", similarity.simhash(X.tokens(F.col("text"))).alias("fp"))


@query(f"WITH {SIMHASH_SQL} SELECT d.doc_id, lpad(lower(to_hex(coalesce(u, 0))), 16, '0') AS fp FROM documents d LEFT JOIN fp ON d.doc_id = fp.doc_id")
def simhash(spark, sf):
    return _prints(spark, sf).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fp"))


@query(f"""WITH {SIMHASH_SQL}, u AS (SELECT DISTINCT u FROM fp)
  SELECT lpad(lower(to_hex(least(a.u, b.u))), 16, '0') AS low, lpad(lower(to_hex(greatest(a.u, b.u))), 16, '0') AS high, bit_count(xor(a.u, b.u))::INTEGER AS distance
  FROM u a JOIN u b ON a.u < b.u WHERE bit_count(xor(a.u, b.u)) <= 3""")
def simhash_near_pairs(spark, sf):
    pairs = similarity.hamming_pairs(materialize(_prints(spark, sf), "simhash").where("fp <> 0"))
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return pairs.select(F.least(text("fp_a"), text("fp_b")).alias("low"), F.greatest(text("fp_a"), text("fp_b")).alias("high"), "distance")


GRAMS_SQL = """
t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END)) AS s FROM t WHERE len(w) > 0),
c AS (SELECT min(doc_id) AS a, s FROM g GROUP BY s)"""


@query(f"""WITH {GRAMS_SQL}, u AS (SELECT a, len(s) AS n, unnest(s) AS x FROM c),
  p AS (SELECT l.a, r.a AS b, l.n, r.n AS m, count(*) AS k FROM u l JOIN u r ON l.x = r.x AND l.a < r.a GROUP BY l.a, r.a, l.n, r.n)
  SELECT a, b, round(k::DOUBLE / (n + m - k), 6) AS jaccard FROM p WHERE k::DOUBLE / (n + m - k) >= 0.8""")
def shingle_jaccard_pairs(spark, sf):
    return similarity.shingle_pairs(docs(spark, sf).select("doc_id", "text")).withColumn("jaccard", F.round("jaccard", 6))


@query()
def near_dedup_keep(spark, sf):
    """A row for each document with the kept one that stands for it; 0.9 and 3 bits as in the reference's settings."""
    return similarity.near_classes(docs(spark, sf).select("doc_id", "text"), materialize)


# --- quality, language, classes ---


@query(f"WITH {METRICS} SELECT doc_id, chars, round(alpha_ratio, 6) AS alpha_ratio, round(digit_ratio, 6) AS digit_ratio, round(nonprintable_ratio, 6) AS nonprintable_ratio, round(repeated_line_ratio, 6) AS repeated_line_ratio, round(ocr_noise_ratio, 6) AS ocr_noise_ratio, round(entropy, 6) AS entropy, round(quality_score, 6) AS quality_score FROM q")
def quality_metrics(spark, sf):
    m = corpus.quality_metrics(docs(spark, sf))
    return m.select("doc_id", "chars", *[sql_round(c, 6) for c in ("alpha_ratio", "digit_ratio", "nonprintable_ratio", "repeated_line_ratio", "ocr_noise_ratio", "entropy", "quality_score")])


@query(f"WITH {METRICS} SELECT lang, count(*) AS docs, count(*) FILTER (WHERE chars >= 32 AND quality_score >= 0.35 AND ocr_noise_ratio <= 0.25) AS passed, round(avg(quality_score), 6) AS mean FROM q GROUP BY lang")
def quality_filter(spark, sf):
    m = corpus.quality_metrics(docs(spark, sf))
    return m.groupBy("lang").agg(F.count("*").alias("docs"), F.count_if(corpus.passes_quality()).alias("passed"), F.round(F.avg("quality_score"), 6).alias("mean"))


TOP3 = """(SELECT coalesce(sum(c), 0) FROM (SELECT count(*) AS c FROM (SELECT unnest(w) AS x) GROUP BY x ORDER BY c DESC LIMIT 3))"""
WORDS_SQL = f"w AS (SELECT doc_id, source, text, CASE WHEN {SQUEEZE} = '' THEN [] ELSE string_split({SQUEEZE.replace('text', 'lower(text)')}, ' ') END AS w FROM documents), top AS (SELECT doc_id AS id, sum(c) AS t3 FROM (SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC) AS rn FROM (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(w) AS x FROM w) GROUP BY doc_id, x)) WHERE rn <= 3 GROUP BY doc_id)"
PRINTABLE = r"(1 - (length(text) - length(regexp_replace(text, '[\p{C}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]', '', 'g')) - (length(text) - length(replace(replace(text, chr(10), ''), chr(9), ''))))::DOUBLE / length(text))"


@query(f"WITH {WORDS_SQL} SELECT w.doc_id, coalesce(len(w) >= 8 AND len(list_distinct(w))::DOUBLE / len(w) >= 0.3 AND t3::DOUBLE / len(w) <= 0.4 AND {PRINTABLE} >= 0.85 AND length(array_to_string(w, ''))::DOUBLE / len(w) BETWEEN 3 AND 20, false) AS ok FROM w LEFT JOIN top ON w.doc_id = top.id")
def quality_ok(spark, sf):
    return docs(spark, sf).select("doc_id", F.coalesce(corpus.quality_ok(F.col("text")), F.lit(False)).alias("ok"))


SCORES_SQL = rf"""{WORDS_SQL}, s AS (SELECT doc_id, source, len(w) AS n, w, text, coalesce(t3, 0) AS t3, len(list_filter(string_split_regex(text, '[.!?]+'), lambda x: regexp_matches(x, '[^ \t\n\r\f\x0B]'))) AS sents FROM w LEFT JOIN top ON w.doc_id = top.id),
sub AS (SELECT doc_id, source, CASE WHEN n < 8 THEN 0.0 WHEN n < 20 THEN 0.5 WHEN n <= 500 THEN 1.0 ELSE greatest(0.5, 1.0 - (n - 500)::DOUBLE / 2000) END AS word_count,
  CASE WHEN n = 0 THEN 0.0 ELSE least(1.0, len(list_distinct(w))::DOUBLE / n / 0.5) END AS lexical_richness,
  CASE WHEN sents = 0 THEN 0.0 WHEN n::DOUBLE / sents BETWEEN 10 AND 30 THEN 1.0 WHEN n::DOUBLE / sents < 5 THEN 0.3 WHEN n::DOUBLE / sents > 60 THEN 0.4 ELSE 0.7 END AS sentence_variety,
  CASE WHEN length(text) = 0 THEN 0.0 ELSE {PRINTABLE} END AS printable_ratio, CASE WHEN {HAS_PII} THEN 0.0 ELSE 1.0 END AS pii_clean,
  CASE WHEN n < 3 THEN 0.0 ELSE greatest(0.0, 1.0 - t3::DOUBLE / n / 0.4) END AS non_repetitive FROM s),
scored AS (SELECT *, word_count * 0.2::DOUBLE + lexical_richness * 0.2::DOUBLE + sentence_variety * 0.15::DOUBLE + printable_ratio * 0.15::DOUBLE + pii_clean * 0.15::DOUBLE + non_repetitive * 0.15::DOUBLE AS quality FROM sub)"""


@query(f"WITH {SCORES_SQL} SELECT doc_id, round(word_count, 4) AS word_count, round(lexical_richness, 4) AS lexical_richness, sentence_variety::DOUBLE AS sentence_variety, round(non_repetitive, 4) AS non_repetitive, pii_clean::DOUBLE AS pii_clean, round(quality, 4) AS quality FROM scored")
def score_quality(spark, sf):
    s = corpus.paragraph_scores(docs(spark, sf))
    four = lambda c: F.round(c, 4).alias(c)
    return s.select("doc_id", four("word_count"), four("lexical_richness"), "sentence_variety", four("non_repetitive"), "pii_clean", "quality")


@query(f"""WITH {SCORES_SQL}, risk AS (SELECT 'src' || (s_suppkey - 1) AS source, round((s_suppkey % 10) / 12.0, 4)::DOUBLE AS risk FROM supplier)
  SELECT d, count(*) AS n FROM (SELECT CASE WHEN round(quality, 4) < 0.45 OR coalesce(risk, 0.8) > 0.5 THEN 'auto_reject' WHEN round(quality, 4) >= 0.7 AND coalesce(risk, 0.8) <= 0.2 THEN 'auto_approve' ELSE 'human_review' END AS d FROM scored LEFT JOIN risk USING (source)) GROUP BY d""")
def score_decision(spark, sf):
    """Decisions by quality and a registry's licence risk (0.8 for unknown sources); suppliers stand in for the registry."""
    risk = table(spark, sf, "supplier").select(F.concat(F.lit("src"), (F.col("s_suppkey") - 1).cast("string")).alias("source"), F.round((F.col("s_suppkey") % 10) / 12.0, 4).alias("risk"))
    s = corpus.paragraph_scores(docs(spark, sf)).join(risk, "source", "left")  # Catalyst broadcasts a registry under its own size limit
    return s.groupBy(corpus.decision(F.col("quality"), F.coalesce("risk", F.lit(0.8))).alias("d")).agg(F.count("*").alias("n"))


STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)


@query(f"""WITH w AS (SELECT doc_id, lang, list_transform(regexp_extract_all(text, '[A-Za-z'']+'), lambda x: lower(x)) AS w FROM documents),
  c AS (SELECT doc_id, lang, CASE WHEN len(w) = 0 THEN 0.0 ELSE least(1.0, 0.5 + 0.5 * least(1.0, len(list_filter(w, lambda x: x IN ({STOP}))) / 10.0)) END::DOUBLE AS conf FROM w)
  SELECT doc_id, CASE WHEN conf >= 0.55 THEN 'en' ELSE 'unknown' END AS language, round(conf, 4) AS confidence, conf > 0.15 AND conf < 0.55 AS mixed FROM c""")
def detect_language_stopword(spark, sf):
    return docs(spark, sf).select("doc_id", X.language_en(F.col("text")).alias("l")).select("doc_id", "l.*")


def _signal(lang: str) -> str:
    return f"len(regexp_extract_all(h, ' (?:{X.LANGUAGE_SIGNALS[lang]}) '))"


FOUR = ", ".join(f"{_signal(k)} AS {k}" for k in X.LANGUAGE_SIGNALS)
FOUR_SQL = rf"h AS (SELECT doc_id, lang, ' ' || regexp_replace(lower(substr(text, 1, 500)), '[^a-z0-9_\x{{E0}}-\x{{FF}}]+', '  ', 'g') || ' ' AS h FROM documents), c AS (SELECT doc_id, lang, {FOUR} FROM h), p AS (SELECT doc_id, lang, CASE WHEN greatest(en, es, fr, de) = 0 OR en = greatest(en, es, fr, de) THEN 'en' WHEN es = greatest(en, es, fr, de) THEN 'es' WHEN fr = greatest(en, es, fr, de) THEN 'fr' ELSE 'de' END AS predicted FROM c)"


@query(f"WITH {FOUR_SQL} SELECT doc_id, predicted FROM p")
def detect_language_4way(spark, sf):
    return docs(spark, sf).select("doc_id", X.language_of_four(F.col("text")).alias("predicted"))


@query(f"WITH {FOUR_SQL} SELECT lang, predicted, count(*) AS n FROM p GROUP BY lang, predicted")
def language_confusion(spark, sf):
    return docs(spark, sf).groupBy("lang", X.language_of_four(F.col("text")).alias("predicted")).agg(F.count("*").alias("n"))


def _labels_sql() -> str:
    hits = ", ".join("{'h': -(" + " + ".join(f"contains(low, '{k}')::INT" for k in kw) + f"), 'l': '{name}'}}" for name, kw in X.CATEGORIES.items())
    hard = " OR ".join(f"contains(low, '{k}')" for k in X.ADVANCED)
    return f"""low AS (SELECT doc_id, lang, text, lower(text) AS low FROM documents), ranked AS (SELECT doc_id, lang, text, low, list_sort(list_filter([{hits}], lambda s: s.h < 0))[1:3] AS r FROM low),
      classes AS (SELECT doc_id, lang, CASE WHEN len(r) = 0 THEN ['Technical'] ELSE list_transform(r, lambda s: s.l) END AS labels, CASE WHEN {N_WORDS} < 120 THEN 'basic' WHEN {hard} THEN 'advanced' ELSE 'intermediate' END AS difficulty FROM ranked)"""


@query(f"WITH {_labels_sql()} SELECT doc_id, array_to_string(labels, ',') AS labels, labels[1] AS primary_label, difficulty FROM classes")
def classify_labels(spark, sf):
    c = docs(spark, sf).select("doc_id", X.class_labels(F.col("text")).alias("l"), X.difficulty(F.col("text")).alias("difficulty"))
    return c.select("doc_id", F.array_join("l", ",").alias("labels"), F.col("l")[0].alias("primary_label"), "difficulty")


@query(f"WITH {_labels_sql()} SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM classes) GROUP BY label")
def classify_counts(spark, sf):
    return docs(spark, sf).select(F.explode(X.class_labels(F.col("text"))).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT doc_id, " + ", ".join(f"regexp_matches(text, '{p}') AS has_{k}" for k, p in (PII | {"phone": X.PHONE}).items()) + f", {HAS_PII} OR regexp_matches(text, '{X.PHONE}') AS any FROM documents")
def pii_flags(spark, sf):
    pats = {"email": X.EMAIL, "ssn": X.SSN, "card": X.CARD, "secret": X.SECRET, "sk": X.SK_KEY, "gh": X.GH_KEY}
    return docs(spark, sf).select("doc_id", *[F.col("text").rlike(p).alias(f"has_{k}") for k, p in (pats | {"phone": X.PHONE}).items()], X.has_pii(F.col("text"), True).alias("any"))


REDACT = "text"
for _p in (PII["email"], PII["ssn"], PII["card"]):
    REDACT = f"regexp_replace({REDACT}, '{_p}', '[REDACTED]', 'g')"
SECRETS = rf"regexp_replace(regexp_replace({{0}}, '((?i:api[_-]?key|secret|password|token|passwd)[ \t]*)=[ \t]*[^ \t\n\r]+', '\1=[REDACTED]', 'g'), '(?i:api[_-]?key|secret|password|token|passwd)[ \t]*:[ \t]*[^ \t\n\r]+', '[REDACTED]', 'g')"
SECRETS = f"regexp_replace(regexp_replace({SECRETS}, '{PII['sk']}', '[REDACTED]', 'g'), '{PII['gh']}', '[REDACTED]', 'g')"


@query(f"SELECT doc_id, sha256({REDACT}) AS redacted, length({REDACT}) AS n FROM documents")
def pii_redact(spark, sf):
    t = X.redact_pii(F.col("text"))
    return docs(spark, sf).select("doc_id", F.sha2(t, 256).alias("redacted"), F.length(t).cast("long").alias("n"))


@query(f"SELECT doc_id, sha256({SECRETS.replace('{0}', 'text')}) AS redacted FROM documents")
def secret_redact(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2(X.redact_secrets(F.col("text")), 256).alias("redacted"))


# --- metadata, balance, splits, statistics ---


@query(f"SELECT d.doc_id, coalesce(l.quality, -1)::INTEGER AS quality, coalesce(l.toxic, -1)::INTEGER AS toxic, coalesce(d.lang, 'unknown') AS language, {N_WORDS.replace('text', 'd.text')} AS tokens FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def metadata_join(spark, sf):
    d, lab = docs(spark, sf), table(spark, sf, "labels")
    return d.join(lab, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).cast("int").alias("quality"), F.coalesce("toxic", F.lit(-1)).cast("int").alias("toxic"), F.coalesce("lang", F.lit("unknown")).alias("language"), X.approx_tokens(F.col("text")).alias("tokens"))


@query(f"""WITH b AS (SELECT doc_id, lang, CASE WHEN {N_WORDS} < 120 THEN 'basic' ELSE 'long' END AS size FROM documents),
  r AS (SELECT *, row_number() OVER (PARTITION BY lang, size ORDER BY {RANK})::INTEGER AS bucket_rank FROM b), t AS (SELECT greatest(1, floor(greatest(1, min(c) * 1.5))) AS take FROM (SELECT count(*) AS c FROM b GROUP BY lang, size))
  SELECT doc_id, lang, size, bucket_rank FROM r, t WHERE bucket_rank <= take""")
def balance_buckets(spark, sf):
    d = docs(spark, sf).select("doc_id", "lang", F.when(X.approx_tokens(F.col("text")) < 120, "basic").otherwise("long").alias("size"))
    return corpus.balance(d, ["lang", "size"])


@query(f"SELECT doc_id, CASE WHEN rn < floor(n * 0.02) THEN 'val' WHEN rn < 2 * floor(n * 0.02) THEN 'test' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY {RANK}) - 1 AS rn, count(*) OVER () AS n FROM documents)")
def splits(spark, sf):
    return corpus.split_rows(docs(spark, sf).select("doc_id"))


@query(f"""SELECT lang, count(*) AS docs, sum({N_WORDS})::BIGINT AS tokens, sum(length(text))::BIGINT AS chars, min({N_WORDS}) AS least, max({N_WORDS}) AS most, round(avg({N_WORDS}), 6) AS mean, round(100.0 * (count(*) - count(DISTINCT text)) / count(*), 4) AS duplicate_pct
  FROM documents GROUP BY GROUPING SETS ((lang), ())""")
def corpus_statistics(spark, sf):
    d = docs(spark, sf).select("lang", X.approx_tokens(F.col("text")).alias("t"), F.length("text").cast("long").alias("c"), F.sha2("text", 256).alias("h"))
    return d.rollup("lang").agg(F.count("*").alias("docs"), F.sum("t").alias("tokens"), F.sum("c").alias("chars"), F.min("t").alias("least"), F.max("t").alias("most"), F.round(F.avg("t"), 6).alias("mean"), F.round(100.0 * (F.count("*") - F.count_distinct("h")) / F.count("*"), 4).alias("duplicate_pct"))


@query("SELECT count(DISTINCT t) AS vocabulary, count(*) AS tokens FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t FROM documents)")
def vocabulary(spark, sf):
    t = docs(spark, sf).select(F.explode(X.tokens(F.col("text"))).alias("t"))
    return t.groupBy("t").agg(F.count("*").alias("c")).agg(F.count("*").alias("vocabulary"), F.sum("c").alias("tokens"))


@query(f"WITH v AS (SELECT {N_WORDS} AS v FROM documents), s AS (SELECT list_sort(list(v)) AS s, count(*) AS n FROM v) SELECT s[floor((n - 1) * 0.5)::BIGINT + 1] AS p50, s[floor((n - 1) * 0.9)::BIGINT + 1] AS p90, s[floor((n - 1) * 0.99)::BIGINT + 1] AS p99 FROM s")
def token_percentiles(spark, sf):
    return corpus.nearest_rank(docs(spark, sf).select(X.approx_tokens(F.col("text")).alias("t")), "t", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


@query(f"""WITH RECURSIVE o AS (SELECT doc_id, {N_WORDS} AS n, row_number() OVER (ORDER BY {RANK}) AS i FROM documents),
  f AS (SELECT i, doc_id, 0::BIGINT AS chunk_index, n AS held, 1 AS c FROM o WHERE i = 1 UNION ALL
    SELECT o.i, o.doc_id, f.chunk_index + CASE WHEN f.held + o.n > 20000 OR f.c >= 100 THEN 1 ELSE 0 END, CASE WHEN f.held + o.n > 20000 OR f.c >= 100 THEN o.n ELSE f.held + o.n END, CASE WHEN f.held + o.n > 20000 OR f.c >= 100 THEN 1 ELSE f.c + 1 END FROM f JOIN o ON o.i = f.i + 1)
  SELECT doc_id, chunk_index FROM f""")
def tokenizer_chunks(spark, sf):
    return corpus.chunk_fill(docs(spark, sf), target=20_000, most=100)


@query(f"SELECT doc_id, est_tokens, running_tokens FROM (SELECT doc_id, floor(length(text) / 3.8)::BIGINT AS est_tokens, sum(floor(length(text) / 3.8)::BIGINT) OVER (ORDER BY {RANK})::BIGINT AS running_tokens FROM documents) WHERE running_tokens <= 100000")
def release_budget(spark, sf):
    return corpus.budget_prefix(docs(spark, sf).select("doc_id", "text"), 100_000).select("doc_id", "est_tokens", "running_tokens")


@query(f"""WITH s AS (SELECT doc_id, text, CASE WHEN rn < floor(n * 0.02) THEN 'val' WHEN rn < 2 * floor(n * 0.02) THEN 'test' ELSE 'train' END AS split FROM (SELECT doc_id, text, row_number() OVER (ORDER BY {RANK}) - 1 AS rn, count(*) OVER () AS n FROM documents)),
  h AS (SELECT DISTINCT split, sha256(lower(trim(text))) AS h FROM s) SELECT b.split, count(*) AS leaked FROM h a JOIN h b ON a.h = b.h AND a.split = 'train' AND b.split <> 'train' GROUP BY b.split""")
def leakage_check(spark, sf):
    h = corpus.split_rows(docs(spark, sf).select("doc_id", "text")).select("split", F.sha2(F.lower(F.trim("text")), 256).alias("h")).distinct()
    return h.where("split <> 'train'").join(h.where("split = 'train'").select("h"), "h", "left_semi").groupBy("split").agg(F.count("*").alias("leaked"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents), b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM benchmark),
  g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS s FROM w WHERE len(w) >= 8), k AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS s FROM b WHERE len(w) >= 8)
  SELECT doc_id, item_id, count(*) AS shared FROM g JOIN k USING (s) GROUP BY doc_id, item_id""")
def contamination_shingles(spark, sf):
    """Documents that share 8-token shingles with benchmark items."""
    grams = F.explode(F.when(F.size(X.tokens(F.col("text"))) >= 8, X.shingles(X.tokens(F.col("text")), 8))).alias("s")
    g = docs(spark, sf).select("doc_id", grams)
    k = table(spark, sf, "benchmark").select("item_id", grams)
    return g.join(k, "s").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


@query("""SELECT source, count(*) AS n_raw, count(DISTINCT text) AS n_dedup, count(*) FILTER (WHERE length(text) >= 200) AS n_approved, round(100.0 * count(*) FILTER (WHERE length(text) >= 200) / count(*), 1) AS retention_pct, floor(sum(length(text)) / 3.8)::BIGINT AS est_tokens FROM documents GROUP BY source""")
def source_manifest(spark, sf):
    long = F.length("text") >= 200
    return docs(spark, sf).groupBy("source").agg(F.count("*").alias("n_raw"), F.count_distinct(F.sha2("text", 256)).alias("n_dedup"), F.count_if(long).alias("n_approved"), F.round(100.0 * F.count_if(long) / F.count("*"), 1).alias("retention_pct"), F.floor(F.sum(F.length("text")) / 3.8).alias("est_tokens"))


@query("""WITH a AS (SELECT DISTINCT source FROM documents WHERE lang IN ('en', 'es')), b AS (SELECT DISTINCT source FROM documents WHERE lang IN ('de', 'fr') AND source <> 'src4')
  SELECT coalesce(a.source, b.source) AS source, CASE WHEN a.source IS NULL THEN 'added' WHEN b.source IS NULL THEN 'removed' ELSE 'kept' END AS change FROM a FULL JOIN b ON a.source = b.source""")
def manifest_diff(spark, sf):
    d = docs(spark, sf)
    a, b = d.where("lang in ('en', 'es')").select(F.col("source").alias("a")).distinct(), d.where("lang in ('de', 'fr') and source <> 'src4'").select(F.col("source").alias("b")).distinct()
    return a.join(b, F.col("a") == F.col("b"), "full").select(F.coalesce("a", "b").alias("source"), F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("kept").alias("change"))


# --- retrieval ---


BM25_TOP_SQL = r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents), l AS (SELECT doc_id, len(t) AS dl FROM t), st AS (SELECT count(*) AS n, avg(dl) AS av FROM l),
  q AS (SELECT item_id AS query_id, x AS term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS x FROM benchmark) GROUP BY 1, 2),
  f AS (SELECT doc_id, x AS term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS x FROM t) GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM f GROUP BY term),
  s AS (SELECT q.query_id, f.doc_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av))), 6) AS score FROM q JOIN f USING (term) JOIN d USING (term) JOIN l ON l.doc_id = f.doc_id, st GROUP BY 1, 2)
  SELECT query_id, doc_id, round(score, 2) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10"""


@query(BM25_TOP_SQL)
def bm25_topk(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return inverted.bm25(docs(spark, sf), b).select("query_id", "doc_id", F.round("score", 2).alias("score"))


@query(BM25_TOP_SQL)
def bm25_appended(spark, sf):
    """The same ranking from a stored index to which one source is appended, and then, with all of it, every document once more; merged."""
    d, own = docs(spark, sf), F.coalesce(F.col("source") == "src1", F.lit(False))
    index = inverted.TextIndex.create(spark)
    for part in (d.where(~own), d.where(own), d):
        index.add(part.select("doc_id", "text"))
    index.merge()
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return index.search(b).select("query_id", "doc_id", F.round("score", 2).alias("score"))


COS = "list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / ((sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) + 1e-9) * (sqrt(list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) + 1e-9))"
TOPK = f"k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM (SELECT q.vec_id AS query_id, q.label AS ql, v.vec_id, v.label, round({COS}, 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id))"


def _top(spark, sf, k):
    e = table(spark, sf, "embeddings")
    return vector_index.exact_top(e, e.where("vec_id % 50 = 0"), k)


@query(f"WITH {TOPK} SELECT query_id, vec_id, score, rank FROM k WHERE rank <= 5")
def cosine_topk(spark, sf):
    return _top(spark, sf, 5)


@query()
def vector_index_topk(spark, sf):
    """The five nearest from a stored index of lists and codes, filled in two appends, at a measured recall of 0.95 or more."""
    e = table(spark, sf, "embeddings")
    index = vector_index.VectorIndex.create(e)
    for part in (e.where("label < 5"), e):
        index.add(part)
    return index.search(e.where("vec_id % 50 = 0"))[0]


@query(f"""WITH {TOPK}, h AS (SELECT query_id, min(rank) FILTER (WHERE ql = label) AS f, sum(CASE WHEN ql = label THEN 1 / log2(rank + 1.0) ELSE 0 END) AS dcg FROM k WHERE rank <= 10 GROUP BY query_id),
  n AS (SELECT q.vec_id AS query_id, count(*) AS n FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND q.label = v.label GROUP BY 1)
  SELECT count(*) AS queries, round(avg(coalesce(1.0 / f, 0)), 6) AS mrr, round(avg(coalesce(f, 11)), 6) AS mean_rank, round(avg(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1.0)))), 6) AS ndcg, round(avg((f IS NOT NULL)::INT), 6) AS hit_rate FROM n JOIN h USING (query_id)""")
def mrr_ndcg(spark, sf):
    e = table(spark, sf, "embeddings")
    label = e.select(F.col("vec_id"), "label")
    ranked = _top(spark, sf, 10).join(label, "vec_id").join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id").withColumn("relevant", F.col("label") == F.col("ql"))
    sizes = label.groupBy("label").agg((F.count("*") - 1).alias("n"))
    n = label.where("vec_id % 50 = 0").join(sizes, "label").select(F.col("vec_id").alias("query_id"), "n")
    return retrieval.ranking_metrics(ranked, n)


BM25_SQL = r"""bt AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents), bl AS (SELECT doc_id, len(t) AS dl FROM bt), bst AS (SELECT count(*) AS n, avg(dl) AS av FROM bl),
  bq AS (SELECT doc_id AS query_id, x AS term, count(*) AS qtf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS x FROM documents WHERE doc_id % 50 = 0) GROUP BY 1, 2),
  bf AS (SELECT doc_id, x AS term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS x FROM bt) GROUP BY 1, 2), bd AS (SELECT term, count(*) AS df FROM bf GROUP BY term),
  bs AS (SELECT bq.query_id, bf.doc_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av))), 6) AS score FROM bq JOIN bf USING (term) JOIN bd USING (term) JOIN bl ON bl.doc_id = bf.doc_id, bst WHERE bf.doc_id <> bq.query_id GROUP BY 1, 2),
  sparse AS (SELECT query_id, doc_id AS vec_id, score AS s FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bs) WHERE rank <= 24)"""


@query(f"""WITH {TOPK}, {BM25_SQL}, dense AS (SELECT query_id, vec_id, score AS d FROM k WHERE rank <= 24),
  f AS (SELECT query_id, vec_id, round(0.7 * coalesce(d, 0.0) + 0.3 * coalesce(s, 0.0) / greatest(max(s) OVER (PARTITION BY query_id), 1e-9), 4) AS score FROM dense FULL JOIN sparse USING (query_id, vec_id))
  SELECT query_id, max(score) AS best, count(*) FILTER (WHERE score >= 0.25 OR rank = 1) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM f) WHERE rank <= 5 GROUP BY query_id""")
def hybrid_fusion(spark, sf):
    """Cosine and BM25 fused: a document and the vector of its number are one passage; the best score of each query and how many of its five best stay."""
    dense = materialize(_top(spark, sf, 24), "dense").drop("rank")
    d = docs(spark, sf).select("doc_id", "text")
    sparse = inverted.bm25(d, d.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text"), 25).where("doc_id <> query_id")
    sparse = retrieval.top(sparse.drop("rank"), ["query_id"], [F.desc("score"), F.col("doc_id")], 24).select("query_id", F.col("doc_id").alias("vec_id"), "score")
    fused = retrieval.fuse(dense, materialize(sparse, "sparse"), ["query_id", "vec_id"])
    return fused.groupBy("query_id").agg(F.round(F.max("score"), 4).alias("best"), F.count("*").alias("kept"))


@query(f"SELECT label, count(*) AS n, round(avg(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS mean_norm FROM embeddings GROUP BY label")
def embedding_norms(spark, sf):
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(V.norm(F.col("embedding"))), 6).alias("mean_norm"))


@query(r"""WITH RECURSIVE p AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g'), '([.!?])[ \t\n\r\f\x0B]+', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents), s AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS sent FROM p),
  f(doc_id, k, held, made) AS (SELECT doc_id, k, sent, NULL::VARCHAR FROM s WHERE k = 1 UNION ALL SELECT s.doc_id, s.k, CASE WHEN held <> '' AND length(held) + 1 + length(sent) > 512 THEN regexp_extract(held, '([^ \t\n\r\f\x0B]+)[ \t\n\r\f\x0B]*$', 1) || ' ' || sent ELSE trim(held || ' ' || sent) END,
    CASE WHEN held <> '' AND length(held) + 1 + length(sent) > 512 THEN held END FROM f JOIN s ON s.doc_id = f.doc_id AND s.k = f.k + 1),
  c AS (SELECT doc_id, k, made AS chunk FROM f WHERE made IS NOT NULL UNION ALL SELECT doc_id, 1000000000, held FROM f WHERE held <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) = 1),
  w AS (SELECT * FROM c WHERE len(list_filter(string_split_regex(chunk, '[ \t\n\r\f\x0B]+'), lambda x: x <> '')) >= 4), o AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INTEGER AS chunk_idx, chunk FROM w)
  SELECT doc_id, chunk_idx, chunk, substr(md5(doc_id || ':' || chunk_idx || ':' || left(chunk, 40)), 1, 12) AS chunk_id FROM o""")
def chunk_text(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(retrieval.chunk_texts()(F.col("text"))).alias("chunk_idx", "chunk")).withColumn("chunk_id", F.substring(F.md5(F.concat_ws(":", "doc_id", "chunk_idx", F.substring("chunk", 1, 40))), 1, 12))


# --- knowledge graph ---


TRIPLES_SQL = """tr AS (SELECT 'c' || c_custkey AS subject, 'located_in' AS relation, n_name AS object, 0.5 + (c_custkey % 50) / 100.0::DOUBLE AS confidence FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 's' || s_suppkey, 'located_in', n_name, 0.5 + (s_suppkey % 50) / 100.0::DOUBLE FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT n_name, 'part_of', r_name, 1.0 FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def _triples(spark, sf):
    t = lambda name: table(spark, sf, name)
    half = lambda k: 0.5 + (F.col(k) % 50) / 100.0
    nation = t("nation")
    c = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), "c_custkey").alias("subject"), F.lit("located_in").alias("relation"), F.col("n_name").alias("object"), half("c_custkey").alias("confidence"))
    s = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), "s_suppkey"), F.lit("located_in"), "n_name", half("s_suppkey"))
    r = nation.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.lit("part_of"), "r_name", F.lit(1.0))
    return c.union(s).union(r)


@query(f"WITH {TRIPLES_SQL} SELECT relation, object, count(*) AS n, round(avg(confidence), 6) AS mean FROM tr GROUP BY relation, object")
def kg_triples(spark, sf):
    return _triples(spark, sf).groupBy("relation", "object").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"))


@query(f"WITH {TRIPLES_SQL}, e AS (SELECT count(*) AS entities FROM (SELECT subject FROM tr UNION SELECT object FROM tr)) SELECT count(*) AS triples, round(avg(confidence), 6) AS avg_confidence, count(DISTINCT relation) AS relations, any_value(entities) AS entities, round(count(*)::DOUBLE / (any_value(entities) * any_value(entities)), 9) AS density FROM tr, e")
def kg_analytics(spark, sf):
    return graph.analytics(_triples(spark, sf))


@query("""WITH tr AS (SELECT 'c' || o_custkey AS subject, 'has_status' AS relation, o_orderstatus AS object, max(round(0.5 + (o_orderkey % 50) / 100.0, 4))::DOUBLE AS confidence FROM orders GROUP BY 1, 2, 3)
  SELECT subject, relation, count(*) AS n, array_to_string(list_sort(list(DISTINCT object)), ',') AS objects, arg_min(object, struct_pack(a := -confidence, b := object)) AS preferred FROM tr GROUP BY subject, relation HAVING count(DISTINCT object) > 1""")
def kg_contradictions(spark, sf):
    t = table(spark, sf, "orders").groupBy(F.concat(F.lit("c"), "o_custkey").alias("subject"), F.lit("has_status").alias("relation"), F.col("o_orderstatus").alias("object")).agg(F.max(F.round(0.5 + (F.col("o_orderkey") % 50) / 100.0, 4)).alias("confidence"))
    return graph.contradictions(t).withColumn("objects", F.array_join("objects", ","))


@query(f"""WITH {TRIPLES_SQL}, b AS (SELECT subject AS a, object AS b, confidence FROM tr WHERE confidence >= 0.5 UNION ALL SELECT object, subject, confidence FROM tr WHERE confidence >= 0.5),
  e AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY confidence DESC, b) AS rn FROM b) WHERE rn <= 20), h1 AS (SELECT DISTINCT b AS entity FROM e WHERE a = 'c1'), h2 AS (SELECT DISTINCT e.b AS entity FROM h1 JOIN e ON h1.entity = e.a)
  SELECT entity, min(hop)::INTEGER AS hop FROM (SELECT 'c1' AS entity, 0 AS hop UNION ALL SELECT entity, 1 FROM h1 UNION ALL SELECT entity, 2 FROM h2) GROUP BY entity""")
def kg_neighbourhood(spark, sf):
    return graph.neighbourhood(_triples(spark, sf), spark.createDataFrame([("c1",)], "entity string"))


@query("""WITH RECURSIVE o AS (SELECT user_id, event_type, (least(abs(value), 100.0) / 200 + 0.5)::DOUBLE AS x, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events),
  f AS (SELECT user_id, event_type, i, n, x AS c FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.event_type, o.i, o.n, round(least(1.0, f.c + (1 - f.c) * o.x * 0.5), 4) FROM f JOIN o ON o.user_id = f.user_id AND o.event_type = f.event_type AND o.i = f.i + 1)
  SELECT user_id, event_type, round(c, 2) AS confidence, n::INTEGER AS mentions FROM f WHERE i = n""")
def kg_confidence_fold(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", (F.least(F.abs("value"), F.lit(100.0)) / 200 + 0.5).alias("confidence"))
    return graph.fold_confidence(e, ["user_id", "event_type"], ["event_id"]).withColumn("confidence", F.round("confidence", 2))


@query(f"WITH {TRIPLES_SQL}, al AS (SELECT n_name AS alias, 'N' || (n_nationkey % 5) AS canonical FROM nation) SELECT subject, relation, object, max(confidence)::DOUBLE AS confidence FROM (SELECT coalesce(s.canonical, subject) AS subject, relation, coalesce(o.canonical, object) AS object, confidence FROM tr LEFT JOIN al s ON s.alias = subject LEFT JOIN al o ON o.alias = object) GROUP BY 1, 2, 3")
def entity_merge(spark, sf):
    al = table(spark, sf, "nation").select(F.col("n_name").alias("alias"), F.concat(F.lit("N"), (F.col("n_nationkey") % 5).cast("string")).alias("canonical"))
    return graph.merge_entities(_triples(spark, sf), al)


# --- memory ---


@query("SELECT conv_id, turn, role, age FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)::INTEGER AS age FROM conversations) WHERE age <= 3")
def session_recent(spark, sf):
    return memory.recent(table(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", "age")


KIND_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '(?:^|[^A-Za-z0-9_])(?:{p})(?:$|[^A-Za-z0-9_])') THEN '{k}'" for k, p in memory.KINDS.items()) + " ELSE 'fact' END"


@query(f"SELECT {KIND_SQL} AS kind, role, count(*) AS n FROM conversations GROUP BY 1, 2")
def memory_kind(spark, sf):
    return table(spark, sf, "conversations").groupBy(memory.kind(F.col("text")).alias("kind"), "role").agg(F.count("*").alias("n"))


@query(f"SELECT conv_id, turn, round(i * pow(0.5, (({NOW} - (1790000000 + conv_id * 50000 + turn * 60)) / 86400.0) / 45.0), 6) AS importance, i * pow(0.5, (({NOW} - (1790000000 + conv_id * 50000 + turn * 60)) / 86400.0) / 45.0) < 0.15 AS archived FROM (SELECT conv_id, turn, (1 + turn % 5) / 5.0 AS i FROM conversations)")
def memory_decay(spark, sf):
    age = (F.lit(NOW) - (F.lit(1790000000) + F.col("conv_id") * 50000 + F.col("turn") * 60)) / 86400.0
    v = memory.decayed((1 + F.col("turn") % 5) / 5.0, age)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.round(v, 6).alias("importance"), (v < memory.ARCHIVE_UNDER).alias("archived"))


MEM_STOP = ", ".join(f"'{w}'" for w in memory.STOPWORDS)


@query(f"""WITH m AS (SELECT conv_id * 1000 + turn AS id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({MEM_STOP}))) AS t, (1 + turn % 5) / 5.0 AS i, 1790000000 + conv_id * 50000 + turn * 60 AS ts, turn % 7 AS a FROM conversations),
  s AS (SELECT id, len(list_intersect(t, ['the', 'with', 'on', 'for', 'er'])) AS o, i, ts, a FROM m)
  SELECT id, round(0.1 * (o / 5.0) + 0.3 * pow(0.5, (({NOW} - ts) / 86400.0) / 45.0) + 0.2 * least(a / 10.0, 1.0) + 0.4 * i, 6) AS score FROM s WHERE o > 0 ORDER BY score DESC, id LIMIT 10""")
def ranked_recall(spark, sf):
    m = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", ((1 + F.col("turn") % 5) / 5.0).alias("importance"), (F.lit(1790000000) + F.col("conv_id") * 50000 + F.col("turn") * 60).alias("ts"), (F.col("turn") % 7).alias("access_count"))
    return memory.ranked_recall(m, ["the", "with", "on", "for", "er"], F.lit(NOW)).select("id", "score")


BIAS_SQL = "CASE k " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in memory.KIND_BIAS.items()) + " ELSE 0.45 END"
MARKS_SQL = " + ".join(f"contains(low, '{m}')::INT" for m in memory.IMPORTANT)


@query(f"""WITH b AS (SELECT conv_id, turn, {KIND_SQL} AS k, lower(text) AS low, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS n FROM conversations)
  SELECT conv_id, turn, k AS kind, round(CASE WHEN n = 0 THEN 0.0 ELSE 0.35 * greatest(0.0, least(1.0, (turn % 3) / 2.0)) + 0.25 * {BIAS_SQL} + 0.2 * least(1.0, 0.15 * ({MARKS_SQL})) + 0.2 * least(1.0, greatest(0.0, (n - 3) / 27.0)) END, 6)::DOUBLE AS importance FROM b""")
def memory_importance(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("kind", memory.kind(F.col("text")))
    return rows.select("conv_id", "turn", "kind", F.round(memory.importance(F.col("text"), (F.col("turn") % 3).cast("double"), F.col("kind")), 6).alias("importance"))


@query(f"""WITH b AS (SELECT conv_id, turn, {KIND_SQL} AS k, lower(text) AS low, text, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS n FROM conversations),
  s AS (SELECT *, CASE WHEN n = 0 THEN 0.0 ELSE 0.35 * 0.5 + 0.25 * {BIAS_SQL} + 0.2 * least(1.0, 0.15 * ({MARKS_SQL})) + 0.2 * least(1.0, greatest(0.0, (n - 3) / 27.0)) END AS imp, CASE WHEN turn > min(turn) OVER (PARTITION BY lower(trim(text)), conv_id) THEN 1.0 ELSE 0.0 END AS dup FROM b)
  SELECT CASE WHEN length(text) < 4 OR n < 2 THEN 'rejected_low_value' WHEN dup >= 0.98 AND contains(low, 'actually') THEN 'admitted_correction' WHEN dup >= 0.98 THEN 'rejected_exact_duplicate' WHEN contains(low, 'actually') THEN 'admitted_correction' WHEN imp >= 0.60 THEN 'admitted_high_importance' WHEN dup = 0 THEN 'admitted_novel' ELSE 'rejected_low_value' END AS reason, count(*) AS n FROM s GROUP BY 1""")
def admission_decision(spark, sf):
    """The admission cascade; a text said before in its conversation counts as an exact copy."""
    c = table(spark, sf, "conversations")
    low = F.lower(F.col("text"))
    firsts = c.groupBy("conv_id", F.lower(F.trim("text")).alias("key")).agg(F.min("turn").alias("first"))
    rows = c.withColumn("key", F.lower(F.trim("text"))).join(firsts, ["conv_id", "key"])
    filler = (F.length("text") < 4) | (F.size(X.tokens(F.col("text"))) < 2)
    no = F.lit(False)
    rows = rows.select("turn", "first", filler.alias("filler"), low.contains("actually").alias("corrected"), memory.importance(F.col("text"), F.lit(1.0), memory.kind(F.col("text"))).alias("importance"))
    reason = memory.admit(F.when(F.col("turn") > F.col("first"), 1.0).otherwise(0.0), F.col("importance"), F.col("corrected"), F.col("filler"), no, F.lit(0.0), no)
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


# --- audit, registry, runs ---


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(strftime(ts, '%Y-%m-%d')) AS first_day, max(strftime(ts, '%Y-%m-%d')) AS last_day FROM events GROUP BY event_type")
def audit_activity(spark, sf):
    return audit.activity(table(spark, sf, "events"))


@query("""WITH s AS (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 3), d AS (SELECT user_id, list_sort(list(DISTINCT event_type) FILTER (WHERE value > 0)) AS done FROM events GROUP BY user_id)
  SELECT user_id, array_to_string(coalesce(done, []), ',') AS done, array_to_string(list_sort(list_filter((SELECT list(event_type) FROM s), lambda x: NOT list_contains(coalesce(done, []), x))), ',') AS missing FROM d""")
def audit_compliance(spark, sf):
    e = table(spark, sf, "events")
    need = tuple(r[0] for r in e.select("event_type").distinct().orderBy("event_type").limit(3).collect())
    c = audit.compliance(e, "user_id", "event_type", F.col("value") > 0, need)
    return c.select("user_id", F.array_join("done", ",").alias("done"), F.array_join("missing", ",").alias("missing"))


@query("SELECT c_mktsegment AS category, n_name AS status, count(*) AS n, round(sum(c_acctbal), 2) AS tokens FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((c_mktsegment), (n_name), ())")
def registry_grouping_sets(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupingSets([["c_mktsegment"], ["n_name"], []], "c_mktsegment", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("tokens")).select(F.col("c_mktsegment").alias("category"), F.col("n_name").alias("status"), "n", "tokens")


@query("SELECT user_id, count(*) FILTER (WHERE value > 0) AS useful, count(*) FILTER (WHERE value <= 0 OR value IS NULL) AS not_useful, round(count(*) FILTER (WHERE value > 0)::DOUBLE / count(*), 6) AS hit_rate FROM events GROUP BY user_id HAVING count(*) >= 3 ORDER BY not_useful DESC, user_id LIMIT 50")
def hard_examples(spark, sf):
    up = F.coalesce(F.col("value") > 0, F.lit(False))
    g = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(up).alias("useful"), F.count_if(~up).alias("not_useful"), F.round(F.count_if(up) / F.count("*"), 6).alias("hit_rate"))
    return g.where(F.col("useful") + F.col("not_useful") >= 3).orderBy(F.desc("not_useful"), "user_id").limit(50)


@query("SELECT user_id, min(event_id) AS opened, max(event_id) AS closed, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) FILTER (WHERE value IS NOT NULL) AS value FROM events GROUP BY user_id")
def run_history(spark, sf):
    return audit.run_history(table(spark, sf, "events"), "user_id", "event_id", ["event_type", "value"])


@query("SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, round(avg(value), 6) AS mean, max(CAST(json_extract(props, '$.k') AS INTEGER)) AS most FROM events GROUP BY user_id")
def observability_snapshot(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.round(F.avg("value"), 6).alias("mean"), F.max(F.get_json_object("props", "$.k").cast("int")).alias("most"))


@query("SELECT p_brand AS category, count(*) AS files, round(sum(p_retailprice), 2) AS size, round(100.0 * count(*) / 50, 2) AS progress_pct, count(*) FILTER (WHERE p_size <= 10) AS small FROM part GROUP BY p_brand")
def warehouse_stats(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("category")).agg(F.count("*").alias("files"), F.round(F.sum("p_retailprice"), 2).alias("size"), F.round(100.0 * F.count("*") / 50, 2).alias("progress_pct"), F.count_if(F.col("p_size") <= 10).alias("small"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_rollup(spark, sf):
    rows = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT d.doc_id, d.source, s.s_name FROM documents d LEFT JOIN supplier s ON d.source = 'src' || (s.s_suppkey - 1)")
def source_join(spark, sf):
    s = table(spark, sf, "supplier").select(F.concat(F.lit("src"), (F.col("s_suppkey") - 1).cast("string")).alias("source"), "s_name")
    return docs(spark, sf).select("doc_id", "source").join(s, "source", "left").select("doc_id", "source", "s_name")


@query("SELECT shard_id, min(doc_id) AS first_doc, max(doc_id) AS last_doc, sum(n_chars)::BIGINT AS size FROM (SELECT doc_id, n_chars, ((sum(n_chars) OVER (ORDER BY doc_id) - n_chars) // 50000)::BIGINT AS shard_id FROM documents) GROUP BY shard_id")
def shard_offsets(spark, sf):
    """Fixed-width shards over the corpus laid end to end by id: offsets from prefix sums over id ranges."""
    d = docs(spark, sf).select("doc_id", "n_chars", F.floor(F.col("doc_id") / 1000).alias("r"))
    sums = d.groupBy("r").agg(F.sum("n_chars").alias("s"))
    before = sums.select("r", (F.sum("s").over(W.orderBy("r")) - F.col("s")).alias("before"))
    at = F.col("before") + F.sum("n_chars").over(W.partitionBy("r").orderBy("doc_id")) - F.col("n_chars")
    return d.join(before, "r").withColumn("shard_id", F.floor(at / 50000)).groupBy("shard_id").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.sum("n_chars").alias("size"))


# --- event time (extension) ---


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2".replace("date_trunc('day', ts)::TIMESTAMP", "strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M')"))
def event_tumbling(spark, sf):
    t = stream.tumbling(table(spark, sf, "events"))
    return t.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM (SELECT event_type, date_trunc('hour', ts) - to_hours(unnest(range(4))) AS s FROM events) GROUP BY 1, 2")
def event_sliding(spark, sf):
    return stream.sliding(table(spark, sf, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_session(spark, sf):
    return stream.sessions(table(spark, sf, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), f(user_id, rn, event_id, s, level, allowed) AS (
    SELECT user_id, rn, event_id, s, 1.0::DOUBLE, true FROM e WHERE rn = 1
    UNION ALL SELECT e.user_id, e.rn, e.event_id, e.s, least(2.0, f.level + (e.s - f.s) * 2.0 / 60) - (least(2.0, f.level + (e.s - f.s) * 2.0 / 60) >= 1)::INT, least(2.0, f.level + (e.s - f.s) * 2.0 / 60) >= 1 FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
  SELECT event_id, allowed FROM f""")
def rate_limit_fold(spark, sf):
    """Which events a bucket of two a minute lets through, by user."""
    e = table(spark, sf, "events")
    return stream.token_bucket(e.withColumn("ts", F.col("ts").cast("timestamp")), 2.0)


@query("""WITH h AS (SELECT conv_id, turn, text, coalesce(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS past FROM conversations),
  n AS (SELECT *, regexp_extract_all(past, '(?:^|[^A-Za-z])([A-Z][a-z]{2,})', 1)[-1] AS noun FROM h)
  SELECT conv_id, turn, CASE WHEN noun IS NOT NULL AND regexp_matches(split_part(text, chr(10), 1), '(?i)(^|[^A-Za-z])(it|this|that)([^A-Za-z]|$)') THEN regexp_replace(text, '(?i)(^|[^A-Za-z])(it|this|that)([^A-Za-z]|$)', '\\1' || noun || '\\3') ELSE text END AS rewritten FROM n""")
def query_rewrite(spark, sf):
    c = table(spark, sf, "conversations")
    past = F.concat_ws(" ", F.collect_list("text").over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1)))
    return c.withColumn("h", past).select("conv_id", "turn", retrieval.rewrite_query(F.col("text"), F.col("h")).alias("rewritten"))


@query(f"WITH {METRICS}, e AS (SELECT * FROM q WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)) SELECT lang, count(*) AS docs, sum(n_words)::BIGINT AS tokens, round(avg(quality_score), 6) AS mean_quality FROM e WHERE chars >= 32 AND quality_score >= 0.35 AND ocr_noise_ratio <= 0.25 GROUP BY lang")
def flagship(spark, sf):
    """Keep-first dedup, quality filter, then documents, tokens and mean quality by language."""
    m = corpus.quality_metrics(docs(spark, sf)).select("doc_id", "lang", "chars", "quality_score", "ocr_noise_ratio", F.sha2("text", 256).alias("h"), X.approx_tokens(F.col("text")).alias("tokens"))
    kept = corpus.keep_first(materialize(m, "metrics"), F.col("h")).where(corpus.passes_quality())  # narrow rows: no text is shuffled
    return kept.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"), F.round(F.avg("quality_score"), 6).alias("mean_quality"))
