"""Cleaners for kinds of sources and records: text in, paragraphs or one training string out.

All but `nfc` are Catalyst expressions. Records come as JSON text; a record that
isn't fit gives null. Regex classes are spelled out so that they mean the same
in Java and elsewhere.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as X
from millrace.operators.corpus import quality_ok

# The patterns of the sources and what takes their place, in order.
GUTENBERG = (
    ("(?is)^.*?(?:START OF (?:THIS|THE) PROJECT GUTENBERG|PROJECT GUTENBERG EBOOK|\\*\\*\\* START)", ""),
    ("(?is)(?:END OF (?:THIS|THE) PROJECT GUTENBERG|END OF PROJECT GUTENBERG|\\*\\*\\* END).*$", ""),
    ("(?i)(?:Title|Author|Release Date|Language|Character set encoding|Produced by|Updated editions will replace)[^\\n]*?\\n", ""),
)
STANDARD_EBOOKS = (("(?im)^Produced by[^\\n]*?\\n", ""),)
OPENSTAX = (
    ("(?i)(?:Learning Objectives?|Key Terms?|Summary|Review Questions?|Critical Thinking Questions?|Personal Application Questions?|Try It|Check Your Understanding)[ \\t\\r\\f\\x0B]*\\n[ \\t\\r\\n\\f\\x0B]*", "\n"),
    ("(?im)^Figure[ \\t]+[0-9]+\\.[0-9]+[^\\n]*?$", ""),
    ("(?m)^[0-9]+\\.[0-9]+[ \\t\\n]+[A-Za-z0-9_]", ""),
)
CK12 = (("(?m)^#+[ \\t]+[^\\n]*$", ""), ("(?m)^[0-9]+\\.[ \\t]+[^\\n]*$", ""))
WIKIPEDIA = (
    ("\\{\\{[^}]*\\}\\}", " "),
    ("(?is)<ref[^>]*>.*?</ref>", " "),
    ("(?i)\\[\\[File:[^\\]]+\\]\\]", ""),
    ("(?i)\\[\\[Category:[^\\]]+\\]\\]", ""),
    ("\\[\\[(?:[^|\\]]+\\|)?([^\\]]+)\\]\\]", "$1"),
    ("(?m)^={2,6}[ \\t]+[^\\n]+?[ \\t]+={2,6}[ \\t]*$", ""),
)
STUB = "(?is)^This (?:article|stub|section)[^\\n]{0,80}stub"
PYTORCH = (
    ("(?s)\\.\\. [A-Za-z0-9_]+::.*?(\\n\\n|\\z)", "$1"),
    ("(?m)^( {4,}|\\t)[^\\n]*$", ""),
    ("(?m)^:(?:type|param|returns?|rtype)[ \\t]+[A-Za-z0-9_]*:[^\\n]*$", ""),
)
ABSTRACT = "(?im)^Abstract[ \\t\\r\\f\\x0B]*\\n+((?s:.{0,1000}.{0,1000}))"
NEXT_SECTION = "(?s)\\n\\n(?:[0-9]+|[A-Z])[ \\t\\r\\n]*\\..*$"
MARKS = (("\\$[^$]+\\$|\\$\\$[^$]+\\$\\$", "[equation]"), ("\\[[0-9,; \\t\\n–-]+\\]", ""))
ARXIV = (("(?is)\\n+References?[ \\t\\r\\f\\x0B]*\\n+.*$", ""), *MARKS, ("(?m)^[0-9]+(?:\\.[0-9]+)*[ \\t\\n]+[A-Za-z0-9_]", ""))
INJECTIONS = (
    ("(?i)ignore[ \\t\\n]+(?:the[ \\t\\n]+)?(?:above|previous|all)[ \\t\\n]+", "[sanitised]"),
    ("(?i)you[ \\t\\n]+are[ \\t\\n]+now[ \\t\\n]+", "[sanitised]"),
    ("(?i)system[ \\t\\n]*:[ \\t\\n]*you[ \\t\\n]+(?:must|should|will)[ \\t\\n]+", "[sanitised]"),
)
#: Cleaners by kind: replacements before the base cleaner, and the fewest words of a paragraph.
SOURCES = {
    "gutenberg": (GUTENBERG, 8),
    "standard_ebooks": (STANDARD_EBOOKS, 8),
    "openstax": (OPENSTAX, 12),
    "ck12": (CK12, 10),
    "wikipedia": (WIKIPEDIA, 20),
    "pytorch_docs": (PYTORCH, 12),
    "arxiv_abstract": (MARKS, 15),
    "arxiv_full": (ARXIV, 12),
    "acl": (ARXIV, 12),
    "generic": ((), 8),
}
#: The cleaner of each category of sources; other categories are generic.
CATEGORIES = {"A": "gutenberg", "B": "openstax", "E": "wikipedia", "F": "arxiv_abstract", "G": "arxiv_full"}


@F.arrow_udf(T.StringType())
def nfc(text: pa.Array) -> pa.Array:
    """Unicode normal form C."""
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in text.to_pylist()], pa.string())


def replaced(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p[0], p[1]), pairs, text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, "^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$", "")


def paragraphs(text: Column, min_words: int) -> Column:
    """The paragraphs, split at blank lines, that pass the quality rules."""
    return F.filter(F.transform(F.split(text, "\\n{2,}"), strip), lambda p: (p != "") & quality_ok(p, min_words))


def clean_source(text: Column, kind: str) -> Column:
    """Paragraphs of a source of one of the kinds in SOURCES."""
    pairs, least = SOURCES[kind]
    if kind == "arxiv_abstract":
        region = F.regexp_extract(text, ABSTRACT, 1)
        text = F.when(text.rlike("(?im)^Abstract[ \\t\\r\\f\\x0B]*\\n+"), F.regexp_replace(region, NEXT_SECTION, "")).otherwise(text)
    out = paragraphs(X.clean_lines(replaced(text, pairs)), least)
    if kind == "wikipedia":
        out = F.when(F.substring(text, 1, 500).rlike(STUB), F.expr("cast(array() as array<string>)")).otherwise(out)
    return out


def clean_for_category(text: Column, category: Column) -> Column:
    """Paragraphs by the cleaner of the row's category."""
    out = clean_source(text, "generic")
    for letter, kind in CATEGORIES.items():
        out = F.when(category == letter, clean_source(text, kind)).otherwise(out)
    return out


def normalise_text(text: Column) -> Column:
    """NFC, line ends, at most three line breaks in a row, blanks collapsed, other unprintables out."""
    out = F.regexp_replace(F.regexp_replace(nfc(text), "\\r\\n?", "\n"), "\\n{4,}", "\n\n\n")
    return strip(F.regexp_replace(F.regexp_replace(out, "[ \\t]{2,}", " "), "[\\p{C}\\p{Z}&&[^ \\n\\t]]", ""))


def sanitise_chunk(text: Column) -> Column:
    """Injection patterns of retrieved chunks replaced."""
    return replaced(text, INJECTIONS)


# --- records ---


def _n(text: Column) -> Column:
    return F.size(X.words(text))


def _field(record: Column, path: str) -> Column:
    return strip(F.coalesce(F.get_json_object(record, f"$.{path}"), F.lit("")))


def _fit(ok: Column, text: Column) -> Column:
    return F.when(ok, text)


def gsm8k(record: Column) -> Column:
    q, a = _field(record, "question"), _field(record, "answer")
    text = F.concat(F.lit("<reasoning>\nQuestion: "), q, F.lit("\n\nSolution:\n"), strip(F.regexp_replace(a, "(?m)####[ \\t\\n]*[^ \\t\\n]+[ \\t\\n]*$", "")), F.lit("\n</reasoning>"))
    return _fit((q != "") & (a != "") & quality_ok(text, 15), text)


def math_problem(record: Column) -> Column:
    p, s = _field(record, "problem"), _field(record, "solution")
    text = F.concat(F.lit("<reasoning>\nProblem: "), p, F.lit("\n\nSolution:\n"), F.regexp_replace(s, "\\\\boxed\\{[^}]+\\}", "[answer]"), F.lit("\n</reasoning>"))
    return _fit((p != "") & (s != "") & quality_ok(text, 15), text)


def arc(record: Column) -> Column:
    r = F.from_json(record, "question struct<stem: string, choices: array<struct<text: string, label: string>>>, answerKey string")
    stem, choices, key = strip(F.coalesce(r["question"]["stem"], F.lit(""))), r["question"]["choices"], strip(F.coalesce(r["answerKey"], F.lit("")))
    listed = F.array_join(F.transform(choices, lambda c: F.concat(F.lit("  "), F.coalesce(c["label"], F.lit("?")), F.lit(". "), F.coalesce(c["text"], F.lit("")))), "\n")
    said = F.coalesce(F.get(F.transform(F.filter(choices, lambda c: c["label"] == key), lambda c: F.coalesce(c["text"], key)), F.lit(0)), key)
    text = F.concat(F.lit("<reasoning>\nQuestion: "), stem, F.lit("\n\nChoices:\n"), listed, F.lit("\n\nAnswer: "), said, F.lit("\n</reasoning>"))
    return _fit((stem != "") & (F.size(choices) > 0) & quality_ok(text, 10), text)


def dolly(record: Column) -> Column:
    i, c, r = (_field(record, k) for k in ("instruction", "context", "response"))
    asked = F.when(c != "", F.concat(i, F.lit("\n\nContext: "), c)).otherwise(i)
    return _fit((i != "") & (r != "") & (_n(r) >= 10), F.concat(F.lit("<user>"), asked, F.lit("</user><assistant>"), r, F.lit("</assistant>")))


def oasst2(record: Column) -> Column:
    parent, text = _field(record, "parent_text"), _field(record, "text")
    ok = (F.coalesce(F.get_json_object(record, "$.lang"), F.lit("en")) == "en") & (F.coalesce(F.get_json_object(record, "$.quality_score").cast("double"), F.lit(0.0)) >= 0.5)
    ok = ok & (F.coalesce(F.get_json_object(record, "$.role"), F.lit("")) == "assistant") & (parent != "") & (text != "") & (_n(text) >= 15)
    return _fit(ok, F.concat(F.lit("<user>"), parent, F.lit("</user><assistant>"), text, F.lit("</assistant>")))


def flan(record: Column) -> Column:
    i, t = _field(record, "inputs"), _field(record, "targets")
    return _fit((i != "") & (t != "") & (_n(t) >= 5), F.concat(F.lit("<user>"), i, F.lit("</user><assistant>"), t, F.lit("</assistant>")))


def dbpedia(record: Column) -> Column:
    e, a = _field(record, "entity"), _field(record, "abstract")
    return _fit((e != "") & (a != "") & quality_ok(a, 10), F.concat(F.lit("<kg>\n"), e, F.lit(": "), a, F.lit("\n</kg>")))


def conceptnet(record: Column) -> Column:
    s, r, e = (F.replace(_field(record, k), F.lit("_"), F.lit(" ")) for k in ("start", "rel", "end"))
    r = F.replace(r, F.lit("/r/"), F.lit(""))
    ok = (s != "") & (r != "") & (e != "") & (F.coalesce(F.get_json_object(record, "$.weight").cast("double"), F.lit(0.0)) >= 1.0)
    return _fit(ok, F.concat(F.lit("<kg>\n"), s, F.lit(" "), F.lower(r), F.lit(" "), e, F.lit(".\n</kg>")))


def msmarco(record: Column) -> Column:
    r = F.from_json(record, "query string, passages array<struct<passage_text: string, is_selected: int>>")
    q = strip(F.coalesce(r["query"], F.lit("")))
    first = F.get(F.filter(r["passages"], lambda p: p["is_selected"] != 0), F.lit(0))["passage_text"]
    ok = (q != "") & first.isNotNull() & quality_ok(first, 15)
    return _fit(ok, F.concat(F.lit("<retrieval>\nQuery: "), q, F.lit("\n\nPassage: "), strip(first), F.lit("\n</retrieval>")))


def natural_question(record: Column) -> Column:
    q, long = _field(record, "question.text"), _field(record, "long_answer")
    short = _field(record, "short_answers[0]")
    text = F.concat(F.lit("<retrieval>\nQuestion: "), q, F.lit("\n\nAnswer: "), long, F.lit("\n\nShort answer: "), F.when(short != "", short).otherwise("See above."), F.lit("\n</retrieval>"))
    return _fit((q != "") & (long != "") & (_n(long) >= 20), text)


def acl_text(record: Column) -> Column:
    """Title, abstract and text of a paper record, one after the other; clean it as `acl`."""
    parts = F.array(*[F.nullif(F.get_json_object(record, f"$.{k}"), F.lit("")) for k in ("title", "abstract", "text")])
    return F.array_join(F.transform(F.filter(parts, lambda p: p.isNotNull()), strip), "\n\n")


RECORDS = {"gsm8k": gsm8k, "math": math_problem, "arc": arc, "dolly": dolly, "oasst2": oasst2, "flan": flan, "dbpedia": dbpedia, "conceptnet": conceptnet, "msmarco": msmarco, "nq": natural_question}


def clean_record(record: Column, kind: Column) -> Column:
    """The training string of a record by its kind; null where it isn't fit or the kind isn't known."""
    return F.coalesce(*[F.when(kind == k, f(record)) for k, f in RECORDS.items()])
