"""Text expressions: cleaning, token and shingle arrays, quality, language, classes, PII.

All but `entropy` and `word_shape` are Catalyst expressions. Regex classes are spelled out so that they mean
the same in Java and elsewhere.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
STOPWORDS = ("the", "and", "of", "to", "in", "a", "is", "for", "that", "on", "with", "as", "by", "this", "from")
CATEGORIES = {
    "Books": ["chapter", "novel", "author", "preface"],
    "Educational": ["lesson", "exercise", "student", "curriculum", "course"],
    "Research": ["abstract", "method", "results", "conclusion", "references"],
    "Technical": ["specification", "system", "architecture", "protocol", "deployment"],
    "Programming": ["python", "java", "function", "class", "algorithm", "code"],
    "Reasoning": ["therefore", "proof", "solve", "equation", "reasoning"],
    "Conversations": ["assistant", "user", "instruction", "response", "dialogue"],
    "Retrieval": ["question", "answer", "context", "evidence", "passage"],
    "Evaluation": ["benchmark", "accuracy", "multiple choice", "correct answer"],
    "Legal/Government": ["section", "act", "regulation", "court", "government"],
    "Knowledge Graph": ["entity", "relation", "triple", "ontology"],
    "Language Resources": ["synset", "frame", "lexicon", "lemma"],
    "Synthetic": ["synthetic", "generated", "artificial textbook"],
}
ADVANCED = ("theorem", "proof", "architecture", "formal")
LANGUAGE_SIGNALS = {
    "en": "the|is|are|was|were|and|or|in|of|to|a|an",
    "es": "el|la|los|las|es|son|y|en|de|que|por",
    "fr": "le|la|les|est|sont|et|en|de|que|pour|je",
    "de": "der|die|das|ist|sind|und|in|von|für|ich",
}
TAG, URL = "<[^>]+>", "https?://[^ \\t\\n\\r\\f\\x0B]+|www\\.[^ \\t\\n\\r\\f\\x0B]+"
UNPRINTABLE = "[^\\x09\\x0A\\x0D\\x20-\\x7E\\x{A0}-\\x{24F}]"
OCR_NOISE = "[|/_\\\\]{3,}|[Il1]{5,}|[0O]{5,}"
EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
SSN, CARD = "[0-9]{3}-[0-9]{2}-[0-9]{4}", "(?:[0-9][ -]?){13,16}"
SECRET = "(?i)(?:api[_-]?key|secret|password|token|passwd)[ \\t]*[=:][ \\t]*[^ \\t\\n\\r]+"
SK_KEY, GH_KEY = "sk-[A-Za-z0-9]{20,}", "ghp_[A-Za-z0-9]{36}"
SPACE = "[ \\t\\n\\r\\f\\x0B]+"
_SPACES = re.compile(SPACE)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, which is evaluated once for a row even where body's own lambdas use it."""
    return F.transform(F.array(value), body)[0]


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; 0 where b is 0."""
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def clean_text(text: Column) -> Column:
    """Document cleaner: tags, URLs, smart punctuation and unprintables out, one line."""
    plain = F.regexp_replace(F.regexp_replace(text, TAG, " "), URL, " ")
    return squeeze(F.regexp_replace(F.translate(plain, " ﻿“”’–—", "  \"\"'--"), UNPRINTABLE, " "))


def clean_lines(text: Column, redact: bool = True) -> Column:
    """Paragraph cleaner: line ends, tags, Markdown, URLs, blank runs, then redaction. NFC is left to the source."""
    out = F.regexp_replace(F.regexp_replace(text, "\\r\\n", "\n"), "\\r", "\n")
    for pattern, new in ((TAG, " "), ("!\\[[^\\]]*\\]\\([^)]*\\)", ""), ("\\[([^\\]]+)\\]\\([^)]*\\)", "$1"), ("https?://[^ \\t\\n\\r]+", ""), ("\\n{3,}", "\n\n"), ("[ \\t]{2,}", " "), ("[ \\t]+(\\n|$)", "$1")):
        out = F.regexp_replace(out, pattern, new)
    return F.trim(redact_secrets(redact_pii(out)) if redact else out)


def redact_pii(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, "[REDACTED]"), (EMAIL, SSN, CARD), text)


def redact_secrets(text: Column) -> Column:
    keyed = F.regexp_replace(text, "(?i)((?:api[_-]?key|secret|password|token|passwd)[ \\t]*)=[ \\t]*[^ \\t\\n\\r]+", "$1=[REDACTED]")
    keyed = F.regexp_replace(keyed, "(?i)(?:api[_-]?key|secret|password|token|passwd)[ \\t]*:[ \\t]*[^ \\t\\n\\r]+", "[REDACTED]")
    return F.regexp_replace(F.regexp_replace(keyed, SK_KEY, "[REDACTED]"), GH_KEY, "[REDACTED]")


def typed_redaction(text: Column) -> Column:
    """Output filter: secrets, then [email] [ssn] [card] placeholders."""
    out = redact_secrets(text)
    for p, name in ((EMAIL, "[email]"), (SSN, "[ssn]"), (CARD, "[card]")):
        out = F.regexp_replace(out, p, name)
    return out


#: A phone number of seven, ten or eleven digits, set apart by a blank, a dot or a dash, not within a word.
PHONE = "(?:^|[^\\p{L}\\p{N}_])(?:1[ \\t\\n.-]?)?(?:[0-9]{3}\\)?[ \\t\\n.-]?)?[0-9]{3}[ \\t\\n.-]?[0-9]{4}(?:$|[^\\p{L}\\p{N}_])"


def has_pii(text: Column, phones: bool = False) -> Column:
    """Whether a text holds an e-mail address, number or secret; with `phones` telephone numbers too."""
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in (EMAIL, SSN, CARD, SECRET, SK_KEY, GH_KEY, *([PHONE] if phones else []))])


def words(text: Column) -> Column:
    """White-space words; none for blank text."""
    flat = squeeze(text)
    return F.when(F.length(flat) > 0, F.split(flat, " ")).otherwise(F.expr("cast(array() as array<string>)"))


def has_words(text: Column, n: int) -> Column:
    """Whether the text has at least n white-space words; reads no further than it must."""
    space = SPACE[1:-2]
    return text.rlike(f"^[{space}]*+(?:[^{space}]++[{space}]++){{{n - 1}}}[^{space}]")


def approx_tokens(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def tokens(text: Column) -> Column:
    """Lower-case [a-z0-9_]+."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), 0)


def alnum_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def shingles(tok: Column, k: int = 5) -> Column:
    """Distinct k-token shingles; one of all tokens where there are fewer; none of none."""

    def of(t: Column) -> Column:
        n = F.size(t)
        many = F.array_distinct(F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(t, i, k), " ")))
        return F.when(n >= k, many).when(n > 0, F.array(F.array_join(t, " "))).otherwise(F.expr("cast(array() as array<string>)"))

    return let(tok, of)


def runs(sorted_: Column) -> Column:
    """Lengths of the runs of equal values of a sorted array."""

    def of(s: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == F.size(s)) | (F.get(s, i.cast("int")) != F.element_at(s, i.cast("int"))))
        return let(ends, lambda e: F.transform(e, lambda at, k: at - F.coalesce(F.get(e, k - 1), F.lit(0))))

    return F.when(F.size(sorted_) > 0, let(sorted_, of)).otherwise(F.expr("cast(array() as array<int>)"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two distinct arrays; 1 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(both.cast("double") / (F.size(a) + F.size(b) - both))


def stable_id(path: Column, text: Column) -> Column:
    return F.sha2(F.concat(path, F.lit("\n"), text), 256)


def stable_rank(doc_id: Column, seed: int = 42) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256)


def count_outside(text: Column, kept: str) -> Column:
    """Number of characters that are in the class `kept`."""
    return F.length(text) - F.length(F.regexp_replace(text, kept, ""))


def language_en(text: Column) -> Column:
    """struct(language, confidence, mixed): English or unknown, by stop words."""
    found = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z']+"), 0), F.lower)
    hits = F.size(F.filter(found, lambda w: w.isin(*STOPWORDS)))
    conf = F.when(F.size(found) == 0, 0.0).otherwise(F.least(F.lit(1.0), 0.5 + 0.5 * F.least(F.lit(1.0), hits / 10.0)))
    return F.struct(F.when(conf >= 0.55, "en").otherwise("unknown").alias("language"), F.round(conf, 4).alias("confidence"), ((conf > 0.15) & (conf < 0.55)).alias("mixed"))


def language_of_four(text: Column) -> Column:
    """The language with most signal words in the first 500 characters; ties and none go to the first named."""
    head = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.substring(text, 1, 500)), "[^a-z0-9_\\x{E0}-\\x{FF}]+", "  "), F.lit(" "))
    counts = [F.regexp_count(head, F.lit(f" (?:{p}) ")) for p in LANGUAGE_SIGNALS.values()]
    most = F.greatest(*counts)
    out = F.lit("de")
    for lang, c in reversed(list(zip(LANGUAGE_SIGNALS, counts, strict=True))):
        out = F.when(c == most, lang).otherwise(out)
    return F.when(most == 0, "en").otherwise(out)


def class_labels(text: Column) -> Column:
    """Up to three labels by keyword hits, then name; Technical where none hits."""
    return let(F.lower(text), _labels)


def _labels(low: Column) -> Column:
    scored = F.array(*[F.struct((-reduce(lambda a, b: a + b, [low.contains(k).cast("int") for k in kw])).alias("hits"), F.lit(name).alias("label")) for name, kw in CATEGORIES.items()])
    best = F.slice(F.transform(F.array_sort(F.filter(scored, lambda s: s["hits"] < 0)), lambda s: s["label"]), 1, 3)
    return F.when(F.size(best) > 0, best).otherwise(F.array(F.lit("Technical")))


def difficulty(text: Column) -> Column:
    low = F.lower(text)
    return F.when(F.size(words(text)) < 120, "basic").when(reduce(lambda a, b: a | b, [low.contains(k) for k in ADVANCED]), "advanced").otherwise("intermediate")


@F.arrow_udf(T.DoubleType())
def _entropy(text: pa.Array) -> pa.Array:
    out = []
    for t in text.to_pylist():
        if not t:
            out.append(None if t is None else 0.0)
            continue
        n = np.unique(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_counts=True)[1] / len(t)
        out.append(float(-(n * np.log2(n)).sum()))
    return pa.array(out, pa.float64())


def entropy(text: Column) -> Column:
    """Shannon entropy over characters, in bits; 0 for an empty text. One Arrow pass: a histogram in lambdas is 30 times slower."""
    return _ENTROPY(text)


@F.arrow_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in ("n", "distinct", "top")]))
def _word_shape(text: pa.Array) -> pa.Array:
    n, distinct, top = [], [], []
    for t in text.to_pylist():
        w = Counter(_SPACES.split((t or "").lower().strip(" \t\n\r\f\x0b"))) if t and t.strip(" \t\n\r\f\x0b") else Counter()
        n.append(w.total())
        distinct.append(len(w))
        top.append(sum(c for _, c in w.most_common(3)))
    return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in (n, distinct, top)], names=["n", "distinct", "top"])


# Filters on their results would otherwise run them a second time.
_ENTROPY, word_shape = _entropy.asNondeterministic(), _word_shape.asNondeterministic()
