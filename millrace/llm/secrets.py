"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Patterns give the base spans. The entropy scan takes every maximal run of
[A-Za-z0-9+/_=-] that is long enough (dots end it, as they end words), slides a window of the class's width
over it and keeps the Shannon entropy of the window by incremental counts: one
character enters, one leaves, and the sum of n*log2(n) changes by two terms.
The windows at or above the class's threshold are joined to a span of kind
`entropy`. Classes are tried from the narrowest alphabet to the widest. A run
that an allow-list pattern matches is left alone, and so is one without
letters. A run of letters alone is a candidate only if it mixes cases beyond a
capital at its start, and must come near to the most entropy a window can have,
as long words and names made of several words don't.

Defined cases: null text is empty; null or repeated ids are scanned row by
row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.runtime import bound_batches

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
#: The runs are maximal, so the least length can stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: In the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "entropy")

#: (class, alphabet, window, least entropy in bits). Fixed values.
CLASSES = (
    ("hex", re.compile(r"[0-9a-fA-F]+"), 24, 3.0),
    ("alnum", re.compile(r"[0-9A-Za-z]+"), 20, 3.6),
    ("base64", re.compile(r"[0-9A-Za-z+/_=-]+"), 20, 3.7),
)
#: Window and least entropy of runs without digits. Fixed values.
LETTERS = (20, 4.1)
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")

#: Runs that look random and aren't secret. Fixed values.
ALLOW = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # UUIDs
    r"(?:sha(?:1|256|384|512)|md5)[-_=:]?[0-9A-Za-z+/=]*",  # integrity digests
    r"[0-9=/_+-]+",  # numbers, dates, rulers
    r"(?:[a-z]+[-_/])+[a-z]+[0-9]*",  # slugs and paths
    r".*(?:EXAMPLE|example|XXXX|xxxx|changeme|placeholder).*",  # documented examples
)

_NLOGN = [0.0, 0.0] + [n * log2(n) for n in range(2, 257)]


def windows(run: str, width: int, least: float) -> list[tuple[int, int]]:
    """Joined [start, end) of the windows of the run with an entropy of `least` bits or more."""
    if len(run) < width:
        return []
    counts: dict[str, int] = {}
    total, bar, out = 0.0, width * (log2(width) - least) + 1e-9, []
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _NLOGN[n + 1] - _NLOGN[n]
        if i >= width:
            c = run[i - width]
            n = counts[c]
            counts[c] = n - 1
            total += _NLOGN[n - 1] - _NLOGN[n]
        if i >= width - 1 and total <= bar:  # entropy = log2(width) - total / width
            if out and i - width + 1 <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((i - width + 1, i + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind; an assignment's span runs from its name to the end of its value."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def entropy_spans(text: str, allow: tuple[str, ...] = ALLOW) -> list[tuple[str, int, int]]:
    """Spans of kind `entropy`, disjoint and in order."""
    allowed = [re.compile(a) for a in allow]
    out = []
    for m in _RUN.finditer(text):
        run = m.group()
        digits = any(map(str.isdigit, run))
        if not digits and (run[1:].islower() or run.isupper()):
            continue
        if not any(map(str.isalpha, run)) or any(a.fullmatch(run) for a in allowed):
            continue
        if not digits:
            out += [("entropy", m.start() + a, m.start() + b) for a, b in windows(run, *LETTERS)]
            continue
        for _, alphabet, width, least in CLASSES:
            if len(run) >= width and alphabet.fullmatch(run):
                out += [("entropy", m.start() + a, m.start() + b) for a, b in windows(run, width, least)]
                break
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """(doc_id, spans): spans is an array of (kind, start, end, found), sorted by start, then kind."""
    bound_batches(docs.sparkSession)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("found", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = []
            for t in b.column(1).to_pylist():
                t = t or ""
                both = sorted(base_spans(t) + entropy_spans(t, allow), key=lambda s: (s[1], KINDS.index(s[0])))
                spans.append([{"kind": k, "start": s, "end": e, "found": t[s:e]} for k, s, e in both])
            yield pa.record_batch([b.column(0), pa.array(spans, pa.list_(kind))], names=["doc_id", "spans"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(scan, "doc_id long, spans array<struct<kind: string, start: bigint, end: bigint, found: string>>")
