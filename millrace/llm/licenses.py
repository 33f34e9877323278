"""License scans by diagonal voting.

Texts and templates are cut into words. The hash of every window of k words of a
text is joined to the templates' windows; a hit at word p of the text and word q
of a template votes for the diagonal p - q, on which a faithful copy has all its
votes. A word more or less shifts what follows to a neighbouring diagonal, so
diagonals of a template that lie at most `SLACK` apart are merged. A merged group
is a span if its votes cover enough of the template's windows and it isn't longer
than the template and the slack allow. Phrases have no slack and need every vote.

Votes are exact: beside its hash each window carries its words' numbers in the
templates' vocabulary, compared byte by byte, and both must be equal. k is 4, or
the length of a shorter template, so that common pairs of words vote for nothing.

The templates are a fixed, small list, so their windows are broadcast: windows of
texts pass the join where they are made and only hits are shuffled, dealt by row.

Defined cases: null text is empty; rows are told apart by themselves, whatever
their ids, so repeated and null ids give a row each; an empty table gives an
empty result; other columns are ignored; ids may have any type.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from millrace.runtime import bound_batches

WINDOW, SLACK, LEAST = 4, 8, 0.8
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False

    @property
    def words(self) -> list[str]:
        return WORD.findall(self.text.translate(_LOWER))

    @property
    def k(self) -> int:
        return min(WINDOW, len(self.words))

    @property
    def windows(self) -> int:
        return len(self.words) - self.k + 1

    @property
    def slack(self) -> int:
        return 0 if self.phrase else min(SLACK, len(self.words) // 4)

    @property
    def least(self) -> float:
        return 1.0 if self.phrase else LEAST


#: Phrases and their labels, then notices of public licenses. Fixed values.
TEMPLATES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
    Template("gpl-3.0", "this work is licensed under the gnu general public license, version 3."),
    Template("gpl-2.0", "this work is licensed under the gnu general public license, version 2."),
    Template("apache-2.0", "licensed under the apache license, version 2.0."),
    Template("cc-by-nc-4.0", "licensed under cc by-nc 4.0."),
    Template("cc-by-sa-4.0", "licensed under cc by-sa 4.0."),
    Template("cc-by-4.0", "licensed under cc by 4.0."),
    Template("mit-notice", "released under the mit license."),
    Template("gpl-header", "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version."),
    Template("gpl-warranty", "this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose."),
    Template("apache-header", "you may not use this file except in compliance with the license. you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0"),
    Template("apache-warranty", "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \"as is\" basis, without warranties or conditions of any kind, either express or implied."),
    Template("mit-grant", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"software\"), to deal in the software without restriction"),
    Template("bsd-terms", "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, you can obtain one at http://mozilla.org/mpl/2.0/."),
    Template("cc-deed", "this work is licensed under a creative commons attribution"),
    Template("gfdl", "permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license"),
)

_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)
#: What a byte of UTF-8 is in a word, A-Z lower-cased; 0 ends words.
_BYTE = np.array([b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0 for b in range(256)], dtype=np.uint8)
#: Bits of one word's number in a window's code.
_BITS = 15
_SLICE = 1 << 16


class Words:
    """Splits and hashes the words of many texts at once, on the bytes of all of them."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if n > len(self.up):
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, p, np.uint64))]) for p in (_P, _INVERSE))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, ends, hashes, words of each text): the polynomial hash of each word, from prefix sums."""
        low = _BYTE[data]
        self.powers(len(low) + 1)
        edge = np.zeros(len(low) + 1, bool)
        edge[offsets] = True
        inside = np.concatenate([[False], low != 0, [False]])
        starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        sums = np.concatenate([[np.uint64(0)], np.cumsum(low.astype(np.uint64) * self.up[: len(low)])])
        hashes = (sums[ends] - sums[starts]) * self.down[starts]
        hashes ^= hashes >> np.uint64(29)
        return low, starts, ends, hashes, np.diff(np.searchsorted(starts, offsets))


class Vocabulary:
    """Numbers, from 1, of the templates' words; 0 for any other word. Found by hash, decided by bytes."""

    def __init__(self, words: list[str]) -> None:
        held = sorted(set(words))
        if len(held) >= 1 << _BITS:
            raise ValueError(f"templates have {len(held)} different words, more than {(1 << _BITS) - 1}")
        raw = [w.encode() for w in held]
        data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        hashes = Words()(data, ends)[3]
        order = np.argsort(hashes)
        self.hashes, self.length = hashes[order], np.array([len(raw[i]) for i in order])
        self.bytes = np.zeros((len(held), max(self.length, default=1)), np.uint8)
        for row, i in enumerate(order):
            self.bytes[row, : len(raw[i])] = np.frombuffer(raw[i], np.uint8)

    def codes(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = np.flatnonzero((self.hashes[at] == hashes) & (self.length[at] == ends - starts))
        span = np.arange(self.bytes.shape[1])
        some = low[np.minimum(starts[found, None] + span, max(0, len(low) - 1))] * (span < (ends - starts)[found, None])
        same = found[(some == self.bytes[at[found]]).all(1)]
        out = np.zeros(len(starts), np.int64)
        out[same] = at[same] + 1
        return out


def windows(k: int, hashes: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, hash, code) of every window of k words within a text; the code is 0 if it has a foreign word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
    whole = first[:n] + k <= counts[text[:n]]
    gram, code, known = np.full(n, k, np.uint64), np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(k):
        gram = gram * _Q + hashes[i : n + i]
        code = code << _BITS | codes[i : n + i]
        known &= codes[i : n + i] > 0
    return text[:n][whole], first[:n][whole], gram[whole].view(np.int64), np.where(known, code, 0)[whole]


def template_windows(templates: tuple[Template, ...], vocabulary: Vocabulary) -> list[tuple[int, int, int, int]]:
    """(hash, code, template, position) of every window of the templates."""
    split, out = Words(), []
    for t, template in enumerate(templates):
        raw = template.text.encode()
        low, starts, ends, hashes, counts = split(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        _, first, gram, code = windows(template.k, hashes, vocabulary.codes(low, starts, ends, hashes), counts)
        out += zip(gram.tolist(), code.tolist(), [t] * len(gram), first.tolist(), strict=True)
    return out


def license_spans(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans) for each row; spans (label, phrase, start, end, score), words from 0, end exclusive.

    score is the part of the template's windows that the span covers.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    if not templates or any(not t.words for t in templates):
        raise ValueError("templates need words")
    vocabulary = Vocabulary([w for t in templates for w in t.words])
    sizes = sorted({t.k for t in templates})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Words()
        names = ["row", "at", "gram", "code", "doc_id"]
        for b in batches:
            texts = b.column(2).fill_null("").cast(pa.large_string())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            low, starts, ends, hashes, counts = split(data, offsets - offsets[0])
            codes = vocabulary.codes(low, starts, ends, hashes)
            rows, n = b.column(0).to_numpy(), len(texts)
            # A row for the document itself, with the code that the template "none" has.
            yield pa.record_batch([b.column(0), pa.array(counts.astype(np.int64)), pa.array(np.zeros(n, np.int64)), pa.array(np.full(n, -1, np.int64)), b.column(1)], names=names)
            for k in sizes:
                text, first, gram, code = windows(k, hashes, codes, counts)
                for i in range(0, len(text), _SLICE):
                    part = slice(i, i + _SLICE)
                    yield pa.record_batch([pa.array(rows[text[part]]), pa.array(first[part]), pa.array(gram[part]), pa.array(code[part]), pa.nulls(len(text[part]), b.column(1).type)], names=names)

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("row", "at", "gram", "code")] + [source.schema["doc_id"]])
    listed = spark.createDataFrame([(0, -1, -1, 0), *template_windows(templates, vocabulary)], "gram long, code long, template int, place int")
    hits = source.mapInArrow(scan, schema).join(F.broadcast(listed), ["gram", "code"]).repartition("row")

    # A diagonal's votes as bits of the template's windows, 64 to a block.
    votes = hits.groupBy("row", "template", F.when(F.col("template") >= 0, F.col("at") - F.col("place")).alias("diagonal"), F.floor(F.col("place") / 64).alias("block")).agg(
        F.expr("bit_or(shiftleft(1L, place % 64))").alias("bits"), F.min("at").alias("start"), F.max("at").alias("last"), F.first("doc_id", ignorenulls=True).alias("doc_id")
    )
    about = F.array(*[F.struct(F.lit(t.label).alias("label"), F.lit(t.phrase).alias("phrase"), F.lit(t.k).alias("k"), F.lit(t.windows).alias("windows"), F.lit(len(t.words) + 2 * t.slack).alias("longest"), F.lit(t.slack).alias("slack"), F.lit(t.least).alias("least")) for t in templates])
    known = votes.withColumn("t", F.when(F.col("template") >= 0, F.element_at(about, F.col("template") + 1)))
    by = W.partitionBy("row", "template").orderBy("diagonal")
    apart = known.withColumn("_new", (F.col("diagonal") - F.lag("diagonal").over(by) > F.col("t.slack")).cast("int"))
    merged = apart.withColumn("group", F.coalesce(F.sum("_new").over(by), F.lit(0)))
    blocks = merged.groupBy("row", "template", "t", "group", "block").agg(F.bit_count(F.expr("bit_or(bits)")).alias("covered"), F.min("start").alias("start"), F.max("last").alias("last"), F.first("doc_id", ignorenulls=True).alias("doc_id"))
    groups = blocks.groupBy("row", "template", "t", "group").agg(F.sum("covered").alias("covered"), F.min("start").alias("start"), F.max("last").alias("last"), F.first("doc_id", ignorenulls=True).alias("doc_id"))
    end = F.col("last") + F.col("t.k")
    verified = (F.col("covered") >= F.col("t.least") * F.col("t.windows")) & (end - F.col("start") <= F.col("t.longest"))
    span = F.struct(F.col("t.label").alias("label"), F.col("t.phrase").alias("phrase"), "start", end.alias("end"), (F.col("covered") / F.col("t.windows")).alias("score"))
    return groups.groupBy("row").agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), F.max(F.when(F.col("template") < 0, F.col("start"))).alias("n_words"), F.array_sort(F.collect_list(F.when(verified, span))).alias("spans")).drop("row")
