"""Language identification by a byte convolutional network, trained in numpy.

A byte has an embedding; filters of widths 2, 3 and 4 slide over a window of
256 bytes; each filter's largest response (max pooling) goes through a linear
layer to a softmax over the languages. A text's prediction adds up the
log-probabilities of all its windows, weighted by their bytes.

For scoring, embedding and filters are folded into tables over byte pairs, so
a convolution is a few table lookups. Training uses a bounded sample of
`per_language` labelled rows of each language, chosen by a hash of the id, and of
a row at most `most_windows` windows, chosen at random; scoring covers all windows.

Defined cases: text that is null or has no letter is `und` with score 0; of
languages that are equally likely the first by name is said; null ids
are never learned from and are predicted; repeated ids are predicted row by
row; without labelled rows everything is `und`; an empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.runtime import bound_batches, fresh

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
PER_LANGUAGE, FOLDS, HELD = 700, 4, 2
CHUNK = 128


def to_windows(data: bytes, size: int = WINDOW) -> np.ndarray:
    """The bytes in rows of `size`, the last one padded with zeros."""
    rows = -(-len(data) // size)
    return np.frombuffer(data.ljust(rows * size, b"\0"), dtype=np.uint8).reshape(rows, size)


@dataclass
class ByteCNN:
    languages: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]  # width x EMBED x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray  # FILTERS * widths x languages
    out_bias: np.ndarray

    @classmethod
    def start(cls, languages: list[str], rng: np.random.Generator) -> ByteCNN:
        f = [rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w, EMBED, FILTERS)) for w in WIDTHS]
        return cls(languages, rng.normal(0, 0.5, (256, EMBED)), f, [np.zeros(FILTERS) for _ in WIDTHS], rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))), np.zeros(len(languages)))

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.out, self.out_bias]

    def tables(self) -> list[list[np.ndarray]]:
        """For each width the tables whose lookups add up to the convolution: pairs of bytes, then a single one."""
        made = []
        for f, b in zip(self.filters, self.bias, strict=True):
            taps = [(self.embed @ f[k]).astype(np.float32) for k in range(len(f))]
            taps[0] = taps[0] + b.astype(np.float32)
            made.append([(taps[k][:, None] + taps[k + 1][None]).reshape(-1, FILTERS) for k in range(0, len(taps) - 1, 2)] + ([taps[-1]] if len(taps) % 2 else []))
        return made

    def pooled(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Largest responses (rows x FILTERS * widths) and the positions they are at."""
        byte = np.ascontiguousarray(x.T).astype(np.int32)
        pair = byte[:-1] * 256 + byte[1:]
        best, at = [], []
        for w, tabs in zip(WIDTHS, tables, strict=True):
            n = WINDOW - w + 1
            r = tabs[0].take(pair[:n], axis=0)
            for k, t in enumerate(tabs[1:], 1):
                r += t.take(pair[2 * k : 2 * k + n] if len(t) > 256 else byte[2 * k : 2 * k + n], axis=0)
            best.append(r.max(axis=0))
            at.append(r)
        return np.concatenate(best, axis=1), at

    def log_probabilities(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        out = np.empty((len(x), len(self.languages)))
        for i in range(0, len(x), CHUNK):
            h, _ = self.pooled(x[i : i + CHUNK], tables)
            z = np.maximum(h, 0) @ self.out + self.out_bias
            z -= z.max(1, keepdims=True)
            out[i : i + CHUNK] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        h, raw = self.pooled(x, self.tables())
        a = np.maximum(h, 0)
        z = a @ self.out + self.out_bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        dh = (p @ self.out.T) * (h > 0)
        d_embed, d_filters, d_bias = np.zeros_like(self.embed), [], []
        for k, (w, r) in enumerate(zip(WIDTHS, raw, strict=True)):
            g = dh[:, k * FILTERS : (k + 1) * FILTERS]
            pos = r.argmax(axis=0)  # rows x FILTERS
            d = np.zeros_like(self.filters[k])
            for tap in range(w):
                b = x[np.arange(len(x))[:, None], pos + tap]  # the byte under this tap at the maximum
                d[tap] = np.einsum("nf,nfe->ef", g, self.embed[b])
                np.add.at(d_embed, b.ravel(), (g[:, :, None] * self.filters[k][tap].T[None]).reshape(-1, EMBED))
            d_filters.append(d)
            d_bias.append(g.sum(0))
        return [d_embed, *d_filters, *d_bias, a.T @ p, p.sum(0)]


def train(windows: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 42) -> ByteCNN:
    """Adam on the cross-entropy of single windows."""
    rng = np.random.default_rng(seed)
    net = ByteCNN.start(languages, rng)
    m, v, t = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()], 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            part = order[i : i + batch]
            t += 1
            for p, g, a, b in zip(net.parameters(), net.gradients(windows[part], y[part]), m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return net


def fit_language(docs: DataFrame, per_language: int = PER_LANGUAGE, most_windows: int = 4, seed: int = 42) -> ByteCNN | None:
    """Trained on labelled docs (doc_id, text, lang) whose crc32(doc_id) mod 4 is not 2."""
    known = docs.where("doc_id is not null and lang is not null and text is not null").where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(share)
    some = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < share * 1_000_000).select("text", "lang").toArrow()
    rng, languages = np.random.default_rng(seed), sorted(counts)
    xs, ys = [], []
    for t, lang in zip(some["text"].to_pylist(), some["lang"].to_pylist(), strict=True):
        w = to_windows(t.encode())
        w = w[rng.permutation(len(w))[:most_windows]]
        xs.append(w)
        ys += [languages.index(lang)] * len(w)
    return train(np.concatenate(xs), np.array(ys), languages) if ys else None


def predict_language(docs: DataFrame, net: ByteCNN | None, text_col: str = "text") -> DataFrame:
    """docs with `lang_pred` and `lang_score` (replaced if they are there)."""
    bound_batches(docs.sparkSession)
    held: dict[str, list] = {}  # tables are made once in each task

    @F.arrow_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(text: pa.Array) -> pa.Array:
        langs, scores, todo, rows, sizes = [], [], [], [], []
        for i, t in enumerate(text.to_pylist()):
            langs.append("und")
            scores.append(0.0)
            if net and t and any(map(str.isalpha, t)):
                data = t.encode()
                todo.append((i, len(data)))
                rows.append(to_windows(data))
                sizes.append(len(rows[-1]))
        if todo:
            if not held:
                held["tables"] = net.tables()
            lp, at = net.log_probabilities(np.concatenate(rows), held["tables"]), 0
            for (i, n), k in zip(todo, sizes, strict=True):
                weight = np.full(k, float(WINDOW))
                weight[-1] = n - (k - 1) * WINDOW
                mean = (lp[at : at + k] * weight[:, None]).sum(0) / n
                at += k
                p = np.exp(mean - mean.max())
                p /= p.sum()
                langs[i], scores[i] = net.languages[int(p.argmax())], float(p.max())
        return pa.StructArray.from_arrays([pa.array(langs), pa.array(scores, pa.float64())], names=["lang", "score"])

    own = [c for c in docs.columns if c.lower() not in ("lang_pred", "lang_score")]
    said = fresh("said", docs)
    out = docs.select(*own, predict(F.col(text_col)).alias(said))
    return out.select(*own, F.col(said)["lang"].alias("lang_pred"), F.col(said)["score"].alias("lang_score"))
