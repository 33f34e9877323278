"""Packing documents into fixed-length sequences by cutting-stock column generation.

A document is cut into full sequences and one rest. The rests of a block of
documents are one cutting-stock problem: their lengths, in units of `unit`
tokens, make a histogram; a linear program over patterns (multisets of lengths
that fit a sequence) covers it with the fewest sequences; its columns are
priced by knapsack dynamic programming over the duals; the solution is rounded
down, topped up by its largest fractions, and the patterns take the documents
of each length by rank (longest first, then by position). What rounding leaves
goes best-fit into sequences, and rests of `filler` tokens or less fill slack.

A block is what one task reads, up to `block_tokens`; it is solved where it is
read. So there is no shuffle, no state between tasks and nothing to collect,
and memory is bounded by the block. Sequence ids hold the partition's number.

Defined cases: null text is empty and gives the end id alone; null or repeated
doc_ids are packed row by row; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.runtime import bound_batches

CAPACITY, UNIT, FILLER, END_ID = 2048, 16, 48, 1
BLOCK_TOKENS = 12_000_000
CACHE_WORDS = 300_000
GROUP_CHARS = 2_000_000


class WordEncoder:
    """Encodes texts with a tokenizer that never joins tokens over white space.

    Chunks between spaces and newlines are encoded once and kept in two
    generations of `limit` / 2: a full young one becomes the old one, and what
    is met again moves up, so frequent words stay and memory is bounded.
    Whether the tokenizer ignores case and cuts punctuation off letters is
    probed once; only then is a text lower-cased and cut there beforehand, and
    only where that can't reach beyond a chunk: lower-casing in texts without
    characters over U+012F, cuts behind letters and digits up to there, which
    neither compose with what follows nor lower-case to several characters.
    Texts that hold the beginning of an added token go to the tokenizer whole,
    as such tokens are looked for before case is folded.
    Where the vocabulary marks word ends, new words are encoded many at a time
    and told apart by those marks.
    """

    _WIDE = re.compile("[^\x00-\u012f]")
    _PLAIN = "0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f"
    _COMMA, _STOP = re.compile(f",(?<=[{_PLAIN}],)"), re.compile(rf"\.(?<=[{_PLAIN}]\.)")
    _TAIL = re.compile(f"[!?$*%&#;:](?<=[{_PLAIN}].)")  # not the characters of special tokens, nor apostrophes

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.limit = Tokenizer.from_file(path), limit
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        ids = lambda s: self.tok.encode(s, add_special_tokens=False).ids
        probes = ["thereof", "Ing", "QUEUE", "a", "zzkrq", "É", "ßen"]
        self.folds = all(ids(p) == ids(p.lower()) for p in probes)
        self.cuts = all(ids(p + t) == ids(p) + ids(t) for p in probes for t in ",.!?$*%&#;:")
        if ids("ab cd\nef") != ids("ab") + ids("cd") + ids("ef"):
            raise ValueError("this tokenizer's ids depend on white space; chunks can't be encoded alone")
        self.added = {t.content[:2] for t in self.tok.get_added_tokens_decoder().values()}
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True

    def _learn(self, new: list[str], group: int = 64) -> dict[str, bytes]:
        """The ids of words not kept."""
        out: dict[str, bytes] = {}
        words = [w for w in new if w.isalpha() and not self._WIDE.search(w)] if self.ends.any() else []
        groups = [words[i : i + group] for i in range(0, len(words), group)]
        alone = list(set(new) - set(words))
        for g, e in zip(groups, self.tok.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            cut = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cut) != len(g):
                alone += g
                continue
            data = ids.tobytes()
            for w, a, b in zip(g, [0, *cut], cut, strict=False):
                out[w] = data[a:b]
        for w, e in zip(alone, self.tok.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            out[w] = np.array(e.ids, dtype="<u4").tobytes()
        return out

    def _plain(self, text: str) -> str:
        if self.folds and (text.isascii() or not self._WIDE.search(text)):
            text = text.lower()
        if self.cuts:
            text = self._TAIL.sub(r" \g<0>", self._STOP.sub(" .", self._COMMA.sub(" ,", text)))
        return text.replace("\n", " ")

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        Each distinct chunk of the group is looked up once; the ids are gathered by chunk numbers.
        """
        if not texts:
            return []
        odd = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        if odd:
            whole = dict(zip(odd, self.tok.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False), strict=True))
            rest = iter(self.many([t for i, t in enumerate(texts) if i not in whole]))
            return [np.array(whole[i].ids, dtype="<u4").tobytes() if i in whole else next(rest) for i in range(len(texts))]
        split = pc.split_pattern(pa.array(list(map(self._plain, texts)), pa.string()), " ")
        coded = split.values.dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        ids = list(map(self.young.get, words))
        new = [w for w, x in zip(words, ids, strict=True) if x is None]
        fresh = {w: x for w, x in zip(new, map(self.old.get, new), strict=True) if x is not None}
        fresh |= self._learn([w for w in new if w not in fresh])
        ids = [fresh[w] if x is None else x for w, x in zip(words, ids, strict=True)]
        self.young |= fresh
        if len(self.young) > self.limit // 2:
            self.young, self.old = {"": b""}, self.young
        pool = np.frombuffer(b"".join(ids), dtype="<u4")
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        n = size[codes]
        upto = np.zeros(len(n) + 1, np.int32)
        np.cumsum(n, out=upto[1:])
        place = np.repeat((np.cumsum(size, dtype=np.int32) - size)[codes] - upto[:-1], n)
        place += np.arange(upto[-1], dtype=np.int32)
        flat = pool[place].tobytes()
        bounds = (4 * upto[split.offsets.to_numpy()].astype(np.int64)).tolist()
        return [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def forget(self) -> None:
        """Drop the kept words: a worker that waits for other stages shall hold no memory."""
        self.young, self.old = {"": b""}, {}
        pa.default_memory_pool().release_unused()

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def price(sizes: np.ndarray, value: np.ndarray, cap: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the best value and how many of each size it takes."""
    best, pick = np.zeros(cap + 1), np.full(cap + 1, -1)
    fits = np.searchsorted(sizes, np.arange(cap + 1), "right")
    for c in range(int(sizes[0]), cap + 1):
        k = fits[c]
        v = value[:k] + best[c - sizes[:k]]
        i = int(v.argmax())
        if v[i] > best[c - 1] + 1e-12:
            best[c], pick[c] = v[i], i
        else:
            best[c] = best[c - 1]
    count, c = np.zeros(len(sizes)), cap
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            count[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(best[cap]), count


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, cap: int, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, x): the LP's basic columns and their amounts, by revised simplex.

    sizes ascend, each at most cap. Stops at the optimum, or after `rounds`
    pivots with a feasible solution that is not proved optimal.
    """
    m = len(sizes)
    first = (cap // sizes).astype(float)
    basis, inverse, x = np.diag(first), np.diag(1 / first), demand / first
    for _ in range(rounds or 20 * m):
        value, column = price(sizes, inverse.sum(0), cap)
        if value <= 1 + 1e-7:
            break
        d = inverse @ column
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        r = int(ratio.argmin())
        if not np.isfinite(ratio[r]):
            break
        step = ratio[r]
        x = np.maximum(x - step * d, 0)
        x[r] = step
        basis[:, r] = column
        row = inverse[r] / d[r]
        inverse = inverse - np.outer(d, row)
        inverse[r] = row
    return basis.T, x


def pack(lengths: np.ndarray, cap: int = CAPACITY, unit: int = UNIT, filler: int = FILLER) -> list[list[int]]:
    """Positions of `lengths` (each 1 to cap) dealt into sequences of at most cap."""
    lengths = np.asarray(lengths)
    bins: dict[int, list[int]] = {}
    small = lengths <= filler
    for i in np.lexsort((-np.arange(len(lengths)), lengths)).tolist():  # popped from the end: longest, then first
        if not small[i]:
            bins.setdefault(-(-int(lengths[i]) // unit), []).append(i)
    out: list[list[int]] = []
    if bins:
        sizes = np.array(sorted(bins))
        demand = np.array([len(bins[s]) for s in sizes.tolist()], dtype=float)
        patterns, x = cutting_stock(sizes, demand, cap // unit)
        whole = np.floor(x + 1e-6).astype(int)
        turns = [(p, n) for p, n in zip(patterns, whole, strict=True) if n] + [(patterns[k], 1) for k in np.argsort(whole - x) if x[k] - whole[k] > 0.3]
        for p, n in turns:
            need = [(bins[int(sizes[k])], int(p[k])) for k in np.flatnonzero(p)]
            for _ in range(n):
                if any(len(b) < c for b, c in need):
                    break
                out.append([b.pop() for b, c in need for _ in range(c)])
    rest = sorted((i for b in bins.values() for i in b), key=lambda i: (-lengths[i], i))
    rest += sorted(np.flatnonzero(small).tolist(), key=lambda i: (-lengths[i], i))
    room = sorted((cap - int(lengths[s].sum()), k) for k, s in enumerate(out))
    for i in rest:
        n = int(lengths[i])
        at = bisect_left(room, (n, -1))
        if at == len(room):
            out.append([i])
            insort(room, (cap - n, len(out) - 1))
        else:
            left, k = room.pop(at)
            out[k].append(i)
            insort(room, (left - n, k))
    return out


def groups(batches: Iterator[pa.RecordBatch], chars: int = GROUP_CHARS) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of so many rows that they hold about `chars` characters; null texts are empty."""
    ids, texts, held = [], [], 0
    for b in batches:
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids.append(d)
            texts.append(t or "")
            held += len(texts[-1])
            if held >= chars:
                yield ids, texts
                ids, texts, held = [], [], 0
    yield ids, texts


PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", cap: int = CAPACITY, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS, out_rows: int = 500) -> DataFrame:
    """(doc_id, start, ids, doc_tokens, sequence_id, offset): one row for each piece.

    ids are little-endian unsigned 32-bit integers; start counts the
    document's ids before the piece, offset the sequence's.
    """
    bound_batches(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, made = encoder(tokenizer_path), TaskContext.get().partitionId() << 40, 0
        docs_of, ids_of, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            rest = [(k, len(x) // 4 // cap * cap) for k, x in enumerate(ids_of) if len(x) // 4 % cap]
            dealt = pack(np.array([len(ids_of[k]) // 4 - s for k, s in rest], dtype=np.int64), cap) if rest else []
            full = ([(k, s)] for k, x in enumerate(ids_of) for s in range(0, len(x) // 4 // cap * cap, cap))
            rows: list[tuple] = []
            for sequence in (g for h in (full, ([rest[i] for i in s] for s in dealt)) for g in h):
                offset = 0
                for k, s in sequence:
                    piece = ids_of[k][4 * s : 4 * (s + cap)]
                    rows.append((docs_of[k], s, piece, len(ids_of[k]) // 4, part + made, offset))
                    offset += len(piece) // 4
                made += 1
                if len(rows) >= out_rows:
                    yield batch(rows)
                    rows = []
            yield batch(rows)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.record_batch([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=PIECES.names)

        for ids_, texts in groups(batches):
            for d, ids in zip(ids_, encode.many(texts), strict=True):
                ids += end
                docs_of.append(d)
                ids_of.append(ids)
                held += len(ids) // 4
                if held >= block_tokens:
                    yield from flush()
                    docs_of, ids_of, held = [], [], 0
        encode.forget()
        yield from flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(solve, PIECES)
