"""LM scoring: subword lattice likelihood, backed by corpus word counts.

A word's lattice holds all its segmentations into pieces of an existing
vocabulary; the vocabulary's scores give the pieces' probabilities (ranks, as a
merge vocabulary has them, become Zipf-Mandelbrot probabilities), and the
forward recursion in log space adds up all segmentations to the word's
marginal probability. Two rounds of EM over the distinct words of the corpus fit
the pieces' probabilities to it; the vocabulary itself stays as it is. Words of
the corpus interpolate with the lattice (Witten-Bell):

    p(w) = c(w) / (N + V) + V / (N + V) * p_lattice(w)

where c, N and V are counts over all training documents. The lattice runs once
for each distinct word of the corpus. Frequent words, at most `hot`, are scored
where documents are read; the others meet their counts in a join.

Base score: the sum over tokens of log10((c + 0.1) / (N + 0.1 * (V + 1))).

Tokens are the words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, then one end.

Defined cases: null text is the end alone; documents with a null id are scored
and not learned from; repeated ids are scored row by row and learned from row by
row; without training documents the lattice alone counts; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import crc_mod, words
from millrace.runtime import bound_batches, materialize

FOLDS, HOT_WORDS, FLUSH, ROUNDS, PART_ROWS = 10, 200_000, 300_000, 2, 50_000
#: The end of a document as a token; no word holds white space.
END = "\n"
LN10 = log(10)


class Lattice:
    """Marginal log-probabilities of words over a piece vocabulary, many words at a time.

    Words of a length are a matrix of code points. A rolling hash of every
    substring finds its piece in an open-addressed table, and the recursions
    run over positions, for all the words at once.
    """

    MARK, BASE, MIX = "▁", np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

    def __init__(self, model_path: str, offset: float = 2.7):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        use = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        scores = np.array([sp.get_score(i) for i in use])
        raw = -np.log(offset - scores) if (scores == np.floor(scores)).all() else scores
        self.pieces = [sp.id_to_piece(i) for i in use]
        self.longest = max(map(len, self.pieces), default=1)
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, self.BASE)]), dtype=np.uint64)
        self._place()
        self.set(np.exp(raw))

    def set(self, weight: np.ndarray) -> None:
        """Piece probabilities from weights; one part in 10^4 goes to bytes, for what no piece covers."""
        self.lp = np.append(np.log(weight / weight.sum() * (1 - 1e-4)), -np.inf)
        self.byte = log(1e-4) - log(256)

    def _place(self) -> None:
        size = 1 << (2 + len(self.pieces) * 2).bit_length()
        self.keys, self.ids, self.mask = np.zeros(size, np.uint64), np.full(size, -1, np.int32), size - 1
        for i, piece in enumerate(self.pieces):
            h = int(self._prefixes(np.array([[ord(c) for c in piece]], np.uint64))[0, -1])
            at = (h * int(self.MIX) & 0xFFFFFFFFFFFFFFFF) >> 40 & self.mask
            while self.ids[at] >= 0:
                at = at + 1 & self.mask
            self.keys[at], self.ids[at] = h, i

    def _prefixes(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        for k in range(codes.shape[1]):
            out[:, k + 1] = out[:, k] * self.BASE + codes[:, k]
        return out

    def _find(self, h: np.ndarray) -> np.ndarray:
        at = (h * self.MIX >> np.uint64(40)).astype(np.int64) & self.mask
        found = np.where(self.keys[at] == h, self.ids[at], -1)
        open_ = np.flatnonzero((found < 0).ravel() & (self.ids[at] >= 0).ravel())
        h, at = h.ravel(), at.ravel()
        flat = found.ravel()
        while len(open_):
            at[open_] = at[open_] + 1 & self.mask
            hit = self.keys[at[open_]] == h[open_]
            flat[open_[hit]] = self.ids[at[open_[hit]]]
            open_ = open_[~hit & (self.ids[at[open_]] >= 0)]
        return flat.reshape(found.shape)

    def _groups(self, words: list[str], most: int = 400_000) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
        """(rows, piece ids by length and start, byte costs of characters) of words of one length."""
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w) + 1, []).append(i)
        for n, rows in by.items():
            for lo in range(0, len(rows), max(1, most // n)):
                part = rows[lo : lo + max(1, most // n)]
                text = "".join([self.MARK + words[i] for i in part])
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n).astype(np.uint64)
                pre = self._prefixes(codes)
                ids = [self._find(pre[:, k:] - pre[:, :-k] * self.powers[k]) for k in range(1, min(self.longest, n) + 1)]
                bytes_ = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
                yield np.array(part), ids, bytes_ * self.byte

    def _forward(self, ids: list[np.ndarray], cost: np.ndarray) -> np.ndarray:
        m, n = cost.shape
        alpha = np.full((m, n + 1), -np.inf)
        alpha[:, 0] = 0
        for e in range(1, n + 1):
            terms = [alpha[:, e - k] + self.lp[ids[k - 1][:, e - k]] for k in range(1, min(len(ids), e) + 1)]
            terms = np.stack([alpha[:, e - 1] + cost[:, e - 1], *terms])
            best = terms.max(0)
            alpha[:, e] = best + np.log(np.exp(terms - best).sum(0))
        return alpha

    def marginals(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's probability over all its segmentations; END has the least piece's."""
        out = np.empty(len(words))
        for rows, ids, cost in self._groups(words):
            out[rows] = self._forward(ids, cost)[:, -1]
        out[[i for i, w in enumerate(words) if w == END]] = self.lp[:-1].min()
        return out

    def expected(self, words: list[str]) -> np.ndarray:
        """Expected count of each piece over all segmentations, each word counting once."""
        total = np.zeros(len(self.pieces) + 1)
        for _, ids, cost in self._groups([w for w in words if w != END]):
            m, n = cost.shape
            alpha, beta = self._forward(ids, cost), np.full((m, n + 1), -np.inf)
            beta[:, n] = 0
            for s in range(n - 1, -1, -1):
                terms = [beta[:, s + k] + self.lp[ids[k - 1][:, s]] for k in range(1, min(len(ids), n - s) + 1)]
                terms = np.stack([beta[:, s + 1] + cost[:, s], *terms])
                best = terms.max(0)
                beta[:, s] = best + np.log(np.exp(terms - best).sum(0))
            for k, found in enumerate(ids, 1):
                gain = np.exp(alpha[:, : n - k + 1] + self.lp[found] + beta[:, k:] - alpha[:, -1:])
                total += np.bincount(found.ravel() % len(total), weights=gain.ravel(), minlength=len(total))
        return total[:-1]


_lattices: dict[str, Lattice] = {}


def lattice(path: str, weight: np.ndarray | None = None) -> Lattice:
    """One lattice for each worker process and file, with the given piece weights."""
    if path not in _lattices:
        _lattices[path] = Lattice(path)
        _lattices[path].first = np.exp(_lattices[path].lp[:-1])
    _lattices[path].set(_lattices[path].first if weight is None else weight)
    return _lattices[path]


def _rows(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS) -> DataFrame:
    """(word, c): every distinct token of the corpus and its count in training documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = _rows({"word": (list(seen.keys()), pa.binary()), "c": (list(seen.values()), pa.int64())})
            seen.clear()
            return out.set_column(0, "word", out.column(0).cast(pa.string()))

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words(t)
                if d is not None and crc_mod(d, folds):
                    seen.update(w)
                    seen[END.encode()] += 1
                else:
                    seen.update(dict.fromkeys(w, 0))
                if len(seen) > FLUSH:
                    yield flush()
        yield flush()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 40_000, size: int = 8_000_000) -> Iterator[pa.Table]:
    """Batches joined until they hold so many rows or bytes: the recursions run over all words of a length at once."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows or sum(x.nbytes for x in held) >= size:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def adapted_weights(counts: DataFrame, model_path: str, rounds: int = ROUNDS, prior: float = 2000.0) -> np.ndarray:
    """Piece weights after EM from the vocabulary's scores, each distinct training word counting once.

    Counting types and not tokens fits the lattice to new words, which is what
    it stands for beside the counts. The scores stay in as `prior` pieces.
    """
    start = np.exp(lattice(model_path).lp[:-1])
    weight = start
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], weight: np.ndarray = weight) -> Iterator[pa.RecordBatch]:
            net, total = lattice(model_path, weight), 0
            for b in gathered(batches):
                total = total + net.expected(b.column(0).to_pylist())
            if not isinstance(total, int):
                at = np.flatnonzero(total)
                yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["piece", "n"])

        got = counts.where("c > 0").select("word").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        rows = got.toArrow()  # at most one row for each piece of the vocabulary
        total = np.zeros(len(start))
        total[rows["piece"].to_numpy()] = rows["n"].to_numpy()
        weight = total + prior * start
    return weight


def weigh_words(counts: DataFrame, model_path: str, weight: np.ndarray) -> DataFrame:
    """counts with lp, the word's log-probability in the lattice."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = lattice(model_path, weight)
        for b in gathered(batches):
            yield from pa.table({"word": b["word"], "c": b["c"], "lp": pa.array(net.marginals(b["word"].to_pylist()))}).combine_chunks().to_batches()

    return counts.mapInArrow(weigh, "word string, c long, lp double")


def hot_words(counts: DataFrame, most: int = HOT_WORDS) -> dict[bytes, tuple[int, float]]:
    """word -> (c, lp) of the most frequent words: as many whole levels of frequency as give at most `most`."""
    level = F.when(F.col("c") > 0, F.floor(F.log2("c") * 8)).otherwise(-1).cast("int").alias("level")
    sizes = sorted(((r["level"], r["n"]) for r in counts.groupBy(level).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = None, 0
    for at, n in sizes:  # one row for each eighth of a power of two
        total += n
        if total > most or at < 0:
            break
        least = at
    if least is None:
        return {}
    rows = counts.withColumn("level", level).where(F.col("level") >= least).select("word", "c", "lp").toArrow()
    return {w.encode(): (c, lp) for w, c, lp in zip(rows["word"].to_pylist(), rows["c"].to_pylist(), rows["lp"].to_pylist(), strict=True)}


def score_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT_WORDS, folds: int = FOLDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score), a row for each row of docs.

    lattice_score is the log10 probability by the lattice alone; in score, counts
    of words interpolate with it, so it decides for rare and unknown words.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    seen = materialize(word_counts(docs, id_col, text_col, folds), "lm-counts")
    counts = materialize(weigh_words(seen, model_path, adapted_weights(seen, model_path)), "lm-words")
    t = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = t["n"], t["v"]
    floor = n + 0.1 * (v + 1)
    table = {}
    for w, (c, lp) in hot_words(counts, hot).items():
        p = (c + v * exp(lp)) / (n + v) if n else exp(lp)
        table[w] = (int(c > 0), log((c + 0.1) / floor) / LN10, log(p) / LN10 if p > 0 else lp / LN10, lp / LN10)
    known = spark.sparkContext.broadcast(table)  # at most `hot` words

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each document with the sums over frequent words, and one for each other word of it."""
        part, row, get = TaskContext.get().partitionId() << 40, 0, known.value.get
        names = ("key", "doc", "word", "tf", "n_tokens", "n_known", "base", "score", "pieces")
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())

        def rows(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            batch = pa.record_batch([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names=names)
            return batch.set_column(2, "word", batch.column(2).cast(pa.string()))

        for b in batches:
            out: list[tuple] = []
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                key, row = part + row, row + 1
                tf = Counter(words(text))
                tf[END.encode()] += 1
                n_known, base, score, pieces = 0, 0.0, 0.0, 0.0
                for w, k in tf.items():
                    hit = get(w)
                    if hit is None:
                        out.append((key, None, w, k, 0, 0, 0.0, 0.0, 0.0))
                        if len(out) >= PART_ROWS:
                            yield rows(out)
                            out = []
                    else:
                        n_known += k * hit[0]
                        base += k * hit[1]
                        score += k * hit[2]
                        pieces += k * hit[3]
                out.append((key, d, None, 0, sum(tf.values()), n_known, base, score, pieces))
            yield rows(out)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    parts = materialize(narrow.mapInArrow(first, "key long, doc long, word string, tf long, n_tokens long, n_known long, base double, score double, pieces double"), "lm-parts")
    rare = parts.where("word is not null").select("key", "word", "tf").join(counts, "word")
    p = (F.col("c") + v * F.exp("lp")) / (n + v) if n else F.exp("lp")
    model = F.when(p > 0, F.log10(p)).otherwise(F.col("lp") / LN10)
    sums = rare.groupBy("key").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("more_known"),
        F.sum(F.col("tf") * F.log10((F.col("c") + 0.1) / floor)).alias("more_base"),
        F.sum(F.col("tf") * model).alias("more_score"),
        F.sum(F.col("tf") * F.col("lp") / LN10).alias("more_pieces"),
    )
    heads = parts.where("word is null").drop("word", "tf")
    zero = lambda c, x: F.coalesce(F.col(c), F.lit(x))
    return heads.join(sums, "key", "left").select(
        F.col("doc").alias("doc_id"),
        (F.crc32(F.col("doc").cast("string")) % folds == 0).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + zero("more_known", 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base", 0.0)).alias("base_score"),
        (F.col("score") + zero("more_score", 0.0)).alias("score"),
        (F.col("pieces") + zero("more_pieces", 0.0)).alias("lattice_score"),
    )
