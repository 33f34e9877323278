"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon maps each word of a clause to a class: insult, threat, target,
negation, reported speech, or nothing. Five transducers read the classes:
the insult and the threat transducer turn their words into matches and pay
`insult` or `threat`; the negation and the reporting transducer remember that
such a word stood before and pay `negated` or `reported` for a match that
follows; the target transducer pays `target` once a match and a target stand in
one clause, in either order. `compose` joins them into one machine, whose best
path (tropical semiring) weighs the clause; a clause never weighs less than
nothing. A document's log-odds are a bias and the weights of its matched
clauses. Clauses without an insult or a threat can't match, so only clauses
around such words are read word by word; these words are searched in the whole
text.

What the arcs pay is fitted to labelled texts by penalised maximum likelihood
around DEFAULT, within bounds that keep the grammar's order: a match adds, a
target adds to it, negation and report take from it. Insults are learned as
stems, beginnings that toxic lines share and clean lines lack by a
likelihood-ratio test over all beginnings in question, as long as nearly all
their lines agree, so that unseen endings match. Equal and similar lines (one
of three pairs of min-hashes of their three-word shingles agrees) count once, so
copies aren't more evidence. Weights are fitted with stems learned on the other
half of the rows.

Bounds, which are parameters: stems are learned from about `max_toxic` toxic and
`max_clean` clean labelled rows, weights from about `max_fit` labelled rows at
their natural shares, all chosen by a hash of the id. Scoring covers every
whole text.

Defined cases: null or empty text matches nothing and gets the bias alone;
null ids are never learned from and are scored; repeated ids are scored row by
row, and their largest label is learned; without labels of both classes the
seed lexicon and fixed weights are used; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import sys
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from millrace.runtime import bound_batches, fresh

MAX_TOXIC, MAX_CLEAN, MAX_FIT, FOLDS = 1500, 4500, 60_000, 5
SHORTEST, LONGEST = 3, 14

#: Words of the lexicon besides learned insults. Fixed values.
INSULT = frozenset("idiot moron stupid scum worthless pathetic loser".split())
THREAT = frozenset("kill killing hurt destroy shoot stab beat burn attack punish töten umbringen tuer frapper matar golpear".split())
TARGET = frozenset("you your yours u he she they them him her his their this that these those who du dich dir dein ihr euch sie er tu te toi ton vous votre il elle ils tú ti vosotros usted él ella ellos".split())
NEGATION = frozenset("not never no nor isn aren wasn don doesn didn won cannot nicht kein keine nie pas jamais aucun nunca jamás ni".split())
REPORT = frozenset("said says say called calls wrote writes quoted claimed claims reported according sagte sagt schrieb dit écrit selon dijo dice escribió según".split())

#: What arcs pay, what they pay without labels (first the bias), and the bounds that keep the grammar's order.
PAID = ("insult", "threat", "target", "negated", "reported")
DEFAULT = (-3.0, 2.0, 2.0, 0.5, -1.0, -1.0)
LOWEST = np.array([-np.inf, 0.2, 0.2, 0.1, -np.inf, -np.inf])
HIGHEST = np.array([np.inf, np.inf, np.inf, np.inf, -0.1, -0.1])

#: Word classes that the lexicon gives (i, h, t, n, r) and matches that transducers write (I, H).
ALPHABET = "ihtnrIH"
#: Words whose class is given; these are never insults.
CLOSED = {w: k for k, words in (("t", TARGET), ("r", REPORT), ("n", NEGATION), ("h", THREAT)) for w in words}

_WORD = re.compile(r"[^\W\d_]+")
_BOUND = re.compile(r"[.!?;:\n]")


@dataclass(frozen=True)
class Transducer:
    """States from 0 (start), all final; arcs[state][symbol] = ((written, what is paid, next state), ...)."""

    arcs: tuple[dict[str, tuple[tuple[str, tuple[int, ...], int], ...]], ...]

    def best(self, symbols: str, weights: tuple[float, ...]) -> tuple[float, tuple[int, ...]]:
        """Weight of the best path over `symbols` and how often it pays each of PAID."""
        zero = (0,) * len(PAID)
        at = {0: (0.0, zero)}
        for s in symbols:
            then: dict[int, tuple[float, tuple[int, ...]]] = {}
            for state, (weight, paid) in at.items():
                for _, pays, nxt in self.arcs[state].get(s, ()):
                    w, p = weight, list(paid)
                    for k in pays:
                        w += weights[1 + k]
                        p[k] += 1
                    if nxt not in then or (w, tuple(p)) > then[nxt]:
                        then[nxt] = (w, tuple(p))
            at = then
        return max(at.values(), default=(-math.inf, zero))


def transducer(*states: dict[str, tuple[str, tuple[str, ...], int]]) -> Transducer:
    """From each state's particular arcs; it passes every other symbol on and stays."""
    return Transducer(tuple({s: ((lambda w, p, n: (w, tuple(PAID.index(x) for x in p), n))(*arcs[s]),) if s in arcs else ((s, (), k),) for s in ALPHABET} for k, arcs in enumerate(states)))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine whose paths are pairs of paths, what `first` writes being what `second` reads."""
    number, queue, arcs = {(0, 0): 0}, [(0, 0)], []
    for a, b in queue:
        out: dict[str, list] = {}
        for s, mine in first.arcs[a].items():
            for mid, paid, a2 in mine:
                for written, paid2, b2 in second.arcs[b].get(mid, ()):
                    if (a2, b2) not in number:
                        number[a2, b2] = len(number)
                        queue.append((a2, b2))
                    out.setdefault(s, []).append((written, paid + paid2, number[a2, b2]))
        arcs.append({s: tuple(x) for s, x in out.items()})
    return Transducer(tuple(arcs))


CASCADE = (
    transducer({"i": ("I", ("insult",), 0)}),
    transducer({"h": ("H", ("threat",), 0)}),
    transducer({"n": ("n", (), 1)}, {"I": ("I", ("negated",), 1), "H": ("H", ("negated",), 1)}),
    transducer({"r": ("r", (), 1)}, {"I": ("I", ("reported",), 1), "H": ("H", ("reported",), 1)}),
    # nothing yet, a match, a target, both
    transducer({"I": ("I", (), 1), "H": ("H", (), 1), "t": ("t", (), 2)}, {"t": ("t", ("target",), 3)}, {"I": ("I", ("target",), 3), "H": ("H", ("target",), 3)}, {}),
)


@lru_cache(1)
def grammar_machine() -> Transducer:
    machine = CASCADE[0]
    for t in CASCADE[1:]:
        machine = compose(machine, t)
    return machine


@dataclass(frozen=True)
class Grammar:
    """The lexicon's insults (beginnings, whole words) and what the composed machine's arcs pay."""

    stems: frozenset[str] = frozenset()
    words: frozenset[str] = frozenset()
    weights: tuple[float, ...] = DEFAULT

    def reader(self) -> Reader:
        return _reader(self)

    def score(self, text: str | None) -> float:
        return logistic(self.reader().read(text)[0])


def logistic(logit: float) -> float:
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, logit))))


class Reader:
    """A grammar made ready to read texts."""

    def __init__(self, grammar: Grammar):
        self.grammar, self.machine = grammar, grammar_machine()
        self.sizes = sorted({len(s) for s in grammar.stems})
        self.search = ahocorasick.Automaton()
        for w in grammar.stems | grammar.words | THREAT:
            self.search.add_word(w, len(w))
        self.search.make_automaton()
        self.known: dict[str, tuple[float, tuple[int, ...]]] = {}

    def kind(self, word: str) -> str:
        g = self.grammar
        if word in CLOSED:
            return CLOSED[word]
        if word in g.words or any(word[:k] in g.stems for k in self.sizes if k <= len(word)):
            return "i"
        return ""

    def clauses(self, text: str) -> Iterator[str]:
        """Classes of the words of each clause that may hold a match."""
        done = 0
        for last, size in self.search.iter(text):
            at = last + 1 - size
            if at < done or (at and _WORD.match(text[at - 1])):
                continue
            start = max(done, 1 + max(text.rfind(c, done, at) for c in ".!?;:\n"))
            end = _BOUND.search(text, at)
            done = end.start() if end else len(text)
            yield "".join(map(self.kind, _WORD.findall(text, start, done)))

    def read(self, text: str | None) -> tuple[float, list[int]]:
        """The text's log-odds, and how often its clauses' best paths pay each of PAID."""
        total, paid = self.grammar.weights[0], [0] * len(PAID)
        for clause in self.clauses((text or "").lower()):
            found = self.known.get(clause)
            if found is None:
                found = self.machine.best(clause, self.grammar.weights)
                if len(clause) <= 32 and len(self.known) < 20_000:
                    self.known[clause] = found
            total += max(0.0, found[0])
            paid = [a + b for a, b in zip(paid, found[1], strict=True)]
        return total, paid


@lru_cache(8)
def _reader(grammar: Grammar) -> Reader:
    return Reader(grammar)


_MIX = np.array([[0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]], dtype=np.uint64)
_HASHES = np.array([[0xFF51AFD7ED558CCD], [0xC4CEB9FE1A85EC53], [0xD6E8FEB86659FD93], [0xA0761D6478BD642F], [0xE7037ED1A0B428DB], [0x8EBC6AF09C88C6E3]], dtype=np.uint64)


def line_sketch(hashes: list[int]) -> list[int]:
    """Three pairs of min-hashes of a line's shingles of three words (fewer words: the whole line)."""
    a = np.array(hashes + [2**31] * max(0, 3 - len(hashes)), dtype=np.uint64) + np.uint64(1)
    shingles = a[:-2] * _MIX[0, 0] + a[1:-1] * _MIX[0, 1] + a[2:] * _MIX[0, 2]
    mixed = (shingles ^ (shingles >> np.uint64(29))) * _HASHES
    least = (mixed ^ (mixed >> np.uint64(32))).min(1).tolist()
    return [hash(pair) for pair in zip(least[::2], least[1::2], strict=True)]


class Lines:
    """Dissimilar lines of labelled texts as an index from words, in order, to lines."""

    def __init__(self, rows: Iterable[tuple[str | None, int, int]]):
        """rows: (text, toxic, half), in an order that decides which of similar lines counts. A line that clean texts hold isn't evidence of toxic ones."""
        vocabulary: dict[str, int] = {}
        word, line, toxic, halves, seen = array("i"), array("i"), array("b"), array("b"), set()
        for text, y, half in sorted(rows, key=lambda r: r[1]):
            for one in (text or "").lower().split("\n"):
                key = xxh64_intdigest(one.strip())
                if key in seen:
                    continue
                seen.add(key)
                sketch = line_sketch([xxh64_intdigest(w) & 0x7FFFFFFF for w in one.split()])
                if seen.isdisjoint(sketch):
                    held = {vocabulary.setdefault(w, len(vocabulary)) for w in map(sys.intern, _WORD.findall(one))}
                    word.extend(held)
                    line.extend([len(toxic)] * len(held))
                    toxic.append(y)
                    halves.append(half)
                seen.update(sketch)
        self.words = sorted(vocabulary)
        rank = np.empty(len(vocabulary), dtype=np.int64)
        rank[[vocabulary[w] for w in self.words]] = np.arange(len(vocabulary))
        ranks = rank[np.frombuffer(word, dtype=np.int32)] if word else np.empty(0, dtype=np.int64)
        order = np.argsort(ranks, kind="stable")
        self.lines = np.frombuffer(line, dtype=np.int32)[order] if line else np.empty(0, dtype=np.int32)
        self.starts = np.searchsorted(ranks[order], np.arange(len(self.words) + 1))
        self.toxic, self.half = np.array(toxic, dtype=bool), np.array(halves)

    def insults(self, half: int | None = None, purity: float = 20.0) -> tuple[frozenset[str], frozenset[str]]:
        """Beginnings and whole words that toxic lines share and clean lines lack, learned on one half or all."""
        use = np.ones(len(self.toxic), dtype=bool) if half is None else self.half == half
        n1 = int((use & self.toxic).sum())
        n0 = int(use.sum()) - n1
        if not n0 or not n1:
            return frozenset(), frozenset()
        share, mark = n1 / (n0 + n1), np.zeros(len(use), dtype=bool)

        def count(lo: int, hi: int) -> tuple[int, int]:
            held = self.lines[self.starts[lo] : self.starts[hi]]
            mark[held] = True
            held = np.flatnonzero(mark) if len(held) > len(mark) // 50 else np.unique(held)
            mark[held] = False
            held = held[use[held]]
            bad = int(self.toxic[held].sum())
            return len(held) - bad, bad

        often = np.add.reduceat(np.append(self.toxic[self.lines] & use[self.lines], False), self.starts[:-1]) if self.words else np.empty(0)
        tests = max(1000, 20 * int((often >= 3).sum()))
        least = max(2, math.ceil(math.log(tests) / -math.log(share)))

        def sure(good: int, bad: int) -> bool:
            if bad < least or bad * n0 < purity * good * n1 or bad < 4 * good:
                return False
            both = good + bad
            ratio = bad * math.log(bad / both / share) + (good * math.log(good / both / (1 - share)) if good else 0.0)
            return ratio >= math.log(tests)

        stems, words, queue = set(), set(), [(0, len(self.words), 0, None)]
        while queue:
            lo, hi, depth, known = queue.pop()
            good, bad = known or count(lo, hi)
            if bad < least:
                continue
            whole = depth > 0 and len(self.words[lo]) == depth
            children, at = [], lo + whole
            if depth < LONGEST:
                while at < hi:
                    end = bisect_left(self.words, self.words[at][: depth + 1] + "\U0010ffff", at, hi)
                    children.append((at, end, depth + 1, count(at, end)))
                    at = end
            if depth >= SHORTEST and sure(good, bad):
                longest = max(children, key=lambda c: c[3][1], default=None)
                if longest and longest[3][1] >= 0.98 * bad:
                    queue.append(longest)
                else:
                    stems.add(self.words[lo][:depth])
                continue
            if whole and sure(*count(lo, lo + 1)):
                words.add(self.words[lo])
            queue += children
        return frozenset(stems), frozenset(words)


def learn_stems(texts: list[str], toxic: list[int]) -> tuple[frozenset[str], frozenset[str]]:
    """Beginnings and whole words of insults in labelled texts."""
    return Lines(zip(texts, toxic, [0] * len(toxic), strict=True)).insults()


def fit_weights(x: np.ndarray, y: np.ndarray, n: np.ndarray, spread: float = 1.0, rounds: int = 100) -> tuple[float, ...]:
    """Weights for rows x (how often each of PAID is paid), labels y and counts n: Newton steps within the bounds."""
    x = np.column_stack([np.ones(len(x)), x])
    prior = np.array(DEFAULT)
    precision = np.array([0.01] + [1 / spread**2] * len(PAID))
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + precision * (w - prior)
        free = ~(((w <= LOWEST) & (slope > 0)) | ((w >= HIGHEST) & (slope < 0)))
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(precision)
        step = np.zeros_like(w)
        step[free] = np.linalg.solve(bend[np.ix_(free, free)], slope[free])
        w = np.clip(w - np.clip(step, -1, 1), LOWEST, HIGHEST)
        if np.abs(step).max() < 1e-7:
            break
    return tuple(float(v) for v in w)


def labelled(labels: DataFrame) -> DataFrame:
    """(id, y, half, draw): labelled ids that may be learned from; draw is a hash of the id in [0, 1)."""
    one = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("y"))
    crc = F.crc32(F.col("id").cast("string"))
    return one.where(crc % FOLDS != 0).select("id", "y", (F.floor(crc / FOLDS) % 2).cast("int").alias("half"), (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) / 1_000_000).alias("draw"))


def with_text(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text, y, half) of a bounded number of ids."""
    return docs.select(F.col("doc_id").alias("doc"), "text").join(F.broadcast(ids), F.col("doc") == F.col("id")).select("id", "text", "y", "half")


def fit_grammar(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_fit: int = MAX_FIT) -> Grammar:
    """docs (doc_id, text), labels (doc_id, toxic); rows with crc32(doc_id) mod 5 = 0 aren't learned from."""
    ids = labelled(labels)
    n = {r["y"]: r["n"] for r in ids.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Grammar(words=INSULT)
    some = ids.where(F.col("draw") < F.when(F.col("y") == 1, max_toxic / n[1]).otherwise(max_clean / n[0]))
    # In an order of their own, so that the same rows give the same grammar in any process.
    got = with_text(docs, some).toArrow().sort_by([("y", "ascending"), ("id", "ascending"), ("text", "ascending")])
    lines = Lines((t.as_py(), int(y), int(h)) for t, y, h in zip(got["text"], got["y"].to_pylist(), got["half"].to_pylist(), strict=True))
    del got
    if lines.toxic.all() or not lines.toxic.any():
        return Grammar(words=INSULT)
    crossed = [Grammar(*lines.insults(1 - half)) for half in (0, 1)]  # a row's stems come from the other half
    both = Grammar(*lines.insults())
    del lines

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def paid(text: pa.Array, half: pa.Array) -> pa.Array:
        readers = [g.reader() for g in crossed]
        return pa.array([readers[h].read(t.as_py())[1] for t, h in zip(text, half.to_pylist(), strict=True)], pa.list_(pa.int32()))

    sample = with_text(docs, ids.where(F.col("draw") < max_fit / (n[0] + n[1])))
    bound_batches(docs.sparkSession)
    counts = sample.select(paid("text", "half").alias("paid"), "y").groupBy("paid", "y").agg(F.count("*").alias("n")).orderBy("paid", "y").collect()
    x, y, k = np.array([r["paid"] for r in counts], dtype=float).reshape(-1, len(PAID)), np.array([r["y"] for r in counts], dtype=float), np.array([r["n"] for r in counts], dtype=float)
    return Grammar(both.stems, both.words, fit_weights(x, y, k))


def score_toxicity(docs: DataFrame, grammar: Grammar, text_col: str | Column = "text") -> DataFrame:
    """docs with `toxic_score` (replaced if it is there) and `toxic_paid`, an array in the order of PAID."""
    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("paid", T.ArrayType(T.IntegerType()))])

    @F.arrow_udf(kind)
    def score(text: pa.Array) -> pa.Array:
        read = grammar.reader().read
        got = [read(t.as_py()) for t in text]
        return pa.StructArray.from_arrays([pa.array([logistic(v) for v, _ in got], pa.float64()), pa.array([p for _, p in got], pa.list_(pa.int32()))], names=["score", "paid"])

    bound_batches(docs.sparkSession)
    own = [c for c in docs.columns if c.lower() not in ("toxic_score", "toxic_paid")]
    found = fresh("toxic", docs)
    scored = docs.select(*[docs[c] for c in own], score(F.col(text_col) if isinstance(text_col, str) else text_col).alias(found))
    return scored.select(*own, F.col(found)["score"].alias("toxic_score"), F.col(found)["paid"].alias("toxic_paid"))
