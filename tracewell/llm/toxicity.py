"""Toxicity by a noisy channel: disguised words are restored under a character language model, then scored.

A token that looks disguised (digits or symbols among letters, letters set apart, letters repeated) becomes a lattice:
each character may stand for itself, for the letters it resembles, or for nothing (a separator, a repeated letter).
A Viterbi search over the last two letters finds the likeliest word under a trigram model of the characters of all
documents and the channel's costs. A logistic model of marker words and word beginnings scores text and restored words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import Memo, added, cut_lineage, mapped, table, texts
from tracewell.llm.labelled import LABELLED_ROWS, remainder, sample

THRESHOLD = 0.3
FOLDS, HELD = 4, 2
#: Letters of the language model; every other character is a word boundary to it.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
#: What a character may stand for besides itself.
RESEMBLES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i", "*": "aeiou"}
#: Letters of other scripts that look like Latin ones, and what is not seen between letters.
LOOKALIKES = dict(zip("аеорсухіјѕԁһӏкмтвνοαερτικυχ", "aeopcyxijsdhlkmtbvoaeptikux", strict=True))
UNSEEN = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
RESEMBLES |= LOOKALIKES
SEPARATORS = " .-_*~,/\\'’"
#: Costs of the channel, as negative log probabilities.
KEEP, RESEMBLE, APART, AGAIN, DOUBLE = 0.05, 0.4, 0.1, 0.3, 1.2
#: Word beginnings that are features besides whole words.
STARTS = (4, 5, 6)
#: A feature counts if at least so many labelled texts of label 1 hold it, and that share of those that hold it.
LEAST, PURE = 4, 0.5

_TRIM = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "…«»“”„’‘¡¿—–"
_AMONG = re.compile(r"[^\W\d_].*[\d@$!|+€£(¡*].*[^\W_]|[\d@$!|+€£(¡].*[^\W\d_]")
_SPLIT_UP = re.compile(r"(?:[^\W_]{1,2}[.\-_*~,/]){2,}[^\W_]+|[^\W\d_]+[.\-_*~][^\W\d_]+")
_THRICE = re.compile(r"([^\W\d_])\1\1|([^\W\d_])\2.*([^\W\d_])\3")
#: Words of Latin letters and others that look like them, or with something unseen among them.
_LIKE = re.compile(f"(?=.*[{''.join(LOOKALIKES)}{UNSEEN}])[a-zß-öø-ÿœ0-9{''.join(LOOKALIKES)}{UNSEEN}]+")
_SPACED = re.compile(r"(?<![^\W_])[\w@$!|+€£(](?:[ .\-_*~]{1,2}[\w@$!|+€£(]){3,}(?![^\W_])")

_WIDE = re.compile("[\uff01-\uff5e]")

_index = {c: i + 1 for i, c in enumerate(LETTERS)}
_SYMBOLS = len(LETTERS) + 1


def letter_codes() -> np.ndarray:
    """The code of every character below U+0180, 0 for a boundary; capitals as their small letters."""
    return np.array([_index.get(chr(c).lower(), 0) for c in range(0x180)], np.int64)


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes, total = letter_codes(), np.zeros(_SYMBOLS**3, np.int64)
    for b in batches:
        for text in texts(b.column(0)):
            points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
            c = np.zeros(len(points) + 3, np.int64)
            c[2:-1] = np.where(points < 0x180, codes[np.minimum(points, 0x17F)], 0)
            total += np.bincount((c[:-2] * _SYMBOLS + c[1:-1]) * _SYMBOLS + c[2:], minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["code", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """Smoothed log probabilities [two letters before, letter] over the characters of all documents: a table of fixed size."""
    rows = mapped(docs.select("text"), _trigrams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(_SYMBOLS**3)
    for r in rows:
        n[r["code"]] = r["n"]
    n = n.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS)
    one = (n.sum((0, 1)) + 1) / (n.sum() + _SYMBOLS)
    two = (n.sum(0) + 20 * one) / (n.sum(0).sum(1, keepdims=True) + 20)
    three = (n + 5 * two) / (n.sum(2, keepdims=True) + 5)
    return np.log(three)


class Restorer:
    """The Viterbi decoder. Its state is the last two letters written and whether the last one may be repeated."""

    def __init__(self, lm: np.ndarray):
        self.lm = lm.tolist()

    def restore(self, seen: str) -> str:
        """The likeliest word behind a disguised token."""
        lm = self.lm
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for c in seen:
            options = [(_index[c], KEEP)] if c in _index else []
            options += [(_index[x], RESEMBLE) for x in RESEMBLES.get(c, "")]
            nothing = APART if c in SEPARATORS or c in UNSEEN else None if options else 0.5
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (cost, path) in states.items():
                row = lm[a][b]
                for x, price in options:
                    to, total = (b, x), cost + price - row[x] + (DOUBLE if x == b else 0.0)
                    if to not in after or total < after[to][0]:
                        after[to] = (total, (path, x))
                    if x == b and b:
                        total = cost + AGAIN
                        if (a, b) not in after or total < after[a, b][0]:
                            after[a, b] = (total, path)
                if nothing is not None:
                    total = cost + nothing
                    if (a, b) not in after or total < after[a, b][0]:
                        after[a, b] = (total, path)
            states = after
        path = min(((cost - lm[a][b][0], path) for (a, b), (cost, path) in states.items()), default=(0.0, ()), key=lambda s: s[0])[1]
        out = []
        while path:
            path, x = path
            out.append(LETTERS[x - 1])
        return "".join(reversed(out))


def disguised(word: str) -> bool:
    return len(word) >= 3 and bool(_LIKE.fullmatch(word) or _AMONG.search(word) or _THRICE.search(word) or _SPLIT_UP.fullmatch(word))


def units(word: str, restorer: Restorer) -> list[str]:
    """The words that a token of lower case stands for: itself without marks around it, and what it is restored to."""
    if not word.isascii() and _WIDE.search(word):
        word = unicodedata.normalize("NFKC", word)
    core = word.strip(_TRIM + UNSEEN)
    out = [core] if core else []
    if not core.isalpha() or _THRICE.search(core) or _LIKE.fullmatch(core):
        for form in dict.fromkeys((core, word.rstrip(".,;:?"), word.strip("!?.,;:'\""))):
            if disguised(form) and (r := restorer.restore(form)) and r not in out:
                out.append(r)
    return out


def features(word: str) -> list[str]:
    return [word, *(f"^{word[:k]}" for k in STARTS if len(word) >= k)] if word else []


class Reader:
    """Words of texts to features, by the units they stand for; what a word gave is kept."""

    def __init__(self, lm: np.ndarray, known: dict[str, int] | None = None):
        self.restorer, self.known, self.memo = Restorer(lm), known, Memo(self._word)
        self.longest = max(map(len, known or ()), default=0)

    def _word(self, word: str) -> tuple:
        found = dict.fromkeys(f for u in units(word, self.restorer) for f in features(u))
        return tuple(found) if self.known is None else tuple(self.known[f] for f in found if f in self.known)

    def __call__(self, text: str) -> set:
        low = text.lower()
        found = set()
        for g in set(self.memo.of(low.split())):
            found.update(g)
        for m in _SPACED.finditer(low):
            for f in self.spaced(m[0]):
                if self.known is None:
                    found.add(f)
                elif f in self.known:
                    found.add(self.known[f])
        return found

    def spaced(self, run: str) -> list[str]:
        """Features of letters set apart: the run restored as a whole and by the words that wider gaps part. Where no
        gap is wider a run may hold several words, so every place in it counts as a beginning."""
        out: dict[str, None] = {}
        for part in dict.fromkeys((run, *re.split(r"[ ]{2,}", run))):
            word = self.restorer.restore(part)
            out |= dict.fromkeys(features(word))
            out |= dict.fromkeys(f"^{word[j : j + k]}" for j in range(len(word)) for k in STARTS if j + k <= len(word))
            if self.known is not None:
                out |= dict.fromkeys(w for j in range(len(word)) for k in range(STARTS[0], self.longest + 1) if (w := word[j : j + k]) in self.known)
        return list(out)


@dataclass
class Model:
    """Weights of the known features; score() of a text is their logistic."""

    lm: np.ndarray
    known: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0


def logistic(rows: list[list[int]], y: np.ndarray, n: int, l2: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression on sets of features, by accelerated gradient steps; weights stay >= 0."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.array([f for r in rows for f in r], int)
    w, v, bias, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    size = max([1, *(len(r) for r in rows)])
    rate = 4.0 / (len(rows) * (size + 1) / len(rows) + l2 + 0.25 * len(rows) / max(1, n) + 1)
    scale = np.maximum(np.bincount(feature, minlength=n), 1.0)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, v[feature], len(rows)) + vb, -50, 50)))
        g = np.bincount(feature, (p - y)[owner], n)
        new = np.maximum(0.0, v - rate * (g + l2 * v) / np.sqrt(scale))
        newb = vb - rate * float((p - y).sum()) / np.sqrt(len(rows))
        v, vb = new + k / (k + 3) * (new - w), newb + k / (k + 3) * (newb - bias)
        w, bias = new, newb
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Model:
    """The language model of all docs, and the weights from at most `rows` labelled ones that are not held out."""
    lm = language_model(docs)
    got = cut_lineage(sample(docs, labels, "toxic", FOLDS, HELD, rows))
    total = got.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("t")).first()

    def all_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lm)
        for b in batches:
            pairs = [(f, y) for t, y in zip(texts(b.column(0)), b.column(1).to_pylist(), strict=True) for f in reader(t)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.int32())], ["f", "y"])

    counts = mapped(got, all_features, "f string, y int").groupBy("f").agg(F.count("*").alias("n"), F.sum("y").alias("t"))
    kept = [r["f"] for r in counts.where((F.col("t") >= LEAST) & (F.col("t") >= PURE * F.col("n"))).select("f").collect()]  # of a bounded sample
    known = {f: i for i, f in enumerate(sorted(kept))}

    def known_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lm, known)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(reader(t)) for t in texts(b.column(0))], pa.list_(pa.int32())), b.column(1)], ["f", "y"])

    rows_ = mapped(got, known_features, "f array<int>, y int").collect()
    base = (total["t"] + 0.5) / (total["n"] + 1.0)
    if not known or not rows_:
        return Model(lm, bias=float(np.log(base / (1 - base))))
    w, bias = logistic([r["f"] for r in rows_], np.array([r["y"] for r in rows_], float), len(known))
    return Model(lm, known, w, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `score` added (any column of that name goes). Null text: empty. Every row stays, repeated ones too."""
    docs = docs.drop("score")
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size and weights from a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        reader = Reader(m.lm, m.known)
        for b in batches:
            odds = [m.bias + float(m.weights[list(f)].sum()) if (f := reader(t)) else m.bias for t in texts(b.column(at))]
            s = 1 / (1 + np.exp(-np.clip(np.array(odds, float), -500, 500)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, "score"])

    return mapped(docs, run, added(docs, score=T.DoubleType()))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
