"""Quality classifier: a regularised quadratic discriminant over transformed statistics of a document.

Each class has a mean and a covariance that is shrunk towards the pooled one and towards a multiple of the identity.
A score is the logistic of the difference of the two Gaussian log densities, from Mahalanobis distances by Cholesky
factors that are computed once, plus the log ratio of the priors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import added, mapped, table, texts
from tracewell.llm.labelled import LABELLED_ROWS, remainder, sample

THRESHOLD = 0.3
FOLDS, HELD = 5, 0
#: Shares of the pooled covariance and of the identity in a class covariance.
POOLED, RIDGE = 0.1, 0.02
#: Bytes that are compressed at a time to measure repetition; the whole text is, piece by piece.
PIECE = 1 << 15
#: Statistics of a document.
FEATURES = 12

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_PLAIN = b".,;:'\"-()?"
_SPACE = b" \t\r\n\x0b\x0c"
_SYMBOL = bytes(b for b in range(33, 127) if b not in _UPPER + _LOWER + _DIGIT + _PLAIN)


def statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text; an empty one has zeros."""
    raw = text.encode("utf-8", "replace")
    words = text.split()
    n, m = len(raw), max(1, len(words))
    if not n:
        return [0.0] * FEATURES
    count = lambda kind: n - len(raw.translate(None, kind))
    upper, lower, digit, plain, symbol = map(count, (_UPPER, _LOWER, _DIGIT, _PLAIN, _SYMBOL))
    packed = sum(len(zlib.compress(raw[i : i + PIECE], 1)) for i in range(0, n, PIECE))
    lines = text.split("\n")
    logit = lambda a, b: float(np.log((a + 0.5) / (b + 0.5)))
    return [
        float(np.log1p(n)),
        float(np.log(n / m)),
        logit(upper, lower + 1),
        logit(digit, n),
        logit(plain, n),
        logit(symbol, n),
        logit(count(b"!"), n),
        logit(count(b"|"), n),
        float(np.log(len(set(words)) + 1.0) - 0.8 * np.log(m + 1.0)),
        float(np.log((packed + 1.0) / (n + 20.0))),
        float(np.log(n / len(lines))),
        logit(len(lines) - len(set(lines)), len(lines)),
    ]


@dataclass
class Discriminant:
    """Two Gaussians and their priors; a class that has no row makes every score its counterpart's prior."""

    scale: tuple[np.ndarray, np.ndarray]
    means: list[np.ndarray]
    factors: list[np.ndarray]
    logs: list[float]
    prior: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, pooled: float = POOLED, ridge: float = RIDGE) -> Discriminant:
        y = y.astype(int)
        prior = (float((y == 1).sum()) + 0.5) / (len(y) + 1.0)
        if len(y) == 0 or (y == 1).sum() < 2 or (y == 0).sum() < 2:
            return cls((np.zeros(0), np.ones(0)), [], [], [], prior)
        centre, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = (x - centre) / spread
        means = [z[y == k].mean(0) for k in (0, 1)]
        centred = z - np.array(means)[y]
        both, eye = centred.T @ centred / len(z), np.eye(x.shape[1])
        factors = []
        for k in (0, 1):
            own = centred[y == k].T @ centred[y == k] / (y == k).sum()
            factors.append(np.linalg.cholesky((1 - pooled - ridge) * own + pooled * both + ridge * eye))
        return cls((centre, spread), means, factors, [float(np.log(np.diag(f)).sum()) for f in factors], prior)

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = np.full(len(x), np.log(self.prior / (1 - self.prior)))
        if self.factors and len(x):
            z = (x - self.scale[0]) / self.scale[1]
            density = [-0.5 * (np.linalg.solve(f, (z - m).T) ** 2).sum(0) - log for m, f, log in zip(self.means, self.factors, self.logs, strict=True)]
            odds = odds + density[1] - density[0]
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([statistics(t) for t in texts(b.column(0))], pa.list_(pa.float64())), b.column(1)], ["x", "y"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Discriminant:
    """The discriminant of at most `rows` labelled documents that are not held out."""
    got = mapped(sample(docs, labels, "quality", FOLDS, HELD, rows), _features, "x array<double>, y int").collect()
    return Discriminant.fit(np.array([r["x"] for r in got]).reshape(len(got), FEATURES), np.array([r["y"] for r in got]))


def score(docs: DataFrame, model: Discriminant) -> DataFrame:
    """docs with `score` added (any column of that name goes). Null text: empty. Every row stays, repeated ones too."""
    docs = docs.drop("score")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in texts(b.column(at))]).reshape(b.num_rows, FEATURES)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x), pa.float64())], [*b.schema.names, "score"])

    return mapped(docs, run, added(docs, score=T.DoubleType()))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
