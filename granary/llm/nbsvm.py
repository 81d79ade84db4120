"""Quality by naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, a linear hinge loss on top.

The classifier is fitted on the driver from a bounded sample of labelled rows (``SAMPLE``, by hash of the id, outside the
held-out fifth); the ratios are smoothed counts of each hashed feature in either class. The hinge loss is minimised by dual
coordinate descent. A sigmoid, fitted on a part of the sample that the descent has not seen, turns margins into scores.

Rows: every row is scored, empty and null texts too (they have no features); a null doc_id counts as held out. With labels of
one class only, or none, every score is that class's share, a half if there is none.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, table, text_batches, utf8
from .features import DIM, bounded, quality_features, sample_features, score_rows, training_labels

#: Labelled rows that the classifier learns from at most.
SAMPLE = 8000
THRESHOLD = 0.3
C, ROUNDS, SEED = 0.02, 20, 7


class NbSvm:
    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([(self.weights[r].sum() / np.sqrt(max(1, len(r)))) if len(r) else 0.0 for r in rows]) + self.bias

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(rows) + self.offset, -30, 30)))


def log_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Naive Bayes: the log of the share of each feature in class 1 over that in class 0."""
    counts = np.full((2, DIM), smooth)
    for r, c in zip(rows, y, strict=True):
        counts[int(c), r] += 1
    share = counts / (np.bincount(y, minlength=2)[:, None] + 2 * smooth)
    return np.log(share[1] / share[0])


def hinge_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, c: float = C, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss with a bias; a row is its scaled features over the root of their number.

    The classes weigh alike: a row's box is c times the number of rows over twice its class's.
    """
    sign = np.where(y == 1, 1.0, -1.0)
    box = c * len(y) / (2 * np.bincount(y, minlength=2)[y])
    w, bias, alpha = np.zeros(DIM), 0.0, np.zeros(len(y))
    values = [scale[r] / np.sqrt(max(1, len(r))) for r in rows]
    norm = np.array([v @ v for v in values]) + 1
    rng = np.random.default_rng(SEED)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            r, v = rows[i], values[i]
            g = sign[i] * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), box[i])
            if (d := new - alpha[i]) != 0:
                alpha[i] = new
                w[r] += d * sign[i] * v
                bias += d * sign[i]
                moved = max(moved, abs(d) / box[i])
        if moved < 1e-3:
            break
    return w, bias


def sigmoid_fit(margin: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Platt's slope and offset by Newton's method, with his softened targets."""
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        e, h = p - t, p * (1 - p) + 1e-9
        grad = np.array([e @ margin, e.sum()]) + 1e-3 * np.array([a, 0])
        hess = np.array([[(h * margin) @ margin + 1e-3, h @ margin], [h @ margin, h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def fit(rows: list[np.ndarray], y: np.ndarray) -> NbSvm:
    if len(set(y.tolist())) < 2:
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return NbSvm(np.zeros(DIM), 0.0, 1.0, float(np.log(share / (1 - share))))
    order = np.random.default_rng(SEED).permutation(len(y))
    # Every fourth row of each class sets the sigmoid; with few rows of a class all serve both ends.
    part = np.zeros(len(y), bool)
    for c in (0, 1):
        own = order[y[order] == c]
        part[own[:: 4 if len(own) >= 8 else len(own) + 1][(1 if len(own) < 8 else 0) :]] = True
    learn = ~part
    some = [rows[i] for i in np.flatnonzero(learn)]
    scale = log_ratios(some, y[learn])
    w, bias = hinge_descent(some, y[learn], scale)
    model = NbSvm(w * scale, bias, 1.0, 0.0)
    other = np.flatnonzero(part) if len(set(y[part].tolist())) == 2 else np.arange(len(y))
    model.slope, model.offset = sigmoid_fit(model.margins([rows[i] for i in other]), y[other])
    return model


def split_rows(starts: np.ndarray, flat: np.ndarray) -> list[np.ndarray]:
    return [flat[a:b] for a, b in zip(starts, starts[1:], strict=False)]


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", sample: int = SAMPLE) -> NbSvm:
    text_batches(docs.sparkSession)
    starts, flat, y = sample_features(docs, bounded(training_labels(labels, column), sample), quality_features)
    return fit(split_rows(starts, flat), np.asarray(y, np.int64))


def scorer(model: NbSvm) -> Callable[[pa.Array], np.ndarray]:
    return lambda texts: model.scores([quality_features(t) for t in utf8(texts)])


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""
    return score_rows(docs, scorer(train(docs, labels)), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns, in one pass over the texts.

    A null text counts as empty and stays null; rows that repeat share their fate, and so do equal texts; an empty table stays
    empty; rows whose score is the threshold stay; other columns may have any names and are only carried.
    """
    score = scorer(train(docs, labels))

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(score(pa.array(texts, pa.string())))

    plain, (text,) = numbered(docs, "text")
    return plain.where(scored(F.coalesce(F.col(text).cast("string"), F.lit(""))) >= threshold).toDF(*docs.columns)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
