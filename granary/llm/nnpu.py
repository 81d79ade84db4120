"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts and unlabelled ones, both bounded samples outside the held-out fifth, train linear classifiers in numpy.
With the class prior p (the share of confirmed toxic rows among all labelled rows outside the held-out fifth), the risk is
p R(P, +) + max(0, R(U, -) - p R(P, -)): what toxic texts among the unlabelled cost as negatives is taken off, and where that
would turn the negative part below zero the step goes the other way, so the risk can't be driven down by memorising.

Features are rates: how often a word, or a start or end of words, occurs among all words of a text, so that a long text is not
more toxic for its length. Those used one by one stand out among the toxic texts against all documents outside the held-out
fifth, whose rates are summed over the whole table; all others, shrunk, come in together as the mean log-ratio of a text's
words. ``MODELS`` classifiers from different parts of the unlabelled sample are averaged, and the offset is placed so that the
share of the unlabelled sample that counts as toxic is the prior. As all is linear, a text's score is a sum over its words.

Rows: every row is scored, empty and null texts too; a null doc_id counts as held out; of several texts of one id, the one with
the least hash is learnt from. Without toxic or unlabelled texts every score is the prior. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, id_and_text, kept, table, text_batches
from .features import DIM, EVEN, ONE, bounded, rate_sums, rates, sample_texts, score_rows, text_words, training_labels

#: Toxic and unlabelled texts at most.
POSITIVES, UNLABELLED = 4000, 8000
THRESHOLD = 0.5
#: Features used one by one at most, by how many deviations they stand out at least, and in how many toxic texts.
FEATURES, STANDS_OUT, HELD_BY = 1024, 4.0, 3
#: What a rate is shrunk by in a log-ratio, and the log-ratios' bounds.
SHRINK, RATIOS = 2e-5, (-1.0, 3.0)
MODELS, STEPS, RATE, DECAY, SEED = 3, 400, 0.05, 4e-4, 11
#: Where the offset starts: low, as most texts are not toxic.
BIAS = -4.0


class NnPu:
    def __init__(self, weights: np.ndarray, bias: float):
        #: weights: what each feature adds to a text that consists of it.
        self.weights, self.bias = weights, bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        ids, first = text_words(texts)
        each, size = np.zeros(ids.shape[1]), np.diff(first)
        for row in ids:
            each += self.weights[row]
        z = np.bincount(np.repeat(np.arange(len(size)), size), each, len(size)) / (size + EVEN) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, toxic, drawn): for each feature the sums of its rates in either sample, of their squares, and the toxic texts."""
    total = np.zeros((4, DIM))
    for b in it:
        if not b.num_rows:
            continue
        ids, first = text_words(b.column("text"))
        one = rates(first) / ONE
        toxic, drawn = (np.array(b.column(c).to_pylist(), bool) for c in ("toxic", "drawn"))
        for i in range(b.num_rows):
            f, n = np.unique(ids[:, first[i] : first[i + 1]], return_counts=True)
            x = n * one[i]
            if toxic[i]:
                total[0, f] += x
                total[3, f] += 1
            if drawn[i]:
                total[1, f] += x
                total[2, f] += x * x
    held = np.flatnonzero(total.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), *(pa.array(t) for t in np.rint(total[:, held] * 2.0**32).astype(np.int64))], ["feature", "p", "u", "uu", "n"])


def standing_out(p: np.ndarray, n: np.ndarray, u: np.ndarray, spread: np.ndarray, positives: int, most: int = FEATURES) -> np.ndarray:
    """Features whose mean rate p among the toxic texts exceeds that of all documents, u, the clearest first; n: toxic texts with it."""
    z = (p - u) / np.sqrt(spread / max(1, positives) + 1e-9)
    z[n < HELD_BY] = 0
    best = np.argsort(-z, kind="stable")[:most]
    return best[z[best] >= STANDS_OUT]


def log_ratios(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    return np.clip(np.log((p + SHRINK) / (u + SHRINK)), *RATIOS)


def _dense(place: np.ndarray, n: int, ratio: np.ndarray):
    """Rows of (toxic, drawn, x): the rates of the n chosen features, and the mean log-ratio, as float32 in bytes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            ids, first = text_words(b.column("text"))
            one = rates(first) / ONE
            x = np.zeros((b.num_rows, n + 2), np.float32)
            for i in range(b.num_rows):
                own = ids[:, first[i] : first[i + 1]].ravel()
                x[i, :-1] = np.bincount(place[own], minlength=n + 1) * one[i]
                x[i, n] = ratio[own].sum() * one[i]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), b.column("drawn"), pa.array([r.tobytes() for r in x[:, : n + 1]], pa.binary())], ["doc_id", "toxic", "drawn", "x"])

    return run


def risk_gradient(xp: np.ndarray, xu: np.ndarray, prior: float, w: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Positive part and negative part of the risk with the sigmoid loss, and the gradient of the step; the offset is the last weight."""
    w32, n = w[:-1].astype(np.float32), len(w) - 1
    sp, su = (1 / (1 + np.exp(-np.clip(x @ w32 + w[n], -30, 30))) for x in (xp, xu))
    dp, du = ((s * (1 - s) / len(s)).astype(np.float32) for s in (sp, su))
    gp, gu = (np.append(d @ x, d.sum()) for x, d in ((xp, dp), (xu, du)))
    negative = float(su.mean() - prior * sp.mean())
    return float(prior * (1 - sp.mean())), negative, gu - 2 * prior * gp if negative >= 0 else prior * gp - gu


def descend(xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk."""
    n = xp.shape[1]
    w = np.zeros(n + 1)
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    w[n] = BIAS
    for t in range(1, STEPS + 1):
        g = risk_gradient(xp, xu, prior, w)[2]
        g[:n] += DECAY * w[:n]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:n], float(w[n])


def fit(xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and offset, the mean of all models."""
    scale = np.sqrt((xp.astype(np.float64) ** 2).mean(0)).astype(np.float32) + np.float32(1e-6)
    xp, xu = xp / scale, xu / scale
    w, rng = np.zeros(xp.shape[1] + 1), np.random.default_rng(SEED)
    for _ in range(MODELS):
        part = np.sort(rng.permutation(len(xu))[: max(1, len(xu) * 2 // 3)])
        own, bias = descend(xp, xu[part], prior)
        z = xu @ own + bias
        w += np.append(own, bias - np.quantile(z, 1 - prior)) / MODELS
    return w[:-1] / scale, float(w[-1])


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> NnPu:
    known = training_labels(labels, column)
    n, toxic = known.agg(F.count("*"), F.sum((F.col("label") == 1).cast("int"))).first()
    prior = min(max((toxic or 0) / n if n else 0.0, 1e-3), 0.9)
    free = id_and_text(docs).where(~held_out(F.col("doc_id")))
    ids = free.select("doc_id").distinct()
    both = bounded(known.where("label = 1"), positives).union(bounded(ids.select("doc_id", F.lit(0).alias("label")), unlabelled))
    # A toxic text that is also drawn as unlabelled serves as both.
    sides = both.groupBy("doc_id").agg(F.max(F.col("label") == 1).alias("toxic"), F.max(F.col("label") == 0).alias("drawn"))
    sample = kept(sample_texts(free, sides))
    p, d = (sample.where(c).count() for c in ("toxic", "drawn"))
    if not p or not d:
        return NnPu(np.zeros(DIM), float(np.log(prior / (1 - prior))))
    got = sample.mapInArrow(_sums, "feature int, p long, u long, uu long, n long").groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("p", "u", "uu", "n"))).toArrow()
    sums = np.zeros((4, DIM))
    sums[:, got.column("feature").to_numpy()] = np.array([got.column(c).to_numpy() for c in ("p", "u", "uu", "n")]) / 2.0**32
    total, rows = rate_sums(free)
    mean_p, mean_u = sums[0] / p, total / rows
    found = standing_out(mean_p, sums[3], mean_u, np.maximum(sums[2] / d - (sums[1] / d) ** 2, 0) + 1e-8, p)
    ratio = log_ratios(mean_p, mean_u)
    place = np.full(DIM, len(found), np.int32)
    place[found] = np.arange(len(found))
    own = sample.mapInArrow(_dense(place, len(found), ratio), "doc_id long, toxic boolean, drawn boolean, x binary").orderBy("doc_id").toArrow()
    x = np.frombuffer(b"".join(own.column("x").to_pylist()), np.float32).reshape(-1, len(found) + 1)
    w, bias = fit(*(x[own.column(c).to_numpy(zero_copy_only=False)] for c in ("toxic", "drawn")), prior)
    weights = w[-1] * ratio
    weights[found] += w[:-1]
    return NnPu(weights, bias)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""
    text_batches(docs.sparkSession)
    return score_rows(docs, train(docs, labels).scores, threshold)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
