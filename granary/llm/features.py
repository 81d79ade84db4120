"""Hashed indicator features of whole texts, and the bounded samples of labelled rows that classifiers learn from."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEGMENT, Memo, at_work, batches, held_out, id_and_text, kept, range_hashes, raw_texts, running, segments, word_ranges

DIM = 1 << 18
#: Feature ids of a sample that reach the driver at most.
IDS = 1 << 25
#: Words whose hashes a worker remembers, in either half of a memo.
REMEMBERED = 120_000
_SHAPE = bytes(65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 97 if 97 <= b <= 122 or b >= 128 else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shape(word: bytes) -> bytes:
    """Letters and digits by class, runs squeezed to one; capitals beyond ASCII count as lower-case letters."""
    s = word.translate(_SHAPE)
    return bytes(c for i, c in enumerate(s) if not i or c != s[i - 1] or c not in b"Aa0")


_h = xxhash.xxh64_intdigest
_hash = Memo(lambda w: _h(w, 1), REMEMBERED)
_shape = Memo(lambda w: _h(shape(w), 2), REMEMBERED)


def _forget() -> None:
    _hash.forget()
    _shape.forget()


def _fold(*parts: np.ndarray) -> np.ndarray:
    h = np.concatenate(parts)
    return np.unique((h * _MIX) >> np.uint64(64 - 18)).astype(np.int32)


_PAIR, _NEXT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
#: Words of the n-grams that are told by which of their words are equal.
EQUALS = 4


def equalities(w: np.ndarray, n: int = EQUALS) -> np.ndarray:
    """For each n-gram a number for which of its words are equal, whatever they are."""
    m = max(0, len(w) - n + 1)
    out = np.full(m, np.uint64(n))
    for i in range(n):
        for j in range(i + 1, n):
            out = out * _PAIR + (w[i : i + m] == w[j : j + m])
    return out * _NEXT


def quality_features(text: bytes) -> np.ndarray:
    """Words and pairs of words; their shapes, and pairs of shapes with whether the words are equal; and n-grams by which of their
    words are equal: each as an indicator."""
    ws = text.split()
    if not ws:
        return np.zeros(0, np.int32)
    at_work("words", _forget)
    w, s = _hash.array(ws), _shape.array(ws)
    same = (w[1:] == w[:-1]).astype(np.uint64)
    return _fold(w, s, w[:-1] * _NEXT + w[1:], s[:-1] * _PAIR + s[1:] + same * _NEXT, equalities(w))


#: Lower case of A-Z, and the punctuation that is taken off a word's ends.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_OUTER = np.zeros(256, bool)
_OUTER[np.frombuffer(b".,;:!?\"'()[]{}<>*#$%&-_|", np.uint8)] = True
#: Bytes of the starts and ends of words that are features beside the word itself.
STARTS, ENDS = (3, 4, 5, 6, 7, 8), (3, 4, 5)
KINDS = 1 + len(STARTS) + len(ENDS)
_ODD = np.random.default_rng(3).integers(1 << 62, size=KINDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bare(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges without outer punctuation; a few bytes one by one, longer runs of it by one pass over all bytes."""
    start, end = start.copy(), end.copy()
    left, right = np.arange(len(start)), np.arange(len(start))
    for _ in range(8):
        left = left[(start[left] < end[left]) & _OUTER[data[np.minimum(start[left], len(data) - 1)]]]
        start[left] += 1
        right = right[(start[right] < end[right]) & _OUTER[data[end[right] - 1]]]
        end[right] -= 1
    if len(left) or len(right):
        at = np.arange(len(data))
        after = np.minimum.accumulate(np.where(_OUTER[data], len(data), at)[::-1])[::-1]
        before = np.maximum.accumulate(np.where(_OUTER[data], -1, at))
        start[left] = np.minimum(np.append(after, len(data))[start[left]], end[left])
        end[right] = np.maximum(before[end[right] - 1] + 1, start[right])
    return start, np.maximum(end, start)


def word_parts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each word its features, a row for each kind: itself without case and outer punctuation, its starts and its ends."""
    data = _LOWER[data]
    start, end = bare(data, start, end)
    out = np.empty((KINDS, len(start)), np.int32)
    shift = np.uint64(64 - DIM.bit_length() + 1)
    for at, lo, hi in segments(data, start, end):
        a, b = start[at] - lo, end[at] - lo
        if hi - lo > SEGMENT:  # one very long word
            pieces = [data[lo : lo + n] for n in STARTS] + [data[hi - n : hi] for n in ENDS]
            rows = [range_hashes(data, start[at], end[at])] + [running(x, 0)[0][-1:] for x in pieces]
        else:
            total, down = running(data[lo:hi], 0)
            base, inverse, last = total[a], down[a], total[b]
            rows = [(last - base) * inverse]
            rows += [(total[np.minimum(a + n, b)] - base) * inverse for n in STARTS]
            rows += [(last - total[x]) * down[x] for n in ENDS for x in (np.maximum(b - n, a),)]
        for k, h in enumerate(rows):
            out[k, at] = (h * _ODD[k]) >> shift
    return out


def text_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all words of a column of texts, and the number of words before each text, with the end."""
    data, edge = raw_texts(column)
    start, end, first = word_ranges(data, edge)
    return word_parts(data, start, end), first


def _extract(features: Callable[[bytes], np.ndarray]) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in batches(it):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([features(t) for t in texts], pa.list_(pa.int32()))], ["doc_id", "label", "features"])

    return run


def training_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label): rows outside the held-out fifth, one for each document; the smallest label where a document has several."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    return known.where(F.col("label").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))


def bounded(rows: DataFrame, n: int) -> DataFrame:
    """At most n rows, those with the least hash of the doc_id: the same ones in every run."""
    return kept(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n))


def sample_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """The rows of ``sample`` (bounded, so it is broadcast) with their text; of several texts of an id, the one with the least hash."""
    own = id_and_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    one = own.join(F.broadcast(sample.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("least"))
    return one.select("doc_id", F.col("least.text").alias("text")).join(F.broadcast(sample), "doc_id")


def sample_features(docs: DataFrame, sample: DataFrame, features: Callable[[bytes], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, feature ids, labels) of the sampled rows' whole texts, on the driver.

    The rows are bounded by the sample; ``IDS`` bounds what they hold: in order of hash, rows count until it is reached.
    """
    rows = kept(sample_texts(docs, sample).mapInArrow(_extract(features), "doc_id long, label int, features array<int>"))
    sizes = rows.select("doc_id", F.xxhash64("doc_id").alias("h"), F.size("features").alias("n")).toPandas().sort_values(["h", "doc_id"])
    if sizes["n"].sum() > IDS:
        few = sizes[sizes["n"].cumsum() <= IDS][["doc_id"]]
        rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame(few, "doc_id long")), "doc_id")
    rows = rows.orderBy("doc_id").toArrow()
    col = rows.column("features").combine_chunks()
    sizes = np.array([len(x) for x in col], np.int64) if len(col) else np.zeros(0, np.int64)
    return np.append(0, np.cumsum(sizes)), col.flatten().to_numpy(), rows.column("label").to_numpy()


#: The unit of a rate: one word of a text of n words counts ONE / (n + EVEN), as a whole number, so that sums do not depend on order.
ONE, EVEN = 1 << 24, 20


def rates(first: np.ndarray) -> np.ndarray:
    """What a word of each text counts."""
    return np.rint(ONE / (np.diff(first) + EVEN))


def rate_sums(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Sums over all rows of ``docs`` of the rate of each feature, and the rows: partial sums of each task, summed again.

    At most DIM + 1 rows reach the driver.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIM + 1)
        for b in it:
            if b.num_rows:
                ids, first = text_words(b.column("text"))
                each = np.repeat(rates(first), np.diff(first))
                for row in ids:
                    total[:DIM] += np.bincount(row, each, DIM)
                total[DIM] += b.num_rows
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held].astype(np.int64))], ["feature", "n"])

    got = docs.select("text").mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(DIM + 1)
    total[got.column("feature").to_numpy()] = got.column("n").to_numpy()
    return total[:DIM] / ONE, int(total[DIM])


def score_rows(docs: DataFrame, scorer: Callable[[pa.Array], np.ndarray], threshold: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) by one pass over the texts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scorer(b.column("text")), pa.float64())], ["doc_id", "score"])

    scored = id_and_text(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted(F.col("score"), threshold))


def predicted(score: Column, threshold: float) -> Column:
    return (score >= threshold).cast("int").alias("predicted")
