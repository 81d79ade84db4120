"""Hard negatives by norm-bucketed search: rows whose score with an anchor lies in a window set by one of the anchor's positives.

Candidates are sorted by their norm and lie in files by ranges of it. A task takes a bounded run of them, cuts it into buckets of
falling norm and meets one tile of anchors at a time. By Cauchy-Schwarz no score of a bucket exceeds the anchor's norm times the
bucket's largest; so a bucket is multiplied with those anchors alone that have a window which this bound still reaches: it is
neither below the window's lower limit nor below the kth score that the window has by now (nor, below zero, under its upper limit).
Bounds fall from bucket to bucket, so where none is reached the rest of the run is not looked at. Windows of a tile are kept as
sorted lists of at most k; each task gives the rows that it found, and lists are merged in a tree.

The search runs twice: first each anchor's best rows of its own label (one window without limits), then, for each of these, the
best rows of other labels within [low, high] parts of ``base`` of the positive's score. Ties go to the smaller vec_id.

Rows: a null vec_id or label, or a vector that is null or holds null or non-finite components, takes no part. Vectors of another
length than the anchor's are no candidates. Rows with the anchor's vec_id are the anchor's own and never candidates; anchors with
one vec_id ask each for themselves as long as they differ in label or vector; candidates that repeat are each a row. A positive
with a score below 0 has an empty window. A score beyond a long is an error. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_scratch, kept, numbered, scratch, table

POSITIVES, NEGATIVES, LOW, HIGH, BASE, SCALE = 5, 10, 30, 90, 100, 256
#: Anchors of a tile; rows of the first bucket of a run, and of any bucket, as sizes double.
TILE, FIRST, BUCKET = 512, 256, 2048
#: Bytes of candidates, as doubles, that a task holds at once.
HELD = 64 << 20
#: Lists that one task merges.
FAN_IN = 32
NONE = np.iinfo(np.int64).min
#: Products whose bound is below this are exact in doubles.
EXACT = 2.0**53


@dataclass
class Anchors:
    no: np.ndarray
    ids: np.ndarray
    label: np.ndarray
    m: np.ndarray
    #: Limits of each anchor's windows; lower above upper where there is none.
    lower: np.ndarray
    upper: np.ndarray


@dataclass
class Bucket:
    ids: np.ndarray
    label: np.ndarray
    m: np.ndarray
    norm: float


def _matrices(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of the vectors in column ``v``."""
    col = b.column(b.schema.get_field_index("v"))
    edge = col.offsets.to_numpy()
    size, flat = np.diff(edge), col.values.to_numpy(zero_copy_only=False)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, flat[edge[at][:, None] + np.arange(n)]


def _windows(col: pa.Array) -> np.ndarray:
    """Limits in one row for each anchor, zeros where it has fewer windows than others."""
    edge = col.offsets.to_numpy()
    size, flat = np.diff(edge), col.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(col), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = flat[edge[0] : edge[-1]]
    return out


def _tiles(folder: str) -> Iterator[tuple[int, Anchors]]:
    """Tiles by number; the same numbers in every task, as files and their rows have one order."""
    system, base = fs.FileSystem.from_uri(folder)
    n = 0
    for f in sorted(x.path for x in system.get_file_info(fs.FileSelector(base)) if x.path.endswith(".parquet")):
        with system.open_input_file(f) as opened:
            for b in pq.ParquetFile(opened).iter_batches(TILE, columns=["no", "vec_id", "label", "v", "lower", "upper"]):
                no, ids, label = (b.column(i).to_numpy() for i in range(3))
                lower, upper = _windows(b.column(4)), _windows(b.column(5))
                there = np.arange(lower.shape[1]) < np.diff(b.column(4).offsets.to_numpy())[:, None]
                lower[~there], upper[~there] = 1, 0
                for at, m in _matrices(b):
                    yield n, Anchors(no[at], ids[at], label[at], m, lower[at], upper[at])
                    n += 1


def _buckets(held: list[pa.RecordBatch]) -> dict[int, list[Bucket]]:
    """Buckets of falling norm for each length of vector."""
    by_length: dict[int, list[tuple]] = {}
    for b in held:
        ids, label = b.column(0).to_numpy(), b.column(1).to_numpy()
        for at, m in _matrices(b):
            by_length.setdefault(m.shape[1], []).append((ids[at], label[at], m))
    out = {}
    for n in list(by_length):
        ids, label, m = (np.concatenate(x) for x in zip(*by_length.pop(n), strict=True))
        norm = np.sqrt((m * m).sum(1))
        order = np.argsort(-norm, kind="stable")
        out[n], i, size = [], 0, FIRST
        while i < len(order):
            at = order[i : i + size]
            out[n].append(Bucket(ids[at], label[at], m[at], float(norm[at[0]])))
            i, size = i + size, min(2 * size, BUCKET)
    return out


def _held(it: Iterator[pa.RecordBatch], most: int) -> Iterator[dict[int, list[Bucket]]]:
    """Buckets of runs of at most ``most`` bytes of vectors, or one row."""
    held, size = [], 0
    for b in it:
        if not b.num_rows:
            continue
        edge = b.column(2).offsets.to_numpy().astype(np.int64) * 8
        at = 0
        while at < b.num_rows:
            to = int(np.searchsorted(edge, edge[at] + most - size, "right")) - 1
            to = min(b.num_rows, max(to, at + (not held)))
            if to > at:
                held.append(b.slice(at, to - at))
                size += int(edge[to] - edge[at])
                at = to
            if at < b.num_rows:
                yield _buckets(held)
                held, size = [], 0
    if held:
        yield _buckets(held)


def _product(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact inner products as longs; with Python's whole numbers where doubles do not multiply exactly."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(m).max(initial=0)) * max(1, m.shape[1]) < EXACT:
        return (q @ m.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return (whole(q) @ whole(m).T).astype(np.int64)


def _place(first: np.ndarray) -> np.ndarray:
    """The place of each row in its group, given where groups start."""
    at = np.flatnonzero(first)
    return np.arange(len(first)) - np.repeat(at, np.diff(np.append(at, len(first))))


class Search:
    """The best k rows of each window of a tile of anchors so far."""

    def __init__(self, a: Anchors, same: bool, k: int):
        self.a, self.same, self.k = a, same, k
        self.norm = np.sqrt((a.m * a.m).sum(1))
        self.ids = np.full((*a.lower.shape, k), -1, np.int64)
        self.scores = np.full((*a.lower.shape, k), NONE, np.int64)

    def take(self, b: Bucket) -> bool:
        """Look through a bucket; False if its bound, and so that of all that follow, reaches no window."""
        a = self.a
        bound = self.norm * b.norm * (1 + 1e-9) + 1
        floor = np.maximum(a.lower, self.scores[:, :, -1])
        open_ = (a.lower <= a.upper) & ~(bound[:, None] < floor) & ~(a.upper < -bound[:, None])
        rows = np.flatnonzero(open_.any(1))
        if not len(rows):
            return False
        score = _product(a.m[rows], b.m)
        fits = ((a.label[rows, None] == b.label) == self.same) & (a.ids[rows, None] != b.ids)
        for w in range(a.lower.shape[1]):
            own = np.flatnonzero(open_[rows, w])
            s = score[own]
            r, c = np.nonzero(fits[own] & (s >= floor[rows[own], w, None]) & (s <= a.upper[rows[own], w, None]))
            if len(r):
                self._merge(rows[own][r], w, b.ids[c], s[r, c])
        return True

    def _merge(self, row: np.ndarray, w: int, ids: np.ndarray, scores: np.ndarray) -> None:
        order = np.lexsort((ids, ~scores, row))
        row, ids, scores = row[order], ids[order], scores[order]
        place = _place(np.append(True, row[1:] != row[:-1]))
        best = place < self.k
        row, ids, scores, place = row[best], ids[best], scores[best], place[best]
        each, at = np.unique(row, return_inverse=True)
        new_i, new_s = np.full((len(each), self.k), -1, np.int64), np.full((len(each), self.k), NONE, np.int64)
        new_i[at, place], new_s[at, place] = ids, scores
        i, s = np.concatenate([self.ids[each, w], new_i], 1), np.concatenate([self.scores[each, w], new_s], 1)
        order = np.lexsort((i, ~s), axis=1)[:, : self.k]
        self.ids[each, w], self.scores[each, w] = np.take_along_axis(i, order, 1), np.take_along_axis(s, order, 1)

    def found(self) -> dict[str, bytes]:
        r, w, place = np.nonzero(self.scores > NONE)
        return _blobs(self.a.no[r], w, self.ids[r, w, place], self.scores[r, w, place])


_PARTS = ("no", "window", "ids", "scores")
_LISTS = "tile long, part long, no binary, window binary, ids binary, scores binary"


def _blobs(*cols: np.ndarray) -> dict[str, bytes]:
    return {name: np.ascontiguousarray(c, np.int64).tobytes() for name, c in zip(_PARTS, cols, strict=True)}


def _task(folder: str, same: bool, k: int, most: int) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for flush, buckets in enumerate(_held(it, most)):
            for number, anchors in _tiles(folder):
                search = Search(anchors, same, k)
                for b in buckets.get(anchors.m.shape[1], ()):
                    if not search.take(b):
                        break
                if (got := search.found())["no"]:
                    yield pa.RecordBatch.from_pylist([{"tile": number, "part": part, "flush": flush, **got}])

    return run


def _merge(k: int) -> Callable:
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        no, window, ids, scores = (np.frombuffer(b"".join(pdf[c]), np.int64) for c in _PARTS)
        order = np.lexsort((ids, ~scores, window, no))
        no, window, ids, scores = no[order], window[order], ids[order], scores[order]
        best = _place(np.append(True, (no[1:] != no[:-1]) | (window[1:] != window[:-1]))) < k
        return pd.DataFrame([{"tile": pdf["tile"][0], "part": pdf["part"][0] // FAN_IN, **_blobs(no[best], window[best], ids[best], scores[best])}])

    return merge


def _rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists as rows; within a list the rows of a window are in order."""
    for b in it:
        for row in b.to_pylist():
            no, window, ids, scores = (np.frombuffer(row[c], np.int64) for c in _PARTS)
            rank = _place(np.append(True, (no[1:] != no[:-1]) | (window[1:] != window[:-1]))) + 1
            yield pa.RecordBatch.from_arrays([pa.array(no), pa.array(window), pa.array(rank.astype(np.int32)), pa.array(ids), pa.array(scores)], ["no", "window", "rank", "vec_id", "score"])


def _best(candidates: DataFrame, folder: str, same: bool, k: int, held: int) -> DataFrame:
    """(no, window, rank, vec_id, score): the k best candidates of every window of the anchors that lie in ``folder``."""
    lists = kept(candidates.mapInArrow(_task(folder, same, k, held), _LISTS.replace("part long,", "part long, flush long,")))
    # Each list of a task is a part of its own, so a merge never takes more than FAN_IN of them.
    last, flushes = lists.agg(F.max("part"), F.max("flush") + 1).first()
    flushes = flushes or 1
    most = ((last or 0) + 1) * flushes - 1
    lists = lists.select("tile", (F.col("part") * flushes + F.col("flush")).alias("part"), *_PARTS)
    while True:  # once at least, which puts the rows of a list in order
        lists = lists.withColumn("part", F.col("part") - F.pmod("part", F.lit(FAN_IN))).groupBy("tile", "part").applyInPandas(_merge(k), _LISTS)
        most //= FAN_IN
        if not most:
            return kept(lists.mapInArrow(_rows, "no long, window long, rank int, vec_id long, score long"))


def _usable(vectors: DataFrame, id_col: str, vector: str, label: str, scale: int) -> DataFrame:
    own, (i, v, y) = numbered(vectors, id_col, vector, label)
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = own.select(F.col(i).cast("long").alias("vec_id"), F.col(y).cast("long").alias("label"), F.col(v).cast("array<double>").alias("v")).dropna()
    # floor() of a double is a long in SQL; doubles from 2^52 on are whole already.
    whole = lambda x: F.when(F.abs(x * scale) < 2.0**52, F.floor(x * scale).cast("double")).otherwise(x * scale)
    return rows.where(F.forall("v", ok)).withColumn("v", F.transform("v", whole))


def _parts(n: int, base: int, add: int) -> Column:
    """(score * n + add) div base for scores from 0 on, and the largest long where that is beyond it."""
    return F.expr(f"coalesce(try_add(try_multiply(score div {base}, {n}L), (score % {base} * {n}L + {add}L) div {base}), {2**63 - 1}L)")


def mine(
    vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, base: int = BASE, scale: int = SCALE, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", held: int = HELD
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows for which ``anchors`` (on vec_id) holds.

    A component x counts as floor(scale * x). Negatives satisfy low * positive_score <= base * negative_score <= high * positive_score.
    """
    if not (base > 0 and 0 <= low <= high):
        raise ValueError("a window goes from low to high parts of base, none below zero")
    spark = vectors.sparkSession
    folder = scratch(spark, "mining")
    try:
        usable = _usable(vectors, id_col, vector, label, scale)
        # The place of a row tells copies of one row apart, so that a common row is not one range.
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        by_norm = usable.withColumn("norm", norm).withColumn("place", F.monotonically_increasing_id()).repartitionByRange(F.desc("norm"), "vec_id", "place")
        by_norm.sortWithinPartitions(F.desc("norm")).select("vec_id", "label", "v").write.parquet(f"{folder}/candidates")
        candidates = spark.read.schema("vec_id long, label long, v array<double>").parquet(f"{folder}/candidates")
        asked = candidates.where(anchors).distinct().withColumn("no", F.monotonically_increasing_id())
        limit = lambda x: F.array(F.lit(x).cast("long"))
        asked.select("no", "vec_id", "label", "v", limit(-(2**63)).alias("lower"), limit(2**63 - 1).alias("upper")).write.parquet(f"{folder}/anchors")
        read = spark.read.parquet(f"{folder}/anchors").select("no", "vec_id", "label", "v")
        near = _best(candidates, f"{folder}/anchors", True, positives, held)
        lower = F.when(F.col("score") >= 0, _parts(low, base, base - 1)).otherwise(1)
        upper = F.when(F.col("score") >= 0, _parts(high, base, 0)).otherwise(0)
        limits = near.groupBy("no").agg(F.sort_array(F.collect_list(F.struct("rank", lower.alias("lower"), upper.alias("upper")))).alias("w"))  # at most ``positives`` rows each
        windows = limits.select("no", F.col("w.lower").alias("lower"), F.col("w.upper").alias("upper"))
        read.join(windows, "no").write.parquet(f"{folder}/windows")
        found = _best(candidates, f"{folder}/windows", False, negatives, held)
        pairs = near.select("no", (F.col("rank") - 1).cast("long").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        hits = found.select("no", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        named = read.select("no", F.col("vec_id").alias("anchor_id"))
        return kept(hits.join(pairs, ["no", "window"]).join(named, "no").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    finally:
        drop_scratch(spark, folder)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").withColumn("label", shifted), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e a JOIN e c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
