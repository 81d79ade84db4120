"""Exact top-k by integer inner product: tiled matrix products, partial selection per tile, merging of top lists in a tree.

A component x counts as floor(256 * x). The query set lies in the shared folder in tiles; each task holds a bounded run of its
vectors, reads one tile of queries at a time and multiplies it with one tile of vectors at a time, so neither side's size, nor
that of a partition, bounds what fits. Of each product only the best k a query are kept: score and place make one exact whole
number, so that ties go to the smaller vec_id without a full sort. A run of vectors gives one list for each query tile; lists are
merged in a tree.

Rows: a vector that is null, or holds null or non-finite components, takes no part, nor does a null vec_id. An empty vector has
inner product 0 with empty ones. Vectors of another length than the query's are no candidates. Rows that share the query's
vec_id are the query's own; a vec_id that repeats among the queries asks once for each of its rows, as long as they differ.
A score beyond a long is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_scratch, kept, scratch, table

K, SCALE = 5, 256
#: Queries and vectors of one product.
QUERY_TILE, VECTOR_TILE = 1024, 4096
#: Bytes of vectors, as doubles, that a task holds at once; sorting them into tiles takes about three times that.
HELD = 128 << 20
#: Lists that one task merges.
FAN_IN = 32
#: Products whose bound is below this are exact in doubles, together with the place of the vector in its tile.
EXACT = 2.0**53 / VECTOR_TILE / 2


def _whole(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) for each length of vector in a batch, rows of whole numbers."""
    ids, col = b.column(0).to_numpy(), b.column(1)
    size = np.diff(col.offsets.to_numpy())
    flat = col.values.to_numpy()[col.offsets[0].as_py() : col.offsets[-1].as_py()]
    start = np.append(0, np.cumsum(size))[:-1]
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield ids[at], np.floor(SCALE * flat[start[at][:, None] + np.arange(n)].astype(np.float64))


def _usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    x = F.col(vector).cast("array<double>")
    ok = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", ok))


def _best(ids: np.ndarray, m: np.ndarray, tile: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(vec_id, score) of the k best of a tile of vectors for each query of a tile; the least long as score marks no vector."""
    qid, q = tile
    n = len(ids)
    bound = max(1.0, float(np.abs(q).max(initial=0)) * float(np.abs(m).max(initial=0)) * max(1, m.shape[1]))
    none = np.iinfo(np.int64).min
    if bound >= EXACT:
        return _best_big(ids, m, tile, k)
    key = (q @ m.T) * VECTOR_TILE + np.arange(n - 1, -1, -1)  # ids ascend, so a smaller id has the larger key
    row, col = _own(qid, ids)
    key[row, col] = -np.inf
    take = min(k, n)
    part = np.argpartition(key, n - take, axis=1)[:, n - take :]
    val = np.take_along_axis(key, part, 1)
    order = np.argsort(-val, axis=1)
    part, val = np.take_along_axis(part, order, 1), np.take_along_axis(val, order, 1)
    gone = val == -np.inf
    val[gone] = 0
    score = np.floor(val / VECTOR_TILE).astype(np.int64)
    score[gone] = none
    return _pad(np.where(gone, -1, ids[part]), k, -1), _pad(score, k, none)


def _own(qid: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a vector has the query's id; ids are sorted."""
    lo, hi = np.searchsorted(ids, qid), np.searchsorted(ids, qid, "right")
    row = np.repeat(np.arange(len(qid)), hi - lo)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)


def _best_big(ids: np.ndarray, m: np.ndarray, tile: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with Python's whole numbers, for components beyond what doubles multiply exactly."""
    qid, q = tile
    big = [[int(x) for x in r] for r in m]
    out_i, out_s = np.full((len(qid), k), -1, np.int64), np.full((len(qid), k), np.iinfo(np.int64).min)
    for r, (own, row) in enumerate(zip(qid, q, strict=True)):
        w = [int(x) for x in row]
        got = sorted((-sum(x * y for x, y in zip(w, v, strict=True)), i) for v, i in zip(big, ids.tolist(), strict=True) if i != own)[:k]
        for c, (s, i) in enumerate(got):
            out_i[r, c], out_s[r, c] = i, -s
    return out_i, out_s


def _pad(x: np.ndarray, k: int, fill: int) -> np.ndarray:
    return x if x.shape[1] == k else np.concatenate([x, np.full((len(x), k - x.shape[1]), fill, np.int64)], axis=1)


def _join(i: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row: larger score, then smaller id; empty places, with the least long as score, come last."""
    order = np.lexsort((i, ~s), axis=1)[:, :k]  # ~s falls as s grows and can't overflow
    return np.take_along_axis(i, order, 1), np.take_along_axis(s, order, 1)


def _query_tiles(folder: str) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """Tiles by number; the same numbers in every task, as files and their rows have one order."""
    system, base = fs.FileSystem.from_uri(folder)
    n = 0
    for f in sorted(x.path for x in system.get_file_info(fs.FileSelector(base)) if x.path.endswith(".parquet")):
        with system.open_input_file(f) as opened:
            for b in pq.ParquetFile(opened).iter_batches(QUERY_TILE, columns=["vec_id", "v"]):
                for tile in _whole(b):
                    yield n, tile
                    n += 1


def _tiles(ids: np.ndarray, m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors of one length in tiles, ids ascending in each."""
    order = np.argsort(ids, kind="stable")
    for at in range(0, len(ids), VECTOR_TILE):
        own = order[at : at + VECTOR_TILE]
        yield ids[own], m[own]


def _held(it: Iterator[pa.RecordBatch], most: int) -> Iterator[dict[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """The tiles of vectors by their length, in runs of at most ``most`` bytes of whole numbers, or one row."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0
    for b in it:
        if not b.num_rows:
            continue
        wide = pc.add(pc.multiply(pc.list_value_length(b.column(1)).cast(pa.int64()), 8), 8)
        ends = np.cumsum(wide.to_numpy())
        at = 0
        while at < b.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1 if not size else at, int(np.searchsorted(ends, done + most - size, "right")))
            if to > at:
                for ids, m in _whole(b.slice(at, to - at)):
                    held.setdefault(m.shape[1], []).append((ids, m))
                size += int(ends[to - 1] - done)
                at = to
            if at < b.num_rows:
                yield _joined(held)
                held, size = {}, 0
    if held:
        yield _joined(held)


def _joined(held: dict[int, list[tuple[np.ndarray, np.ndarray]]]) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
    out = {}
    for n in list(held):
        parts = held.pop(n)
        out[n] = list(_tiles(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])))
    return out


def _search(folder: str, k: int, most: int) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for flush, tiles in enumerate(_held(it, most)):
            for number, tile in _query_tiles(folder):
                i = s = None
                for ids, m in tiles.get(tile[1].shape[1], ()):
                    got = _best(ids, m, tile, k)
                    i, s = got if i is None else _join(np.concatenate([i, got[0]], 1), np.concatenate([s, got[1]], 1), k)
                if i is not None:
                    row = {"tile": number, "part": part, "flush": flush, "query": tile[0].tobytes(), "ids": i.tobytes(), "scores": s.tobytes()}
                    yield pa.RecordBatch.from_pylist([row])

    return run


_LISTS = "tile long, part long, query binary, ids binary, scores binary"
_FOUND = "tile long, part long, flush long, query binary, ids binary, scores binary"


def _merge(k: int) -> Callable:
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        i = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, k) for x in pdf["ids"]], 1)
        s = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, k) for x in pdf["scores"]], 1)
        i, s = _join(i, s, k)
        return pd.DataFrame({"tile": pdf["tile"][:1], "part": pdf["part"][:1] // FAN_IN, "query": pdf["query"][:1], "ids": [i.tobytes()], "scores": [s.tobytes()]})

    return merge


def _rows(k: int) -> Callable:
    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in b.to_pylist():
                q, i, s = (np.frombuffer(r[c], np.int64) for c in ("query", "ids", "scores"))
                there = s > np.iinfo(np.int64).min
                rank = np.tile(np.arange(1, k + 1, dtype=np.int32), len(q))
                cols = [np.repeat(q, k)[there], rank[there], i[there], s[there]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "rank", "vec_id", "score"])

    return rows


def top_k(vectors: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vector: str = "embedding", held: int = HELD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` for each row for which ``queries`` (on vec_id) holds.

    A task holds vectors of at most ``held`` bytes at once, searches them with all queries and goes on to the next.
    """
    spark = vectors.sparkSession
    usable = _usable(vectors, id_col, vector)
    folder = scratch(spark, "queries")
    try:
        usable.where(queries).distinct().write.parquet(folder)
        found = kept(usable.mapInArrow(_search(folder, k, held), _FOUND))
    finally:
        drop_scratch(spark, folder)
    # Each list of a task is a part of its own, so a merge never takes more than FAN_IN of them.
    last, flushes = found.agg(F.max("part"), F.max("flush") + 1).first()
    lists = found.select("tile", (F.col("part") * F.lit(flushes or 1) + F.col("flush")).alias("part"), "query", "ids", "scores")
    most = (last or 0) * (flushes or 1) + (flushes or 1) - 1
    while most:
        most //= FAN_IN
        lists = lists.withColumn("part", F.col("part") - F.pmod("part", F.lit(FAN_IN))).groupBy("tile", "part").applyInPandas(_merge(k), _LISTS)
    return lists.mapInArrow(_rows(k), "query_id long, rank int, vec_id long, score long")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP6_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
