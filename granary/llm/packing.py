"""Best-fit packing of documents into sequences, after Martello and Toth's reduction.

Lengths are whole numbers up to the capacity, so the whole instance is a histogram: how many pieces have each length. The
reduction and the best fit work on lengths with counts, in time that does not depend on the number of pieces, and give every
length runs of slots. Executors number the pieces of each length and look their slots up; no piece, id or text meets the driver.

The reduction goes down the lengths. With j the length at hand and r the room beside it, j is fixed alone where nothing fits r;
with the longest fitting k where k fills r, where no two pieces fit r together, or where no three fit and k is at least as long
as any two that fit: {j, k} then dominates every other set that holds j. What it cannot fix goes to best fit by falling length.

Rows: a null text is empty (one piece with the end id); rows that repeat are packed again; a null doc_id is packed like others.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .chunks import library_encoder, with_end
from .common import id_and_text, kept, table, text_batches

CAPACITY, END_ID = 2048, 0

#: A run of equal sequences: how many, and what each holds as (length, pieces of that length).
Run = tuple[int, list[tuple[int, int]]]


def _best_pair(sizes: list[int], counts: dict[int, int], room: int) -> int:
    """The largest sum within ``room`` of two pieces; 0 if no two fit."""
    best, i, j = 0, 0, len(sizes) - 1
    while i <= j:
        s = sizes[i] + sizes[j]
        if s > room or (i == j and counts[sizes[i]] < 2):
            j -= 1
        else:
            best, i = max(best, s), i + 1
    return best


def _smallest(sizes: list[int], counts: dict[int, int], but: int, n: int) -> int | None:
    """The sum of the n smallest pieces without one of length ``but``; None if there are fewer."""
    total = 0
    for s in sizes:
        take = min(n, counts[s] - (s == but))
        total, n = total + take * s, n - take
        if not n:
            return total
    return None


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[Run], dict[int, int]]:
    """Runs that are fixed for good, and the counts that are left."""
    left = {s: n for s, n in counts.items() if n}
    sizes = sorted(left)
    fixed: list[Run] = []

    def take(s: int, n: int) -> None:
        left[s] -= n
        if not left[s]:
            del left[s]
            sizes.remove(s)

    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while left.get(j):
                room, n = capacity - j, left[j]
                at = bisect_right(sizes, room)
                if at and sizes[at - 1] == j and n == 1:
                    at -= 1  # the piece at hand is not its own partner
                if not at:
                    fixed.append((n, [(j, 1)]))
                    take(j, n)
                    changed = True
                    break
                k = sizes[at - 1]
                if k != room:
                    two, three = _smallest(sizes, left, j, 2), _smallest(sizes, left, j, 3)
                    alone = two is None or two > room
                    if not alone and (three is None or three <= room or _best_pair(sizes[:at], left | {j: n - 1}, room) > k):
                        break
                n = n // 2 if k == j else min(n, left[k])
                fixed.append((n, [(j, 2)] if k == j else [(j, 1), (k, 1)]))
                take(j, n)
                take(k, n)
                changed = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[Run]:
    """Best fit by falling length: equal pieces fill the tightest sequences first, all alike ones in one step."""
    rooms: list[int] = []
    open_: dict[int, list[Run]] = {}

    def put(room: int, run: Run) -> None:
        if room not in open_:
            insort(rooms, room)
            open_[room] = []
        open_[room].append(run)

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            at = bisect_left(rooms, s)
            if at == len(rooms):
                q = capacity // s
                if full := n // q:
                    put(capacity - q * s, (full, [(s, q)]))
                if n % q:
                    put(capacity - n % q * s, (1, [(s, n % q)]))
                break
            room = rooms[at]
            m, held = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
            q = room // s
            full = min(m, n // q)
            if full:
                put(room - q * s, (full, [*held, (s, q)]))
                n, m = n - full * q, m - full
            if m and n:  # fewer than q are left
                put(room - n * s, (1, [*held, (s, n)]))
                n, m = 0, m - 1
            if m:
                put(room, (m, held))
    return [run for runs in open_.values() for run in runs]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    fixed, left = reduce_instance(counts, capacity)
    return fixed + best_fit(left, capacity)


def slots(runs: list[Run]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first slot, end slot, first sequence, pieces a sequence, offset of the first of them) of every run and length."""
    out, used, seq = [], {}, 0
    for m, held in runs:
        offset = 0
        for s, q in held:
            first = used.get(s, 0)
            used[s] = first + m * q
            out.append((s, first, used[s], seq, q, offset))
            offset += q * s
        seq += m
    return out


def _pieces(tokenizer: str, capacity: int, with_ids: bool) -> Callable:
    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = library_encoder(tokenizer, True), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b, ids, first in encoder.texts(it):
            rows, own = [], []
            ids, first = with_end(ids, first, END_ID)
            for doc_id, s, e in zip(b.column("doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                for k, i in enumerate(range(s, e, capacity)):
                    x = ids[i : min(i + capacity, e)]
                    n = len(x)
                    if with_ids:
                        own.append(x.astype(np.int32))
                    rows.append((doc_id, k, i - s, n, zlib.crc32(x), part, int(seen[n])))
                    seen[n] += 1
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if with_ids:
                cols.append(pa.array(own, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return cut


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for every piece of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    text_batches(spark)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * with_ids
    pieces = kept(id_and_text(docs).mapInArrow(_pieces(tokenizer, capacity, with_ids), schema))
    by_part = kept(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    lengths = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    rows = slots(plan(lengths, capacity)) or [(0, 0, 0, 0, 1, 0)]
    # As an Arrow table: a list of rows would go through workers of another kind, which every executor then holds beside its own.
    runs = spark.createDataFrame(pa.Table.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["r_length", "first", "after", "sequence", "each", "at"]))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    bases = by_part.select("part", "length", before.alias("base"))
    slot = F.col("base") + F.col("nth")
    placed = pieces.join(bases, ["part", "length"]).withColumn("slot", slot).join(F.broadcast(runs), (F.col("length") == F.col("r_length")) & (F.col("slot") >= F.col("first")) & (F.col("slot") < F.col("after")))
    k = F.col("slot") - F.col("first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(k, F.col("each")) * F.col("length")).cast("long").alias("offset"),
        *["ids"] * with_ids,
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
