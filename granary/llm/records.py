"""Token ids in length-delimited binary records, with a separate offset index for shuffled reads.

A shard is a pair of files, written in ascending order of doc_id; shards are ranges of doc_id, numbered in order.

``shard-N-X.rec`` holds records: length of the payload (uint64), masked crc32 of those 8 bytes (uint32), the payload, masked
crc32 of the payload (uint32). A payload is: doc_id (int64), 1 if it is null (uint8), bytes per id (uint8, 2 or 4), number of
ids (uint32), ids. ``shard-N-X.idx`` holds for each record its offset in the .rec file and its number of ids (uint64 each).
All numbers are little-endian. A mask rotates the checksum right by 15 bits and adds 0xA282EAD8, so that checksums of data that
hold checksums stay useful. X is new for each attempt of a task and only files that the manifest names count: a task that
runs twice, or dies half-way, leaves nothing that is read.

Rows: a null text is empty and gives the end id alone; a null doc_id comes first; rows that repeat a doc_id are ordered by text.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .chunks import library_encoder, with_end
from .common import drop_scratch, id_and_text, kept, scratch, table, text_batches

END_ID = 0
_HEAD, _LONG, _INT, _ENTRY = struct.Struct("<qBBI"), struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<QQ")
#: Bytes that a writer holds back and a reader takes at once.
BLOCK = 4 << 20
#: Rows of a batch that a reader gives.
ROWS = 8192


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = _LONG.pack(len(payload))
    return b"".join((size, _INT.pack(masked(size)), payload, _INT.pack(masked(payload))))


def payload(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return _HEAD.pack(doc_id or 0, doc_id is None, width, len(ids)) + ids.astype(f"<u{width}").tobytes()


def parse(data: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, null, width, n = _HEAD.unpack_from(data)
    return (None if null else doc_id), np.frombuffer(data, f"<u{width}", n, _HEAD.size).astype("<u4")


def read_records(source: pa.NativeFile) -> Iterator[tuple[int | None, np.ndarray]]:
    """All records of a .rec file in order; a wrong length or checksum is an error."""
    while head := source.read(12):
        if len(head) != 12 or masked(head[:8]) != _INT.unpack(head[8:])[0]:
            raise ValueError("a record's length is damaged")
        n = _LONG.unpack(head[:8])[0]
        data, check = source.read(n), source.read(4)
        if len(data) != n or len(check) != 4 or masked(data) != _INT.unpack(check)[0]:
            raise ValueError("a record's payload is damaged")
        yield parse(data)


def read_at(path: str, which: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """Records by their number in a shard, in any order, by way of its index."""
    system, name = fs.FileSystem.from_uri(path)
    out = []
    with system.open_input_file(name) as rec, system.open_input_file(name.removesuffix(".rec") + ".idx") as idx:
        for k in which:
            rec.seek(_ENTRY.unpack(idx.read_at(_ENTRY.size, k * _ENTRY.size))[0])
            out.append(next(read_records(rec)))
    return out


def _write(folder: str, tokenizer: str, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = library_encoder(tokenizer, False)
    shard, n, tokens, at = TaskContext.get().partitionId(), 0, 0, 0
    path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.rec"
    system, name = fs.FileSystem.from_uri(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    with system.open_output_stream(name, buffer_size=BLOCK) as rec, system.open_output_stream(name.removesuffix(".rec") + ".idx", buffer_size=BLOCK) as idx:
        for b, ids, first in encoder.texts(it):
            ids, first = with_end(ids, first, END_ID)
            for doc_id, i, j in zip(b.column("doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                rec.write(data := frame(payload(doc_id, ids[i:j])))
                idx.write(_ENTRY.pack(at, j - i))
                at, n, tokens = at + len(data), n + 1, tokens + j - i
    if n:
        yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "records": n, "tokens": tokens}])


def write_token_records(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Write ``docs`` (doc_id, text) and return the manifest (shard, path, records, tokens), which names what was committed."""
    text_batches(docs.sparkSession)
    ordered = id_and_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return kept(ordered.mapInArrow(partial(_write, folder, tokenizer), "shard long, path string, records long, tokens long"))


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for row in b.to_pylist():
            system, name = fs.FileSystem.from_uri(row["path"])
            start, n, out = row["start"], 0, []
            with system.open_input_stream(name, buffer_size=BLOCK) as rec:
                for doc_id, ids in read_records(rec):
                    out.append((doc_id, start, len(ids), zlib.crc32(ids)))
                    start, n = start + len(ids), n + 1
                    if len(out) == ROWS:
                        yield _rows(out)
                        out = []
            if n != row["records"] or start - row["start"] != row["tokens"]:
                raise ValueError(f"{row['path']} does not hold what the manifest says")
            if out:
                yield _rows(out)


def read_token_records(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record; ``start`` counts the ids of all records before it.

    The running sum over shards has a row for each shard, and each shard is read by a task of its own, in batches of ROWS rows.
    """
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.withColumn("start", before.cast("long"))
    shards = manifest.agg(F.max("shard") + 1).first()[0] or 1
    return placed.repartitionById(shards, F.col("shard").cast("int")).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch(spark, "records")
    try:
        return kept(read_token_records(write_token_records(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))))
    finally:
        drop_scratch(spark, folder)
