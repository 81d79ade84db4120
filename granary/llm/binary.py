"""Packing by power-of-two decomposition: no sequence holds tokens of two documents, and none is padded.

A document's ids are cut into whole pieces of the capacity, a power of two, and what is left into pieces of the lengths that its
binary digits name, longest first. Every piece is a sequence of its own, and sequences of one length are a bucket, so a batch
drawn from a bucket is a full rectangle. Sequences are numbered without gaps, bucket after bucket, longest first: the sequences of
a bucket are a range of numbers, and a batch of n of them is ``sequence_id div n`` of its bucket.

A document becomes at most its whole pieces and one piece for each binary digit, in the task that encodes it. What is shuffled are
counts of (part, length), a dozen rows for each part; numbers come from a running sum over the parts of a length.

Rows: a null or empty text is the end id alone, one piece of length 1; rows that repeat are packed again; a null doc_id is packed
like others.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .chunks import library_encoder, with_end
from .common import id_and_text, kept, table, text_batches

CAPACITY, END_ID = 2048, 1


def decompose(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents of the given sizes, in order."""
    lengths = 1 << np.arange(capacity.bit_length() - 1, -1, -1)
    times = np.empty((len(sizes), len(lengths)), np.int64)
    times[:, 0] = sizes // capacity
    times[:, 1:] = (sizes[:, None] & lengths[1:]) > 0
    length = np.repeat(np.tile(lengths, len(sizes)), times.ravel())
    doc = np.repeat(np.arange(len(sizes)), times.sum(1))
    before = np.cumsum(length) - length
    return doc, before - (np.cumsum(sizes) - sizes)[doc], length


def _ranks(length: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How many pieces of the same length came before each piece in this part; ``seen`` counts by binary logarithm and goes on."""
    kind = np.log2(length).astype(np.int64)
    order = np.argsort(kind, kind="stable")
    counts = np.bincount(kind, minlength=len(seen))
    out = np.empty(len(length), np.int64)
    out[order] = np.arange(len(length)) - np.repeat(np.cumsum(counts) - counts, counts)
    out += seen[kind]
    seen += counts
    return out


def _pieces(tokenizer: str, capacity: int, with_ids: bool) -> Callable:
    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = library_encoder(tokenizer, True), TaskContext.get().partitionId()
        seen = np.zeros(capacity.bit_length(), np.int64)
        for b, ids, first in encoder.texts(it):
            ids, first = with_end(ids, first, END_ID)
            ids = np.ascontiguousarray(ids, "<u4")
            size = np.diff(first)
            doc, start, length = decompose(size, capacity)
            at = first[doc] + start
            crc = [zlib.crc32(ids[i:j]) for i, j in zip(at.tolist(), (at + length).tolist(), strict=True)]
            cols = {
                "doc_id": b.column("doc_id").take(pa.array(doc)), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64()),
                "doc_tokens": pa.array(size[doc]), "part": pa.array(np.full(len(doc), part, np.int32)), "nth": pa.array(_ranks(length, seen)),
            }
            if with_ids:
                cols["ids"] = pa.ListArray.from_arrays(np.append(0, np.cumsum(length)).astype(np.int32), ids.view(np.int32))
            yield pa.RecordBatch.from_pydict(cols)

    return cut


def pack_by_powers(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) for every piece of ``docs`` (doc_id, text)."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError(f"{capacity} is no power of two")
    text_batches(docs.sparkSession)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long" + ", ids array<int>" * with_ids
    pieces = kept(id_and_text(docs).mapInArrow(_pieces(tokenizer, capacity, with_ids), schema))
    by_part = kept(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    # Buckets are at most a dozen rows; the parts of a bucket are summed by a window of their own.
    buckets = by_part.groupBy("length").agg(F.sum("n").alias("n"))
    of_bucket = buckets.select("length", (F.sum("n").over(Window.orderBy(F.desc("length"))) - F.col("n")).alias("from"))
    in_bucket = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    bases = by_part.select("part", "length", in_bucket.alias("in_bucket")).join(F.broadcast(of_bucket), "length").select("part", "length", (F.col("from") + F.col("in_bucket")).alias("base"))
    return pieces.join(bases, ["part", "length"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *["ids"] * with_ids
    )


def op11_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_by_powers(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
