"""Exact duplicates with a heavy-hitter split.

A Misra-Gries summary with ``COUNTERS`` counters, built per partition and merged in a tree, holds every digest that more than
one row in ``COUNTERS + 1`` has. A second pass counts the candidates exactly and verifies them by length and a second hash;
these winners, at most ``COUNTERS`` rows, are broadcast and their rows decided map-side. What is left has no group above one
row in ``COUNTERS + 1`` and goes through one ordinary shuffle of ids and digests.

Rows: a null text is an empty one. Of equal texts the largest doc_id stays (nulls are smallest). Where that id occurs more than
once with the text, one of the rows stays. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, kept, numbered, table

COUNTERS = 256
#: Summaries that are merged in one task.
FAN_IN = 512


def _trim(counts: dict, k: int) -> dict:
    """Back to k counters: the k+1st largest count is taken off all, as Misra and Gries do row by row."""
    if len(counts) <= k:
        return counts
    off = sorted(counts.values(), reverse=True)[k]
    return {d: n - off for d, n in counts.items() if n > off}


def _summary(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict = {}
    for b in it:
        for x in pc.value_counts(b.column("digest")).to_pylist():
            counts[x["values"]] = counts.get(x["values"], 0) + x["counts"]
        counts = _trim(counts, COUNTERS)
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["digest", "n"])


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    counts = _trim(pdf.groupby("digest")["n"].sum().to_dict(), COUNTERS)
    return pd.DataFrame({"digest": list(counts), "n": list(counts.values())})


def heavy_candidates(digests: DataFrame) -> DataFrame:
    """(digest, n): at most COUNTERS rows, every digest above one row in COUNTERS + 1 among them."""
    tasks = digests.rdd.getNumPartitions()
    found = digests.select("digest").mapInArrow(_summary, "digest binary, n long")
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        part = F.pmod(F.spark_partition_id(), F.lit(tasks))
        found = found.withColumn("part", part).groupBy("part").applyInPandas(_merge, "digest binary, n long")
    return found


def digests(docs: DataFrame) -> DataFrame:
    """(row, doc_id, digest, check, chars), checkpointed; ``row`` tells repeated rows apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = id_and_text(docs).select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), F.xxhash64(text).alias("check"), F.octet_length(text).alias("chars"))
    return kept(d.select(F.monotonically_increasing_id().alias("row"), "*"))


def duplicates(docs: DataFrame) -> DataFrame:
    """(row, doc_id, digest, keep_id, group_size, kept) for each row of ``docs``."""
    d = digests(docs)
    best = F.max(F.struct("doc_id", "row"))
    winners = (
        d.join(F.broadcast(heavy_candidates(d).select("digest")), "digest")
        .groupBy("digest")
        .agg(best.alias("best"), F.count("*").alias("group_size"), F.min("check").alias("c0"), F.max("check").alias("c1"), F.min("chars").alias("l0"), F.max("chars").alias("l1"))
        .where("group_size > 1 AND c0 = c1 AND l0 = l1")
        .select("digest", "best", "group_size")
    )
    # Counted again for each use, a winner could differ only if its input did: it is fixed here, at most COUNTERS rows.
    winners = F.broadcast(kept(winners))
    heavy = d.join(winners, "digest")
    # Groups are partial sums joined back, a join that adaptive execution splits where one is large; most rows have no group.
    rest, same = d.join(winners, "digest", "left_anti"), ["digest", "check", "chars"]
    groups = rest.groupBy(*same).agg(best.alias("best"), F.count("*").alias("group_size")).where("group_size > 1")
    alone = F.struct("doc_id", "row")
    rest = rest.join(groups, same, "left").withColumn("best", F.coalesce("best", alone)).withColumn("group_size", F.coalesce("group_size", F.lit(1)))
    both = heavy.select("row", "doc_id", "digest", "best", "group_size").unionByName(rest.select("row", "doc_id", "digest", "best", "group_size"))
    return both.select("row", "doc_id", "digest", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """``docs``, one row of each group of equal texts, that of the largest doc_id; the columns stay as they are.

    Only ids and digests decide; rows that go are told by id and digest in an anti-join, which adaptive execution broadcasts
    where they are few. A pair that stays but occurs in several rows is rare, and is cut to one row apart from the others.
    Nulls, empty tables and repeated rows are as in ``duplicates``; other columns may have any names and are only carried.
    """
    plain, (doc_id, text) = numbered(docs, "doc_id", "text")
    pairs = duplicates(docs).groupBy("doc_id", "digest").agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    pairs = kept(pairs.where("NOT stays OR n > 1"))
    digest = F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))
    own = plain.select("*", F.col(doc_id).cast("long").alias("doc_id"), digest.alias("digest"))
    other = pairs.select(F.col("doc_id").alias("other_id"), F.col("digest").alias("other_digest"), "stays")
    same = F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("digest") == F.col("other_digest"))
    if pairs.where("stays").isEmpty():
        return own.join(other, same, "left_anti").select(*plain.columns).toDF(*docs.columns)
    once = own.join(other, same, "left_anti")
    one = own.join(other.where("stays"), same, "left_semi").dropDuplicates(["doc_id", "digest"])
    return once.unionByName(one).select(*plain.columns).toDF(*docs.columns)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP9_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
     g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
