"""Near duplicates by SimHash: byte-position inverted index, count filtering, verification.

Two fingerprints of 64 bits that differ in at most four bits share at least four of their eight positional bytes. The index
lists fingerprints under triples of positional bytes; the 20 triples of ``TRIPLES`` are a Turan system, so any four shared
bytes hold one of them and no pair is lost. A list lies in one task, where its fingerprints are listed again under each of the
five bytes that are left. A pair's tally is the three bytes of its list and one for each of these inner lists that it meets in;
pairs that meet in none stay below the guaranteed minimum of four and are never looked at, and the rest is verified by the
number of differing bits. A list gives a spanning forest of its links and not all pairs. Lists above ``LIST_BLOCK`` are dealt
out to all pairs of blocks of about that size, so a triple that n distinct fingerprints share costs about n^2 / LIST_BLOCK rows,
in as many tasks as it has pairs of blocks; copies of one fingerprint count once.

Rows: a null or blank text has fingerprint zero, linked like any other. Rows with a null doc_id get a fingerprint, take no part
in links and have a null component. Rows that repeat a doc_id are kept; the id's component is the smallest id that any of the
row's links reach. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near
from .common import Grouped, batches, id_and_text, kept, numbered, table, text_batches
from .components import connected_components

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: Positional bytes that two linked fingerprints share at least.
MIN_BYTES = 8 - MAX_BITS
#: Fingerprints of one list in one task; a longer list is dealt out in blocks of about this size, two at a time.
LIST_BLOCK = 4096
#: Shingles whose bits are counted at once.
COUNT_BLOCK = 1 << 15


def _triples() -> list[tuple[int, int, int]]:
    """Positions in three classes: all triples within a class, and two of one class with one of the next."""
    part = {p: p * 3 // 8 for p in range(8)}
    return [t for t in combinations(range(8), 3) if (n := [sum(part[p] == c for p in t) for c in range(3)]) and (3 in n or any(n[c] == 2 and n[(c + 1) % 3] == 1 for c in range(3)))]


TRIPLES = _triples()


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text; zero where it has no words."""
    ws = text.lower().split()  # of bytes: lower-cases A-Z only
    n = len(ws)
    if not n:
        return 0
    joined = b" ".join(ws)
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, ws), np.int64, n) + 1) - 1
        starts = [0, *(ends[: n - shingle] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    h = np.array(hashes, "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), COUNT_BLOCK):
        bits = np.unpackbits(h[i : i + COUNT_BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, texts in batches(it):
        fp = np.array([fingerprint(t) for t in texts], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    text_batches(docs.sparkSession)
    return id_and_text(docs).mapInArrow(_fingerprints, "doc_id long, fp long")


def _rest(triple: int) -> list[int]:
    return [p for p in range(8) if p not in TRIPLES[triple]]


def _byte(fp: np.ndarray, p: int) -> np.ndarray:
    return ((fp >> np.uint64(8 * p)) & np.uint64(255)).astype(np.int64)


def forest(fp: np.ndarray, triple: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join all linked fingerprints of one list: each is visited once and meets, by way of the inner lists of its own
    bytes, those not yet reached."""
    inner = []
    for p in _rest(triple):
        b = _byte(fp, p)
        order = np.argsort(b, kind="stable")
        inner.append((b, order, np.searchsorted(b[order], np.arange(257))))
    out, fresh, left, first = [], np.ones(len(fp), bool), len(fp), 0
    while left > 1:
        first += int(fresh[first:].argmax())
        fresh[first], left = False, left - 1
        todo = [first]
        while todo and left:
            x = todo.pop()
            met = np.concatenate([order[edge[b[x]] : edge[b[x] + 1]] for b, order, edge in inner])
            hit, tally = np.unique(met[fresh[met]], return_counts=True)
            hit = hit[tally + 3 >= MIN_BYTES]
            hit = hit[np.bitwise_count(fp[hit] ^ fp[x]) <= MAX_BITS]
            if len(hit):
                fresh[hit], left = False, left - len(hit)
                out.append((np.full(len(hit), fp[x]), fp[hit]))
                todo.extend(hit.tolist())
    return out


#: Lists up to this length are tallied for all lists of a batch at once.
SHORT = 24


def _tallied(fp: np.ndarray, at: np.ndarray, triple: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all linked pairs within lists; at: the list of each fingerprint, triple: its list's triple."""
    met = []
    for p in range(8):
        own = np.flatnonzero(np.array([p not in t for t in TRIPLES])[triple])
        key = (at[own] << 8) | _byte(fp[own], p)
        order = np.argsort(key, kind="stable")
        own, key = own[order], key[order]
        for lag in range(1, SHORT):
            same = np.flatnonzero(key[lag:] == key[:-lag])
            if not len(same):
                break
            met.append(own[same] * len(fp) + own[same + lag])
    pair, tally = np.unique(np.concatenate([np.zeros(0, np.int64), *met]), return_counts=True)
    pair = pair[tally + 3 >= MIN_BYTES]
    a, b = pair // max(1, len(fp)), pair % max(1, len(fp))
    near = np.bitwise_count(fp[a] ^ fp[b]) <= MAX_BITS
    return a[near], b[near]


def _links(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, i, j, fp), sorted by the first three: links of each list."""
    for cols, starts in Grouped(3)(it):
        fp, triple = cols[3].astype(np.int64).view(np.uint64), (cols[0] >> 24).astype(np.int64)
        size = np.diff(np.append(starts, len(fp)))
        at = np.repeat(np.arange(len(size)), size)
        short = (size > 1)[at] & (size <= SHORT)[at]
        x, y = _tallied(fp[short], at[short], triple[short])
        a, b = [fp[short][x]], [fp[short][y]]
        for s, n in zip(starts[size > SHORT].tolist(), size[size > SHORT].tolist(), strict=True):
            for p, q in forest(np.unique(fp[s : s + n]), int(triple[s])):
                a.append(p)
                b.append(q)
        if len(p := np.concatenate(a)):
            yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], ["a", "b"])


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links that connect all of the column ``fp`` (distinct) that is linked."""
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    key = lambda t, ps: F.lit(t << 24).bitwiseOR(F.shiftleft(byte(ps[0]), 16)).bitwiseOR(F.shiftleft(byte(ps[1]), 8)).bitwiseOR(byte(ps[2]))
    index = distinct.select("fp", F.explode(F.array(*(key(t, ps).cast("long") for t, ps in enumerate(TRIPLES)))).alias("key"))
    lists = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / LIST_BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("own")), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    )
    dealt = index.join(lists, "key").withColumn("blocks", blocks).withColumn("own", own).select("key", F.explode(pairs).alias("p"), "fp").select("key", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "fp")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``."""
    fps = kept(fingerprints(docs))
    groups = kept(fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = connected_components(links(groups.select("fp")))
    nodes = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = nodes.where("root <> fp").groupBy("root").agg(F.min("rep").alias("least"))
    named = nodes.join(least, "root", "left").select("fp", F.least("rep", "least").alias("own"), "root")
    # A root's own group knows the least of all; its members take it from there.
    heads = named.where("root = fp").select("root", F.col("own").alias("component_id"))
    by_fp = nodes.select("fp", "root").join(heads, "root").select("fp", "component_id")
    out = fps.join(by_fp, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, shingle: int = near.SHINGLE, similarity: float = near.SIMILARITY) -> DataFrame:
    """``docs``, one row of each component: of its smallest doc_id, and within that id any one; rows with a null doc_id stay.

    Texts that the index of positional bytes links are candidates, as in op1. Four bits answer to a similarity of about 0.96, so
    those that share a MinHash band are candidates beside them; ``near.similar`` holds both to the exact Jaccard of their sets.
    Rows go by id and text, so a row of another text stays where its id occurs again. Rows that repeat both are rare and are cut to
    one apart from the others.
    """
    plain, (doc_id, text) = numbered(docs, "doc_id", "text")
    rows = kept(near.similar(docs, fingerprint, links, shingle, similarity))
    own = F.struct("doc_id", "digest")
    first = rows.groupBy("component").agg(F.min(own).alias("first"))
    # Most rows are their component alone; the pairs of the others are few beside the texts.
    counts = rows.join(first, "component").groupBy("doc_id", "digest").agg(F.max(own == F.col("first")).alias("stays"), F.count("*").alias("n"))
    pairs = kept(counts.where("NOT stays OR n > 1").select(F.col("doc_id").alias("other_id"), F.col("digest").alias("other_digest"), "stays"))
    marked = plain.select("*", F.col(doc_id).cast("long").alias("doc_id"), near.text_digest(F.col(text)).alias("digest"))
    same = (F.col("doc_id") == F.col("other_id")) & (F.col("digest") == F.col("other_digest"))
    found = marked.join(pairs, same, "left_anti")
    if not pairs.where("stays").isEmpty():
        found = found.unionByName(marked.join(pairs.where("stays"), same, "left_semi").dropDuplicates(["doc_id", "digest"]))
    return found.select(*plain.columns).toDF(*docs.columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
