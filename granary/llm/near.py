"""Near duplicates by the similarity of shingle sets: candidates by MinHash, every link verified by exact Jaccard.

Candidates of two kinds: texts whose fingerprints another method links, where one is given (SimHash, in the pipeline), and texts that
share a key. Each text gets ``BANDS`` keys of ``ROWS`` minima. Texts that share a key are candidates; a pair at similarity s shares none with
a chance of (1 - s^ROWS)^BANDS, 1.3e-7 at 0.8 and less above. Components of candidates meet with their whole shingle sets, each
set once, and all pairs of a component are compared, so a link needs no key of its own. A component gives a spanning forest of
its links; a large one is dealt out in blocks by the number of its shingles, two at a time.

Rows: words as in op1, bytes with A-Z lower-cased; a text of at most ``shingle`` words is one shingle, all blank and null texts are
alike. Texts with equal sets are told by a 64-bit hash of the set. Rows with a null doc_id take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at_work, batches, id_and_text, kept, text_batches
from .components import connected_components

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS = 40, 5
#: Shingles of one component in one task; a larger one is dealt out in blocks of about this size, two at a time.
BLOCK = 1 << 21
#: Shingles whose minima are taken at once.
AT_ONCE = 1 << 12
_rng = np.random.default_rng(SEED)
_FACTORS = _rng.integers(1 << 63, size=(BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _rng.integers(1 << 63, size=(BANDS * ROWS, 1), dtype=np.uint64)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles, one at least."""
    ws = text.lower().split()
    joined = b" ".join(ws)
    n = len(ws)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, n) + 1) - 1
    starts = [0, *(ends[: n - shingle] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64))


def set_key(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).astype(np.int64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key of each band: the number of the band and its minima, hashed."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), AT_ONCE):
        least = np.minimum(least, (_FACTORS * hashes[i : i + AT_ONCE] + _OFFSETS).min(1))
    raw = least.tobytes()
    return np.array([xxhash.xxh64_intdigest(raw[8 * ROWS * k : 8 * ROWS * (k + 1)], k) for k in range(BANDS)], np.uint64).view(np.int64)


def _sketched(shingle: int, fingerprint: Callable[[bytes], int]) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("shingles")
        for b, texts in batches(it):
            sets = [shingle_set(t, shingle) for t in texts]
            bands = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * BANDS, np.concatenate([band_keys(s) for s in sets]))
            fp = pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.array([set_key(s) for s in sets], pa.int64()), bands, fp], ["doc_id", "digest", "key", "bands", "fp"])

    return run


def _whole(shingle: int) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in batches(it):
            sets = [shingle_set(t, shingle) for t in texts]
            cols = [pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["key", "n", "hashes"])

    return run


def forest(keys: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join all linked sets: each set is visited once and compared with those not yet reached."""
    size = np.array(list(map(len, sets)))
    vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.append(0, np.cumsum(size))
    mark = np.zeros(len(vocabulary), bool)
    out: list[tuple[int, int]] = []
    left = np.arange(1, len(sets))
    own = flat[begin[1] :]
    todo = [0]
    while len(left):
        if not todo:
            todo, own, left = [int(left[0])], own[size[left[0]] :], left[1:]
            continue
        x = todo.pop()
        mine = flat[begin[x] : begin[x + 1]]
        mark[mine] = True
        common = np.add.reduceat(mark[own], np.append(0, np.cumsum(size[left])[:-1]), dtype=np.int64)
        mark[mine] = False
        hit = common + 1e-9 >= similarity * (size[x] + size[left] - common)
        if hit.any():
            out += [(keys[x], keys[y]) for y in left[hit]]
            todo += left[hit].tolist()
            own = own[np.repeat(~hit, size[left])]
            left = left[~hit]
    return out


def _verified(similarity: float) -> Callable:
    """From (root, i, j, key, hashes), sorted by the first three: the links of each group."""

    def links(rows: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(rows) > 1 and (found := forest(list(rows), list(rows.values()), similarity)):
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, {}
        for batch in it:
            *ids, keys, hashes = (c.to_pylist() for c in batch.columns)
            for g, key, h in zip(zip(*ids, strict=True), keys, hashes, strict=True):
                if g != group:
                    yield from links(rows)
                    group, rows = g, {}
                rows[key] = np.frombuffer(h, np.uint64)
        yield from links(rows)

    return run


def text_digest(text: Column) -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def similar(docs: DataFrame, fingerprint: Callable[[bytes], int], links: Callable[[DataFrame], DataFrame], shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, digest, component) of each row whose doc_id is not null; rows of one component are linked by similar texts.

    ``links`` gives (a, b) of distinct fingerprints ``fp``; texts of fingerprints that it joins are candidates, as are those of a key.
    """
    text_batches(docs.sparkSession)
    own = id_and_text(docs).where("doc_id IS NOT NULL").select("doc_id", text_digest(F.col("text")).alias("digest"), "text")
    rows = kept(own.mapInArrow(_sketched(shingle, fingerprint), "doc_id long, digest long, key long, bands array<long>, fp long"))
    linked = connected_components(links(rows.select("fp").distinct()))
    joined = rows.select("key", "fp").distinct().join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("key", F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")).alias("band"))
    index = rows.select("key", F.explode("bands").alias("band")).unionByName(joined)
    lists = index.groupBy("band").agg(F.min("key").alias("hub"), F.max("key").alias("top")).where("hub < top").select("band", "hub")
    candidates = connected_components(index.join(lists, "band").where("key <> hub").select(F.col("hub").alias("a"), F.col("key").alias("b")))
    candidates = kept(candidates.select(F.col("node").alias("key"), F.col("root").alias("group")))
    # One text of each set, found again by its id; another text of that id drops out as its set is not asked for.
    ids = rows.join(candidates, "key").groupBy("key").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    sets = own.join(ids, "doc_id", "left_semi").select("text").mapInArrow(_whole(shingle), "key long, n long, hashes binary")
    sets = kept(sets.join(candidates, "key").dropDuplicates(["key"]))
    blocks = sets.groupBy("group").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    pairs = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("mine")), lambda k: F.struct(F.least(k, F.col("mine")).alias("i"), F.greatest(k, F.col("mine")).alias("j")))
    )
    dealt = sets.join(blocks, "group").withColumn("mine", mine).select("group", F.explode(pairs).alias("p"), "key", "hashes").select("group", "p.i", "p.j", "key", "hashes")
    dealt = dealt.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
    roots = connected_components(dealt.mapInArrow(_verified(similarity), "a long, b long"))
    return rows.select("doc_id", "digest", "key").join(roots.withColumnRenamed("node", "key"), "key", "left").select("doc_id", "digest", F.coalesce("root", "key").alias("component"))
