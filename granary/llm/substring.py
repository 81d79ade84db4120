"""Passages that repeat across a corpus, by difference-cover anchors.

A window is ``WINDOW`` consecutive words; a word goes if a window that covers it also starts anywhere else. Anchors are shorter
windows that start only where the word's position modulo ``PERIOD`` lies in ``COVER``, a perfect difference set: for any two
positions there is a shift below the period that brings both onto cover positions. So two equal windows share an aligned anchor
of ``WINDOW - PERIOD + 1`` words, and of all positions only one in four is hashed and compared at all.

1. Anchors are hashed part by part, made distinct there, and sent to buckets by hash; a bucket tells each part which of its
   anchors occur anywhere else. 2. Each such anchor is extended to the windows that hold it; these are hashed with 96 bits and
   sent to buckets in the same way, and a bucket tells each part which of its windows occur nowhere else. 3. Each part marks the
   words of the others.

A common passage is one hash per part, whatever its count, so no bucket is hot; what a bucket holds is set by the number of
buckets, which grows with the corpus, and a bucket is a task. A part sends a row for each bucket it has a hash in, so on a very
large corpus buckets grow up to LARGEST times before rows get short: with parts of 128 MB, 100 TB give rows of ten hashes. Larger
parts make longer rows. Answers lie in the shared folder by part, and each task reads only those of its parts.

Words are hashed by their bytes, eight at a time through a mixing permutation, long ones by XXH3, and a window by the hashes of
its halves, theirs, and so on down to its words, mixed at each step. A window is told by 128 bits, two such hashes with their own
constants; no sum or product of words or bytes stands alone, so texts of two words in a pattern are told apart like others. Words
are not compared again: among 10^13 windows two different ones meet with a chance of about 10^-13, if the hashes are as good as random.

Rows: a null text has no words; rows are judged one by one, so repeated rows remove each other's windows; doc_id is only carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_hashes, drop_scratch, id_and_text, kept, mix, pieces, scratch, spare, table, text_batches, word_ranges

WINDOW = 35
#: Perfect difference sets by their period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
#: The shortest anchor worth hashing; shorter ones occur by chance in most texts.
LEAST_ANCHOR = 12
#: Hashes that a bucket holds about, and that a part holds back before it sends them.
BUCKET, FLUSH = 1_000_000, 4_000_000
#: How much larger a bucket may be, so that a part's row for it holds RUN hashes.
LARGEST, RUN = 8, 256


def cover_for(window: int) -> int:
    """The longest period that leaves an anchor of LEAST_ANCHOR words, or 1."""
    return max(p for p in COVERS if p == 1 or window - p + 1 >= LEAST_ANCHOR)


_JOIN = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


def window_hashes(a: np.ndarray, at: np.ndarray, length: int, which: int) -> np.ndarray:
    """A hash of the windows of ``length`` word hashes that start at ``at``: of two windows of the largest power of two within."""
    n = 1
    while 2 * n <= length and len(at):
        a, n = mix(a[:-n] * _JOIN[which] + a[n:]), 2 * n
    return mix(a[at] * _JOIN[which] + a[at + (length - n)]) if n < length else a[at]


class Texts:
    """The words of a run of texts: where each lies, its text, and its hashes."""

    def __init__(self, data: np.ndarray, edge: np.ndarray):
        self.data, self.edge = data, edge
        self.start, self.end, self.first = word_ranges(data, edge)
        self.size = np.diff(self.first)
        self._hashes: dict[int, np.ndarray] = {}

    def hashes(self, which: int) -> np.ndarray:
        if which not in self._hashes:
            self._hashes[which] = byte_hashes(spare(self.data), self.start, self.end, which)
        return self._hashes[which]

    def of(self, words: np.ndarray) -> np.ndarray:
        """The text of each word."""
        return np.searchsorted(self.first, words, "right") - 1


class Finder:
    """Anchors and windows of a run of texts; none goes over a text's edge."""

    def __init__(self, window: int):
        self.window, self.period = window, cover_for(window)
        self.anchor = window - self.period + 1
        self.cover = np.isin(np.arange(self.period), COVERS[self.period])

    def anchors(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of each anchor; texts shorter than a window have none."""
        each = np.where(t.size >= self.window, t.size - self.anchor + 1, 0)
        place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        at = (place + np.repeat(t.first[:-1], each))[self.cover[place % self.period]]
        return at, window_hashes(t.hashes(0), at, self.anchor, 0)

    def candidates(self, t: Texts, repeated: Answers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and hash (two of 64 bits) of each window that holds a repeated anchor."""
        at, h = self.anchors(t)
        hit = at[repeated.has(h)]
        if not len(hit):
            return hit, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        own = t.of(hit)
        at = np.flatnonzero(covered(np.maximum(hit - self.period + 1, t.first[own]), np.minimum(hit + 1, t.first[own + 1] - self.window + 1), len(t.start)))
        return at, window_hashes(t.hashes(0), at, self.window, 0), window_hashes(t.hashes(1), at, self.window, 1)


def covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """True at the positions below n that lie in any [start, end)."""
    return np.cumsum(np.bincount(start, minlength=n + 1)[:n] - np.bincount(end, minlength=n + 1)[:n]) > 0


def member(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted values."""
    if not len(among):
        return np.zeros(len(x), bool)
    i = np.searchsorted(among, x)
    i[i == len(among)] = 0
    return among[i] == x


_KEY = np.dtype([("h", "<u8"), ("g", "<u8")])


def keys(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h), _KEY)
    out["h"], out["g"] = h, g
    return out


def runs(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts."""
    k = k[np.lexsort((k["g"], k["h"]))]
    new = np.ones(len(k), bool)
    new[1:] = (k["h"][1:] != k["h"][:-1]) | (k["g"][1:] != k["g"][:-1])
    at = np.flatnonzero(new)
    return k[at], np.diff(np.append(at, len(k)))


class Answers:
    """What the buckets told a part, sorted by hash, with a table of the hashes' upper bits that rules most others out."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.top = keys["h"] if keys.dtype == _KEY else keys
        bits = max(10, min(24, 4 + len(keys).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[self.top >> self.shift] = True

    def has(self, h: np.ndarray, g: np.ndarray | None = None) -> np.ndarray:
        """Which of h (and g) are among them; equal h with another g are looked at one by one."""
        out = np.zeros(len(h), bool)
        some = np.flatnonzero(self.table[h >> self.shift])
        lo, hi = (np.searchsorted(self.top, h[some], side) for side in ("left", "right"))
        if g is None:
            out[some] = lo < hi
            return out
        for k in range(int((hi - lo).max(initial=0))):
            at = np.flatnonzero(lo + k < hi)
            out[some[at]] |= self.keys["g"][lo[at] + k] == g[some[at]]
        return out


_SENT = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])


def _send(part: int, found: list[np.ndarray], buckets: int, wide: bool) -> Iterator[pa.RecordBatch]:
    """Distinct hashes of a part, split by bucket; ``more`` has those that occur in the part more than once."""
    k = np.concatenate(found)
    if wide:
        k, n = runs(k)
        top = k["h"]
    else:
        k, n = np.unique(k, return_counts=True)
        top = k
    bucket = ((top >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    edge = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edge)).tolist():
        s = slice(edge[b], edge[b + 1])
        yield pa.RecordBatch.from_pylist([{"bucket": b, "part": part, "once": k[s][n[s] == 1].tobytes(), "more": k[s][n[s] > 1].tobytes()}], _SENT)


def _by_part(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, Texts]]:
    for b, data, edge in pieces(it):
        part = b.column("part").to_numpy()
        cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for s, e in zip(cut, cut[1:], strict=False):
            yield int(part[s]), b.slice(s, e - s), Texts(data[edge[s] : edge[e]], edge[s : e + 1] - edge[s])


def _collect(it: Iterator[pa.RecordBatch], hashes: Callable, buckets: int, wide: bool) -> Iterator[pa.RecordBatch]:
    now, found, n = None, [], 0
    for part, _, texts in _by_part(it):
        if n and (part != now or n > FLUSH):
            yield from _send(now, found, buckets, wide)
            found, n = [], 0
        now = part
        if len(h := hashes(part, texts)):
            found.append(h)
            n += len(h)
    if n:
        yield from _send(now, found, buckets, wide)


def _answers(folder: str, dtype: np.dtype | str) -> Callable[[int], Answers]:
    """The answers for a part; those of the last part are kept."""
    system, base = fs.FileSystem.from_uri(folder)
    last: list = [None, None]

    def of(part: int) -> Answers:
        if last[0] != part:
            files = system.get_file_info(fs.FileSelector(f"{base}/part={part}", allow_not_found=True))
            blobs = [x for f in files if f.path.endswith(".parquet") for x in pq.read_table(f.path, filesystem=system, columns=["found"], partitioning=None).column("found").to_pylist()]
            got = np.frombuffer(b"".join(blobs), dtype)
            last[:] = part, Answers(np.unique(got) if dtype == "<u8" else runs(got)[0] if len(got) else got)
        return last[1]

    return of


def _repeated(once: list[bytes], more: list[bytes]) -> list[bytes]:
    """For each part, its anchors that occur more than once in the bucket."""
    one, many = [np.frombuffer(x, "<u8") for x in once], [np.frombuffer(x, "<u8") for x in more]
    k, n = np.unique(np.concatenate(one + many), return_counts=True)
    again = np.union1d(k[n > 1], np.concatenate(many))
    return [np.concatenate([o[member(o, again)], m]).tobytes() for o, m in zip(one, many, strict=True)]


def _single(once: list[bytes], more: list[bytes]) -> list[bytes]:
    """For each part, its windows that occur nowhere else."""
    one = [np.frombuffer(x, _KEY) for x in once]
    at = np.repeat(np.arange(len(one)), [len(x) for x in one])
    k = np.concatenate(one + [np.frombuffer(x, _KEY) for x in more])
    order = np.lexsort((k["g"], k["h"]))
    s = k[order]
    same = (s["h"][1:] == s["h"][:-1]) & (s["g"][1:] == s["g"][:-1])
    alone = ~(np.append(False, same) | np.append(same, False))
    alone = np.sort(order[alone & (order < len(at))])
    edge = np.searchsorted(at[alone], np.arange(len(one) + 1))
    return [k[alone[edge[i] : edge[i + 1]]].tobytes() for i in range(len(one))]


def _told(answer: Callable) -> Callable:
    """A task holds whole buckets, nearly always one; its rows are gathered and answered bucket by bucket."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes, bytes]]] = {}
        for b in it:
            for bucket, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault(bucket, []).append(tuple(row))
        for bucket in list(held):
            parts, once, more = zip(*held.pop(bucket), strict=True)
            out = [(p, x) for p, x in zip(parts, answer(once, more), strict=True) if x]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["part", "found"])

    return run


def bucket_count(hashes: float, parts: int) -> int:
    """So many that a bucket holds BUCKET hashes, or up to LARGEST times as many where a part's row for a bucket would be below RUN."""
    return max(1, round(max(hashes / BUCKET / LARGEST, min(hashes / BUCKET, hashes / parts / RUN))))


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    text_batches(spark)
    folder = scratch(spark, "repeats")
    try:
        return kept(_without_repeats(docs, Finder(window), with_text, folder))
    finally:
        drop_scratch(spark, folder)


def _without_repeats(docs: DataFrame, finder: Finder, with_text: bool, folder: str) -> DataFrame:
    spark = docs.sparkSession
    # Rows are written with the number of their part, so that later passes find the same parts however files are read.
    copy = id_and_text(docs).select("doc_id", "text", F.octet_length("text").cast("long").alias("size"), F.spark_partition_id().alias("part"))
    copy.write.option("compression", "zstd").parquet(f"{folder}/docs")
    copy = spark.read.schema("doc_id long, text string, size long, part int").parquet(f"{folder}/docs")
    size, parts = copy.agg(F.sum("size"), F.max("part") + 1).first()
    # A word has at least two bytes with the space after it; most have about six.
    count = lambda share: bucket_count((size or 0) / 6 * share, parts or 1)

    def ask(hashes: Callable, answer: Callable, name: str, buckets: int, wide: bool) -> str:
        sent = copy.select("part", "text").mapInArrow(lambda it: _collect(it, hashes(), buckets, wide), "bucket int, part int, once binary, more binary")
        told = sent.repartitionById(buckets, F.col("bucket")).mapInArrow(_told(answer), "part int, found binary")
        told.repartition("part").write.partitionBy("part").parquet(f"{folder}/{name}")
        return f"{folder}/{name}"

    repeated = ask(lambda: lambda part, t: finder.anchors(t)[1], _repeated, "anchors", count(finder.cover.mean()), False)

    def windows() -> Callable:
        of = _answers(repeated, "<u8")
        return lambda part, t: keys(*finder.candidates(t, of(part))[1:])

    single = ask(windows, _single, "windows", count(0.5), True)

    def mark(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, alone = _answers(repeated, "<u8"), _answers(single, _KEY)
        for part, b, t in _by_part(it):
            at, h, g = finder.candidates(t, anchors(part))
            at = at[~alone(part).has(h, g)]
            gone = covered(at, at + finder.window, len(t.start))
            lost = np.bincount(t.of(np.flatnonzero(gone)), minlength=b.num_rows)
            stay = []
            for i in range(b.num_rows):
                ws = t.data[t.edge[i] : t.edge[i + 1]].tobytes().split()
                stay.append(b" ".join([w for w, x in zip(ws, gone[t.first[i] : t.first[i + 1]].tolist(), strict=True) if not x] if lost[i] else ws))
            cols = [b.column("doc_id"), pa.array(t.size, pa.int64()), pa.array(lost, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in stay])]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(stay, pa.binary()).cast(pa.string())] * with_text, ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text])

    return copy.select("doc_id", "part", "text").mapInArrow(mark, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS passage FROM w, unnest(range(1, len(ws) - 33)) u(i)),
r AS (SELECT passage FROM p GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM p SEMI JOIN r USING (passage), range(35) x(k)),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
