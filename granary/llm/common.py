"""What the operators of this subpackage share: scratch tables, batches of texts, word splitting.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D. ``bytes.split()`` cuts at exactly those six bytes, so a
UTF-8 text is split without a regular expression. Where a batch's words are only hashed they never become Python objects: ranges
of bytes are found by numpy and hashed eight bytes at a time. Sums of bytes times powers of an odd number (``range_hashes``) are
for features alone, where two words may share a number; they do not tell texts apart.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that carries texts; with whole texts of a few KB a batch stays at some MB.
TEXT_BATCH = 512


def ship(spark: SparkSession) -> None:
    """Let local Python workers import this package from where it lies; on a cluster it goes by --py-files as usual."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and Spark is local."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="granary-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What is planned and run in here leaves no shuffle files: Spark drops them as the query ends, and not when the driver happens to
    collect its garbage. For frames that run once; one that was made before keeps its own way, and a ``select("*")`` makes it anew."""
    before = spark.conf.get(_SWEEP, "false")
    spark.conf.set(_SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.set(_SWEEP, before)


def kept(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a narrow table: it cuts the lineage and survives lost executors, and its shuffle files go at once.
    Spark's cleaner drops its own files with the last reference to it, as the running context is told so here; by default it would
    leave them."""
    spark = df.sparkSession
    shared_dir(spark)
    spark.sparkContext._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    with swept(spark):
        return df.select("*").checkpoint(eager=True)


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/granary-{what}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder through Hadoop's file system, wherever it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns named by their place, and what the given ones are called there.

    Columns are taken by their exact names, so others may have any name, one that differs in case alone too.
    """
    missing = [n for n in names if n not in docs.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} among {', '.join(docs.columns)}")
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), [f"c{docs.columns.index(n)}" for n in names]


def id_and_text(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string), whatever other columns there are."""
    own, (doc_id, text) = numbered(docs, "doc_id", "text")
    return own.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def text_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small; the setting is read when a plan is made."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH))


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8, null as empty, without decoding."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    return text.split()


#: Bytes of texts that are worked on at once, each of which takes some hundred bytes on the way; a longer text is worked on alone.
PIECE = 1 << 19


def pieces(it: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of each batch whose texts have at most PIECE bytes, or one row, with the bytes and edges of their texts."""
    for b in it:
        if not b.num_rows:
            continue
        data, edge = raw_texts(b.column(column))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(edge, edge[i] + PIECE, "right")) - 1)
            yield b.slice(i, j - i), data[edge[i] : edge[j]], edge[i : j + 1] - edge[i]
            i = j


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text modulo 5 is 0; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def batches(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each batch that has rows, with the texts of its column ``text``."""
    for b in it:
        if b.num_rows:
            yield b, utf8(b.column("text"))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_MULTIPLIERS = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier modulo 2^64 and of its inverse, n at least."""
    if which not in _powers or len(_powers[which][0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        up = np.full(size, np.uint64(_MULTIPLIERS[which]))
        down = np.full(size, np.uint64(pow(_MULTIPLIERS[which], -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers[which] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[which]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column in a row, and where each starts, with the end; null as empty."""
    c = column.cast(pa.large_binary())
    if c.null_count:
        c = c.fill_null(b"")
    edge = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
    data = np.frombuffer(c.buffers()[2] or b"", np.uint8)[edge[0] : edge[-1]]
    return data, edge - edge[0]


def word_ranges(data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each text, with the end; no word goes over a text's edge."""
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[edge] = True
    before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(start, edge)


#: Bytes whose sums are taken at once; a longer range has its hash from elsewhere.
SEGMENT = 1 << 16


def segments(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[slice, int, int]]:
    """Ascending ranges in blocks that span at most SEGMENT bytes, or one longer range: which ranges, and the bytes they span."""
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SEGMENT, "right")))
        yield slice(i, j), int(start[i]), int(end[j - 1])
        i = j


def running(data: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of (byte + 1) times powers up to each place, and the inverse powers: a range's hash is (sums[b] - sums[a]) * down[a]."""
    up, down = powers(which, max(SEGMENT, len(data)) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return total, down


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each range; ranges ascend and do not overlap. Equal bytes have equal hashes in all batches."""
    out = np.empty(len(start), np.uint64)
    for at, lo, hi in segments(data, start, end):
        if hi - lo > SEGMENT:
            out[at] = xxhash.xxh64_intdigest(data[lo:hi].tobytes(), which)
            continue
        total, down = running(data[lo:hi], which)
        a, b = start[at] - lo, end[at] - lo
        out[at] = mix((total[b] - total[a]) * down[a])
    return out


#: Ranges of up to so many bytes are hashed and compared by numpy, eight bytes at a time; longer ones each for itself.
WIDE = 64
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; ``data`` ends with eight bytes to spare."""
    return np.ndarray(len(data) - 7, np.dtype("<u8"), data, strides=(1,))


def spare(data: np.ndarray) -> np.ndarray:
    return np.append(data, np.zeros(8, np.uint8))


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each range: each eight bytes go through a mixing permutation with what came before.

    ``data`` has eight bytes to spare. Equal bytes have equal hashes in all batches; ``which`` gives independent ones.
    """
    size = end - start
    out = mix(size.astype(np.uint64) + _STEP[which])
    eight = lanes(data)
    todo = np.flatnonzero((size > 0) & (size <= WIDE))
    at, left, h = start[todo], size[todo], out[todo]
    while len(todo):
        h = mix((h ^ (eight[at] & _MASK[np.minimum(left, 8)])) * _STEP[1 - which] + _STEP[which])
        out[todo] = h
        go = left > 8
        todo, at, left, h = todo[go], at[go] + 8, left[go] - 8, h[go]
    for i in np.flatnonzero(size > WIDE).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]], which)
    return out


def same_bytes(a: np.ndarray, at: np.ndarray, b: np.ndarray, by: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes of ``a`` from each ``at`` are those of ``b`` from ``by``; both have eight bytes to spare."""
    out = np.ones(len(size), bool)
    x, y = lanes(a), lanes(b)
    todo, done = np.flatnonzero((size > 0) & (size <= WIDE)), 0
    while len(todo):
        left = size[todo] - done
        differ = ((x[at[todo] + done] ^ y[by[todo] + done]) & _MASK[np.minimum(left, 8)]) != 0
        out[todo[differ]] = False
        todo, done = todo[(left > 8) & ~differ], done + 8
    for i in np.flatnonzero(size > WIDE).tolist():
        out[i] = np.array_equal(a[at[i] : at[i] + size[i]], b[by[i] : by[i] + size[i]])
    return out


_at_work: dict[str, Callable[[], None]] = {}


def at_work(what: str, forget: Callable[[], None] = lambda: None) -> None:
    """Tell that from now on this worker remembers things of one kind, and how they are let go of.

    A worker serves all operators of a session in turn. What it remembers for the last one would stay beside what the next one
    does, until the worker ends; so that goes first, and with it the memory that Arrow keeps for later.
    """
    if what not in _at_work:
        for other in _at_work.values():
            other()
        _at_work.clear()
        _at_work[what] = forget
        pa.default_memory_pool().release_unused()


class Memo(dict):
    """What a function gives for a word, remembered: when ``size`` words are known they become the old ones, and words that are
    met again move back, so common words stay however many rare ones go by."""

    def __init__(self, of: Callable[[bytes], int], size: int):
        self.of, self.size, self.old = of, size, {}

    def __missing__(self, w: bytes) -> int:
        v = self.old.get(w)
        v = self[w] = self.of(w) if v is None else v
        return v

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def array(self, ws: list[bytes]) -> np.ndarray:
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


class Grouped:
    """Complete groups from batches that are sorted by their key columns; a group may go over the edge of a batch.

    Feed it the stream; it gives arrays of all columns that hold whole groups only, with the start of each group.
    """

    def __init__(self, keys: int):
        self.keys = keys

    def __call__(self, it: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        rest: list[np.ndarray] | None = None
        for b in it:
            if not b.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if rest is not None:
                cols = [np.concatenate([r, c]) for r, c in zip(rest, cols, strict=True)]
            new = np.zeros(len(cols[0]), bool)
            new[0] = True
            for c in cols[: self.keys]:
                new[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(new)
            last = starts[-1]
            rest = [c[last:] for c in cols]
            if last:
                yield [c[:last] for c in cols], starts[:-1]
        if rest is not None and len(rest[0]):
            yield rest, np.zeros(1, np.int64)
