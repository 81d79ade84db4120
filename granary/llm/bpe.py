"""Byte-level BPE by rank, in length-bucketed padded numpy matrices.

Each row of a matrix is a match of the pattern as byte tokens. In each round every row merges its leftmost pair of least rank;
pairs are looked up in an open-addressing hash table; rows that have no pair left are taken out and the matrix is compacted.
Matches of over ``LONG`` bytes use a heap that makes the same merges in the same order, so that one long run of letters costs
n log n. Distinct chunks of text (see chunks.py) are encoded once per worker. Decoding copies the bytes of all ids at once.

Rows: a null text is empty; the ids of a row depend on its text alone.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .chunks import Encoder, cut_attached
from .common import at_work, id_and_text, table, text_batches

NONE = np.int32(2**31 - 1)
#: Rows of a matrix and bytes of a match that goes into one.
ROWS, LONG = 8192, 256
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        token = {rank: token for token, rank in ranks.items()}
        size = np.array([len(token.get(rank, b"")) for rank in range(max(token) + 1)])
        self.token_at, self.token_size, self.token_bytes = np.cumsum(size) - size, size, np.frombuffer(b"".join(token[rank] for rank in sorted(token)), np.uint8)
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = {(a, b): rank for token, rank in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None}
        self._hash()

    def _hash(self) -> None:
        """Keys and ranks by open addressing at a load of a quarter at most; ``probes`` is the longest chain."""
        bits = max(4, (4 * len(self.pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values, self.probes = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32), 1
        key = np.array([a << 32 | b for a, b in self.pairs], np.int64)
        value = np.fromiter(self.pairs.values(), np.int32, len(self.pairs))
        at = self._slot(key)
        while len(key):
            free = self.keys[at] == -1
            _, one = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[one]
            self.keys[at[put]], self.values[at[put]] = key[put], value[put]
            rest = np.ones(len(key), bool)
            rest[put] = False
            key, value, at = key[rest], value[rest], (at[rest] + 1) & (len(self.keys) - 1)
            self.probes += bool(len(key))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _GOLDEN) >> self.shift).astype(np.int64)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE where it does not merge or an end is padding (-1)."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        key[(a < 0) | (b < 0)] = -2
        at, out, todo = self._slot(key), np.full(len(key), NONE, np.int32), np.arange(len(key))
        for _ in range(self.probes):
            got = self.keys[at]
            hit = got == key[todo]
            out[todo[hit]] = self.values[at[hit]]
            go = ~hit & (got != -1)
            if not go.any():
                break
            todo, at = todo[go], (at[go] + 1) & (len(self.keys) - 1)
        return out

    def _matrix(self, matches: list[bytes]) -> list[bytes]:
        width, n = max(map(len, matches)), len(matches)
        size = np.fromiter(map(len, matches), np.int64, n)
        tokens = np.full((n, width + 1), -1, np.int32)
        inside = np.arange(width + 1) < size[:, None]
        tokens[inside] = self.first[np.frombuffer(b"".join(matches), np.uint8)]
        ranks = np.full((n, width + 1), NONE, np.int32)
        ranks[:, :width] = self.rank_of(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(n, width)
        out: list[bytes] = [b""] * n
        row = np.arange(n)
        cols = np.arange(width + 1)
        while len(row):
            at = ranks.argmin(1)
            each = np.arange(len(row))
            least = ranks[each, at]
            done = least == NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[row[i]] = tokens[i][tokens[i] >= 0].astype("<u4").tobytes()
                go = ~done
                row, tokens, ranks, at, least = row[go], tokens[go], ranks[go], at[go], least[go]
                if not len(row):
                    break
                used = int((tokens >= 0).sum(1).max()) + 1
                tokens, ranks, cols, each = tokens[:, :used].copy(), ranks[:, :used].copy(), cols[:used], np.arange(len(row))
            tokens[each, at] = least
            after = cols[None, :-1] > at[:, None]
            tokens[:, :-1] = np.where(after, tokens[:, 1:], tokens[:, :-1])
            ranks[:, :-1] = np.where(after, ranks[:, 1:], ranks[:, :-1])
            tokens[:, -1], ranks[:, -1] = -1, NONE
            ranks[each, at] = self.rank_of(tokens[each, at], tokens[each, np.minimum(at + 1, len(cols) - 1)])
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.rank_of(tokens[before, at[before] - 1], tokens[before, at[before]])
        return out

    def _heap(self, match: bytes) -> bytes:
        token = self.first[np.frombuffer(match, np.uint8)].tolist()
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pairs
        heap = [(r, i) for i in range(n - 1) if (r := pairs.get((token[i], token[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if token[i] < 0 or (j := after[i]) >= n or pairs.get((token[i], token[j])) != r:
                continue
            token[i], token[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := pairs.get((r, token[after[i]]))) is not None:
                    heapq.heappush(heap, (x, i))
            if before[i] >= 0 and (x := pairs.get((token[before[i]], r))) is not None:
                heapq.heappush(heap, (x, before[i]))
        return array("I", [t for t in token if t >= 0]).tobytes()

    def encode_matches(self, matches: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each distinct match."""
        out: dict[bytes, bytes] = {}
        todo = []
        for m in set(matches):
            if (rank := self.ranks.get(m)) is not None:
                out[m] = rank.to_bytes(4, "little")
            elif len(m) > LONG:
                out[m] = self._heap(m)
            else:
                todo.append(m)
        todo.sort(key=len)
        start = 0
        while start < len(todo):  # buckets: lengths within a quarter of each other, a bounded number of rows
            end = start
            while end < len(todo) and end - start < ROWS and len(todo[end]) <= len(todo[start]) * 5 // 4 + 1:
                end += 1
            out |= zip(todo[start:end], self._matrix(todo[start:end]), strict=True)
            start = end
        return out

    def encode_chunks(self, chunks: list[str]) -> Iterable[bytes]:
        cut = [[m.encode() for m in self.pattern.findall(c)] for c in chunks]
        ids = self.encode_matches([m for ms in cut for m in ms])
        return [b"".join(map(ids.__getitem__, ms)) for ms in cut]

    def decode(self, ids: bytes) -> bytes:
        return self.decode_all(np.frombuffer(ids, "<u4"))[0].tobytes()

    def decode_all(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and how many bytes lie before each, with the end."""
        size = self.token_size[ids]
        end = np.append(0, np.cumsum(size))
        place = np.repeat(self.token_at[ids] - end[:-1], size)
        place += np.arange(len(place))
        return self.token_bytes[place], end


_loaded: dict[tuple[str, str], tuple[Bpe, Encoder]] = {}


def load(path: str, pattern: str) -> tuple[Bpe, Encoder]:
    """One per worker, until another operator is at work there."""
    at_work(f"{path} {pattern}", _loaded.clear)
    if (path, pattern) not in _loaded:
        bpe = Bpe(read_ranks(path), pattern)
        _loaded[path, pattern] = bpe, Encoder(cut_attached, False, bpe.encode_chunks)
    return _loaded[path, pattern]


def _round_trip(path: str, pattern: str, full: bool) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = load(path, pattern)
        for b, ids, first in encoder.texts(it):
            back, at = bpe.decode_all(ids)
            own = [ids[i:j] for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            texts = [back[i:j] for i, j in zip(at[first[:-1]].tolist(), at[first[1:]].tolist(), strict=True)]
            if full:
                cols = [pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())), pa.array([x.tobytes() for x in texts], pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "ids", "decoded"])
                continue
            cols = [pa.array(np.diff(first), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in own]), pa.array([hashlib.sha256(x).hexdigest() for x in texts])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_decode(docs: DataFrame, ranks: str, pattern: str, digests: bool = False) -> DataFrame:
    """(doc_id, ids, decoded), or (doc_id, n_tokens, ids_sha256, decoded_sha256) with ``digests``."""
    text_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, decoded binary"
    return id_and_text(docs).mapInArrow(_round_trip(ranks, pattern, not digests), schema)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
