"""Texts cut where a tokenizer cuts them anyway, so that each distinct chunk is encoded once per worker.

Byte-level patterns take a space with the word that follows it and a lone line feed by itself, so a text may be cut before a
single space and around a single line feed that stand between other characters. A text with two white-space characters in a row,
or with other white space than these two, is cut only before single spaces between non-spaces. A tokenizer that drops white
space may be cut at every space and line feed. Either kind of pattern also ends a match where letters, digits and punctuation
meet, but for apostrophes; here that is used between ASCII and Latin-1 letters, ASCII digits and ASCII punctuation, which no
normaliser changes. The tests hold chunked ids against those of the whole text.

Chunks are ranges of bytes, found by numpy and looked up by a hash; the cache keeps their bytes, and a chunk is another's like only
if all its bytes are the same. A chunk that was met before never becomes a Python object: its ids are copied from a pool.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

from .common import at_work, byte_hashes, pieces, raw_texts, same_bytes, spare

#: Chunks in either half of a worker's cache, and ids and bytes in either half: bounds on memory, not on what is encoded.
CACHE, POOL, BYTES = 400_000, 4_000_000, 16 << 20
_RUNS = re.compile(r"\s\s")
_SINGLE = re.compile(r"(?<=\S)(?= \S)")
_SPACE, _LINE, _QUOTE = 0x20, 0x0A, 0x27


def _classes() -> np.ndarray:
    """1 letters, 2 digits, 3 punctuation but for apostrophes, 0 all else."""
    out = np.zeros(256, np.uint8)
    for b in range(0x21, 0x7F):
        out[b] = 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 if b != _QUOTE else 0
    return out


_CLASS = _classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Control characters but for the line feed, and the first bytes of all white space beyond ASCII.
_OTHER = np.zeros(256, bool)
_OTHER[[*range(0x0A), *range(0x0B, 0x20), 0x7F]] = True


def _odd_places(data: np.ndarray) -> np.ndarray:
    """Where something stands that single spaces and line feeds between other characters are not; white space beyond ASCII
    starts with C2 85, C2 A0, E1 9A, E2 80, E2 81 or E3 80."""
    blank = (data == _SPACE) | (data == _LINE)
    odd = _OTHER[data]
    odd[1:] |= blank[1:] & blank[:-1]
    a, b = data[:-1], data[1:]
    odd[:-1] |= ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80))
    return np.flatnonzero(odd)


def _class_cuts(data: np.ndarray) -> np.ndarray:
    """True before a byte that starts another class than the byte before it; letters of Latin-1 count with both their bytes."""
    c = _CLASS[data]
    latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
    c[latin] = c[latin + 1] = 1
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (c[1:] != c[:-1]) & (c[1:] > 0) & (c[:-1] > 0)
    return cut


def cut_attached(data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each chunk, for patterns that attach a space to the next word."""
    cut = _class_cuts(data)
    cut[:-1] |= (data == _SPACE) | (data == _LINE)
    cut[1:] |= data == _LINE
    cut[edge] = True
    for i in np.unique(np.searchsorted(edge, _odd_places(data), "right") - 1).tolist():
        a, b = int(edge[i]), int(edge[i + 1])
        text = data[a:b].tobytes().decode()
        cut[a + 1 : b] = False
        if _RUNS.search(text):
            sizes = [len(x.encode()) for x in _SINGLE.split(text)]
            cut[a + np.cumsum(sizes)] = True
        else:  # other white space, but none beside white space
            own = data[a:b]
            cut[a:b] |= (own == _SPACE) | (own == _LINE)
            cut[a + 1 : b + 1] |= own == _LINE
    at = np.flatnonzero(cut)
    return at[:-1], at[1:]


def cut_dropped(data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For tokenizers that drop white space and case."""
    blank = (data == _SPACE) | (data == _LINE)
    cut = _class_cuts(data)
    cut[:-1] |= blank
    cut[1:] |= blank
    cut[edge] = True
    at = np.flatnonzero(cut)
    start, end = at[:-1], at[1:]
    own = ~blank[start]
    return start[own], end[own]


class Chunks:
    """Ranges of some bytes, which have eight to spare, with a hash of each."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, h: np.ndarray):
        self.data, self.start, self.size, self.h = data, start, size, h

    def __len__(self) -> int:
        return len(self.start)

    def __getitem__(self, which: np.ndarray) -> Chunks:
        return Chunks(self.data, self.start[which], self.size[which], self.h[which])

    def same(self, other: Chunks) -> np.ndarray:
        """Which chunks have the bytes of the other's in their place."""
        out = (self.h == other.h) & (self.size == other.size)
        at = np.flatnonzero(out)
        out[at] = same_bytes(self.data, self.start[at], other.data, other.start[at], self.size[at])
        return out


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """At least n places, twice as many where there are not."""
    return x if n <= len(x) else np.append(x, np.zeros(max(n - len(x), len(x)), x.dtype))


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of ranges, in a row."""
    end = np.cumsum(size)
    place = np.repeat(start - (end - size), size)
    place += np.arange(len(place))
    return place


class Table:
    """Ids of chunks in an open-addressing table by hash; bytes and ids lie in a row in pools."""

    def __init__(self) -> None:
        self.slots = np.full(1 << (2 * CACHE - 1).bit_length(), -1, np.int32)
        self.own = Chunks(np.zeros(4 * CACHE + 8, np.uint8), np.zeros(CACHE, np.int64), np.zeros(CACHE, np.int64), np.zeros(CACHE, np.uint64))
        self.at, self.size = np.zeros(CACHE, np.int64), np.zeros(CACHE, np.int64)
        self.pool = np.zeros(POOL, "<u4")
        self.n, self.used, self.held = 0, 0, 0

    def find(self, chunks: Chunks) -> np.ndarray:
        """The number of each chunk, -1 where it is not known."""
        out = np.full(len(chunks), -1, np.int64)
        if not self.n:
            return out
        todo = np.arange(len(chunks))
        mask = np.uint64(len(self.slots) - 1)
        slot = chunks.h & mask
        while len(todo):
            got = self.slots[slot]
            there = got >= 0
            todo, slot, got = todo[there], slot[there], got[there]
            same = chunks[todo].same(self.own[got])
            out[todo[same]] = got[same]
            todo, slot = todo[~same], (slot[~same] + np.uint64(1)) & mask
        return out

    def put(self, chunks: Chunks, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Take in chunks that are not known yet and differ in their hash; their numbers."""
        n, own = len(chunks), self.own
        number = np.arange(self.n, self.n + n)
        total, wide = self.used + len(ids), self.held + int(chunks.size.sum())
        self.at, self.size, self.pool = _room(self.at, self.n + n), _room(self.size, self.n + n), _room(self.pool, total)
        own.start, own.size, own.h, own.data = _room(own.start, self.n + n), _room(own.size, self.n + n), _room(own.h, self.n + n), _room(own.data, wide + 8)
        self.at[number], self.size[number] = self.used + np.cumsum(size) - size, size
        own.start[number], own.size[number], own.h[number] = self.held + np.cumsum(chunks.size) - chunks.size, chunks.size, chunks.h
        self.pool[self.used : total] = ids
        own.data[self.held : wide] = chunks.data[_runs(chunks.start, chunks.size)]
        self.n, self.used, self.held = self.n + n, total, wide
        if 2 * self.n > len(self.slots):
            self.slots = np.full(1 << (4 * self.n - 1).bit_length(), -1, np.int32)
            self._place(np.arange(self.n))
        else:
            self._place(number)
        return number

    def _place(self, number: np.ndarray) -> None:
        mask = np.uint64(len(self.slots) - 1)
        slot = self.own.h[number] & mask
        while len(number):
            free = np.flatnonzero(self.slots[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.slots[slot[won]] = number[won]
            rest = np.ones(len(number), bool)
            rest[won] = False
            number, slot = number[rest], (slot[rest] + np.uint64(1)) & mask

    @property
    def full(self) -> bool:
        return self.n > CACHE or self.used > POOL or self.held > BYTES

    def ids(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks in a row, and how many each has."""
        size = self.size[number]
        return self.pool[_runs(self.at[number], size)], size


class Encoder:
    """Ids of texts by way of a cache of chunks.

    The cache has a young and an old half: when the young one is full it becomes the old one, and chunks that are met again move
    back, so common chunks stay however many rare ones go by.
    """

    def __init__(self, cut: Callable, fold: bool, encode: Callable[[list[str]], Iterable[bytes]]):
        #: fold: whether ASCII letters count alike in either case.
        self.cut, self.fold, self.encode = cut, fold, encode
        self.young, self.old = Table(), Table()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        ids, first = self.ids(*raw_texts(pa.array(texts, pa.string())))
        return [ids[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]

    def ids(self, data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's start, with the end."""
        if self.young.full:
            self.young, self.old = Table(), self.young
        start, end = self.cut(data, edge)
        keyed = spare(self._keyed(data, start, end))
        chunks = Chunks(keyed, start, end - start, byte_hashes(keyed, start, end))
        number = self.young.find(chunks)
        lost = np.flatnonzero(number < 0)
        while len(lost):  # once, but for different chunks of one hash
            _, first, each = np.unique(chunks.h[lost], return_index=True, return_inverse=True)
            one = lost[first]
            took = np.full(len(one), -1)
            known = self.old.find(chunks[one])
            if len(met := np.flatnonzero(known >= 0)):
                took[met] = self.young.put(chunks[one[met]], *self.old.ids(known[met]))
            if len(new := np.flatnonzero(known < 0)):
                got = list(self.encode([data[a:b].tobytes().decode() for a, b in zip(start[one[new]].tolist(), end[one[new]].tolist(), strict=True)]))
                size = np.fromiter(map(len, got), np.int64, len(got)) // 4
                took[new] = self.young.put(chunks[one[new]], np.frombuffer(b"".join(got), "<u4"), size)
            same = chunks[lost].same(chunks[one[each]])
            number[lost[same]] = took[each[same]]
            lost = lost[~same]
        ids, size = self.young.ids(number)
        return ids, np.append(0, np.cumsum(size))[np.searchsorted(start, edge)]

    def texts(self, it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Runs of rows with the ids of their column ``text``, and where each row's start, with the end."""
        for b, data, edge in pieces(it):
            yield b, *self.ids(data, edge)

    def _keyed(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The bytes that tell chunks apart. Case is folded only where all letters are of Latin-1: beyond it some letters have a
        composed form in one case only, so what a normaliser makes of a chunk can depend on its case."""
        if not self.fold:
            return data
        out = _LOWER[data]
        beyond = np.append(0, np.cumsum(data >= 0xC4))
        for i in np.flatnonzero(beyond[end] > beyond[start]).tolist():
            out[start[i] : end[i]] = data[start[i] : end[i]]
        return out


def with_end(ids: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """An id more at the end of each text."""
    return np.insert(ids, first[1:], end), first + np.arange(len(first))


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones as they are, others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


_LETTERS = _byte_letters()
#: Words of letters below this are one match of the patterns in every version of Unicode's tables.
_BEYOND = "ɐ"


def _simple(chunk: str) -> bool:
    """Whether a chunk is letters only, but for a space in front: one match, which the library's model can take at once."""
    word = chunk[1:] if chunk[:1] == " " else chunk
    return word.isalpha() and (word.isascii() or max(word) < _BEYOND)


_encoders: dict[tuple, Encoder] = {}


def library_encoder(path: str, drops_space: bool) -> Encoder:
    """By the tokenizers library; one per worker, until another one or another operator is at work there.

    Single words go straight to the library's model, after its normaliser; all else goes through the library's whole chain.
    """
    at_work(f"{path} {drops_space}", _encoders.clear)
    if (path, drops_space) not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True  # their strings in a text are ordinary text
        tokenize, normal = t.model.tokenize, t.normalizer

        def one(chunk: str) -> bytes | None:
            """Ids of a chunk that is simple before and after the normaliser, else nothing."""
            if not _simple(chunk):
                return None
            word = chunk
            if normal is not None:
                word = word.lower() if word.isascii() else normal.normalize_str(word)
                if not _simple(word):
                    return None
            word = word.replace(" ", "Ġ") if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
            return array("I", [x.id for x in tokenize(word)]).tobytes()

        def encode(chunks: list[str]) -> Iterable[bytes]:
            out = [one(c) for c in chunks]
            rest = [i for i, x in enumerate(out) if x is None]
            for i in range(0, len(rest), 4096):
                own = rest[i : i + 4096]
                for k, e in zip(own, t.encode_batch_fast([chunks[k] for k in own], add_special_tokens=False), strict=True):
                    out[k] = array("I", e.ids).tobytes()
            return out

        _encoders[path, drops_space] = Encoder(cut_dropped if drops_space else cut_attached, drops_space, encode)
    return _encoders[path, drops_space]
