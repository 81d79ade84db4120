"""Tokenizer operators against the libraries, exact round trips, packing against its bound."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from llm_odd import TEXTS, documents, nothing
from tokenizers import Tokenizer

from granary.llm import bpe, chunks, packing, records
from granary.llm.common import drop_scratch, scratch
from granary.llm.queries import QUERIES

ODD = [
    " ", "a  b", " a", "a ", "\n\na\n", "x\x1c y", "it 's\xa0 ok", "　a b c d", "a\x01b c", "é" * 700 + " " + "abc" * 300, "12 345  6\t7\r\n8", "İstanbul ΣΑΣ ΟΔΟΣ. x", "日本語 のテキスト\n改行",
    "👩‍👩‍👧 ok ", "a\n b", "a \nb", "'s 't it's", "Ǆ ﬁ Å é ́x ́", "thethethe" * 400, "a., b.. c,. 1. é. 's.",
]


@pytest.fixture(scope="module")
def texts() -> list[str]:
    r = random.Random(1)
    return [t or "" for t in TEXTS] + ODD + ["".join(r.choice(" \n\t\x1c\x85\xa0abC'sé1.,|　") for _ in range(60)) for _ in range(500)]


def fuzz(n: int) -> list[str]:
    """Texts of letters whose lower case is longer or that compose in one case only, marks, white space, digits and punctuation."""
    r = random.Random(9)
    letters = ["İ", "I", "i", "\u0307", "H\u0331", "h\u0331", "T\u0308", "J\u030c", "w\u030a", "Σ", "ς", "ß", "ẞ", "é", "É", "e\u0301", "ª", "×", "÷", "ñ", "Ł", "ж", "日", "ﬁ", "Ǆ", "a", "B", "cd", "The", "ing", "S", "ll", "re", "t"]
    other = ["'", "'s", "'S", "'ll", ".", ",", "..", "$$$", "%%%", "-", "(", ")", "1", "23", "4", "½", "²", " ", " ", " ", "  ", "\n", "\n\n", "\t", "\u00a0", "\u2003", "\u0085", "\x1c", "\u200b", "\u2028"]
    return ["".join(r.choice(letters if r.random() < 0.65 else other) for _ in range(r.randint(1, 40))) for _ in range(n)]


def test_seeded_fuzz_against_the_libraries():
    """20,000 texts by all three encoders, part of them in a second round, when their chunks are known."""
    texts = fuzz(20_000)
    for name, drops in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        encode, want = chunks.library_encoder(P.path(name), drops), [e.ids for e in library(name).encode_batch(texts, add_special_tokens=False)]
        assert [t for t, g, w in zip(texts, encode(texts), want, strict=True) if np.frombuffer(g, "<u4").tolist() != w] == []
        assert [t for t, g, w in zip(texts[:4000], encode(texts[:4000]), want, strict=False) if np.frombuffer(g, "<u4").tolist() != w] == []
    b, encode = bpe.load(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=b.ranks, special_tokens={})
    assert [t for t, g in zip(texts, encode(texts), strict=True) if np.frombuffer(g, "<u4").tolist() != enc.encode_ordinary(t)] == []


def test_cache_that_overflows_gives_the_same_ids(texts, monkeypatch):
    """Chunks go from half to half and are encoded again."""
    monkeypatch.setattr(chunks, "CACHE", 50)
    monkeypatch.setattr(chunks, "POOL", 200)
    whole = chunks.library_encoder(P.path("byte_bpe_50k.json"), False)
    small = chunks.Encoder(whole.cut, whole.fold, whole.encode)
    r = random.Random(3)
    for _ in range(60):
        own = r.sample(texts, 12)
        assert small(own) == whole(own)


def library(name: str) -> Tokenizer:
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return t


def ids(name: str, texts: list[str]) -> list[np.ndarray]:
    return [np.array([*e.ids, 0], "<u4") for e in library(name).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize(("name", "drops"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_chunks_give_the_ids_of_the_whole_text(texts, name, drops):
    got = chunks.library_encoder(P.path(name), drops)(texts)
    assert [np.frombuffer(g + bytes(4), "<u4").tolist() for g in got] == [x.tolist() for x in ids(name, texts)]


def test_bpe_is_tiktoken(texts):
    b, encode = bpe.load(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=b.ranks, special_tokens={})
    got = encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [enc.encode_ordinary(t) for t in texts]
    assert [b.decode(g) for g in got] == [t.encode() for t in texts]


def test_matrix_and_heap_merge_alike():
    b, _ = bpe.load(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    r = random.Random(2)
    matches = [bytes(r.choice(b"abcdehinorst\xc3\xa9 ") for _ in range(r.randint(1, 120))) for _ in range(300)]
    matches = [m for m in dict.fromkeys(matches) if m not in b.ranks]
    assert b._matrix(sorted(matches, key=len)) == [b._heap(m) for m in sorted(matches, key=len)]


def test_pair_table_has_every_pair():
    b, _ = bpe.load(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    a, c = np.array(list(b.pairs)).T
    assert (b.rank_of(a, c) == np.array(list(b.pairs.values()))).all()
    assert (b.rank_of(np.array([-1, 5]), np.array([5, -1])) == bpe.NONE).all()


def test_bpe_query_and_odd_rows(spark, sf_dir):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = lambda t: (len(x := enc.encode_ordinary(t or "")), sha(np.array(x, "<u4").tobytes()), sha((t or "").encode()))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op7_byte_bpe"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == {i: want(t) for i, t in texts.items()}
    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    odd = bpe.encode_decode(documents(spark), ranks, P.PATTERN).collect()
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in odd) == Counter((r["doc_id"], (r["text"] or "").encode()) for r in documents(spark).collect())
    assert bpe.encode_decode(nothing(spark), ranks, P.PATTERN).count() == 0


def test_records_query(spark, sf_dir):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    own = ids("byte_bpe_50k.json", [t for _, t in docs])
    start, want = 0, {}
    for (i, _), x in zip(docs, own, strict=True):
        want[i] = (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)
    got = QUERIES["op4_token_records"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == want and len(got) == len(docs)


def test_records_of_odd_rows(spark, tmp_path):
    tok = P.path("byte_bpe_50k.json")
    folder = scratch(spark, "test")
    manifest = records.write_token_records(documents(spark), folder, tok)
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    own = ids("byte_bpe_50k.json", [t or "" for _, t in rows])
    got = sorted(records.read_token_records(manifest).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got] == [(i, len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(rows, own, strict=True)]
    # Shuffled reads by the index give the same records.
    shard = manifest.orderBy("shard").first()
    n = shard["records"]
    order = random.Random(1).sample(range(n), n)
    assert [x.tolist() for _, x in records.read_at(shard["path"], order)] == [own[k].tolist() for k in order]
    path = shard["path"].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[20] ^= 1
    bad = tmp_path / "bad.rec"
    bad.write_bytes(data)
    with pytest.raises(ValueError, match="damaged"):
        list(records.read_records(bad.open("rb")))
    drop_scratch(spark, folder)
    empty = records.write_token_records(nothing(spark), folder, tok)
    assert empty.count() == 0 and records.read_token_records(empty).count() == 0


def test_frames_and_wide_ids():
    x = np.array([0, 70_000, 2**32 - 1], "<u4")
    i, back = records.parse(records.payload(None, x))
    assert i is None and back.tolist() == x.tolist()
    assert len(records.payload(7, x[:1])) == 14 + 2 and len(records.frame(b"abc")) == 8 + 4 + 3 + 4


def check_pack(rows, want, capacity):
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == Counter(want)
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in by.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


def cut(doc_id, x, capacity):
    return [(doc_id, k, k * capacity, len(p := x[k * capacity : (k + 1) * capacity]), zlib.crc32(p.tobytes())) for k in range(-(-len(x) // capacity))]


def test_packing_query(spark, sf_dir):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    own = ids("word_bpe_49k.json", [t for _, t in docs])
    n = check_pack(QUERIES["op3_best_fit_packing"](spark, sf_dir).collect(), [c for (i, _), x in zip(docs, own, strict=True) for c in cut(i, x, 2048)], 2048)
    assert n <= -(-sum(map(len, own)) // 2048) + 1


@pytest.mark.parametrize("capacity", [7, 64, 2048])
def test_packing_of_odd_rows(spark, capacity):
    tok = P.path("word_bpe_49k.json")
    rows = [(r["doc_id"], r["text"] or "") for r in documents(spark).collect()]
    own = ids("word_bpe_49k.json", [t for _, t in rows])
    got = packing.pack(documents(spark), tok, capacity, with_ids=True).collect()
    check_pack(got, [c for (i, _), x in zip(rows, own, strict=True) for c in cut(i, x, capacity)], capacity)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    assert packing.pack(nothing(spark), tok, capacity).count() == 0


def fewest(items: list[int], capacity: int) -> int:
    """The least number of sequences, by trying them all."""
    items = sorted(items, reverse=True)
    best = len(items)

    def go(i: int, rooms: tuple[int, ...]) -> None:
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            go(i + 1, tuple(sorted((*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]))))
        go(i + 1, tuple(sorted((*rooms, capacity - items[i]))))

    go(0, ())
    return best


def test_reduction_keeps_the_optimum():
    """What is fixed plus the best for the rest is the best for all."""
    r = random.Random(4)
    for _ in range(300):
        capacity = r.randint(5, 20)
        items = [r.randint(1, capacity) for _ in range(r.randint(1, 9))]
        fixed, left = packing.reduce_instance(dict(Counter(items)), capacity)
        rest = [s for s, n in left.items() for _ in range(n)]
        used = Counter(rest)
        for m, held in fixed:
            assert sum(s * q for s, q in held) <= capacity
            for s, q in held:
                used[s] += m * q
        assert used == Counter(items)
        assert sum(m for m, _ in fixed) + (fewest(rest, capacity) if rest else 0) == fewest(items, capacity)


def test_best_fit_of_counts_is_best_fit_of_pieces():
    r = random.Random(5)
    for _ in range(200):
        capacity = r.randint(5, 60)
        items = [r.randint(1, capacity) for _ in range(r.randint(0, 60))]
        rooms: list[int] = []
        for s in sorted(items, reverse=True):
            fit = [x for x in rooms if x >= s]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else capacity) - s)
        runs = packing.best_fit(dict(Counter(items)), capacity)
        assert sorted(capacity - sum(s * q for s, q in held) for m, held in runs for _ in range(m)) == sorted(rooms)


def test_vocabularies_are_where_the_parameter_says():
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    assert len(ranks) == 50_256 and base64.b64encode(bytes([0]))


def morse(n: int, a: str = "a", b: str = "b") -> str:
    """A Thue-Morse word of n letters: sums of its letters times powers of any number are those of the word with a and b exchanged,
    modulo a power of two that grows with the square of the logarithm of n."""
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


def morse_texts() -> list[str]:
    return [f"x {morse(n, *ab)} y" for n in (64, 512, 1024, 2048, 4096, 8192) for ab in (("a", "b"), ("b", "a"), ("c", "a"), ("q", "Q"))]


def test_words_of_one_polynomial_have_their_own_ids(spark):
    texts = morse_texts()
    for name, drops in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        got = chunks.library_encoder(P.path(name), drops)(texts)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in library(name).encode_batch(texts, add_special_tokens=False)]
    path = P.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    assert {r.doc_id: (list(r.ids), bytes(r.decoded).decode()) for r in bpe.encode_decode(docs, path, P.PATTERN).collect()} == {i: (enc.encode_ordinary(t), t) for i, t in enumerate(texts)}


def test_chunks_of_one_hash_have_their_own_ids(texts, monkeypatch):
    """With hashes of three bits nearly all chunks meet others of their hash, within a batch, in the young and in the old half."""
    full = chunks.byte_hashes
    monkeypatch.setattr(chunks, "byte_hashes", lambda *a: full(*a) & np.uint64(7))
    monkeypatch.setattr(chunks, "CACHE", 60)
    for name, drops in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        whole = chunks.library_encoder(P.path(name), drops)
        small, own = chunks.Encoder(whole.cut, whole.fold, whole.encode), texts[:12] + ODD + morse_texts()[:8]
        want = [e.ids for e in library(name).encode_batch(own, add_special_tokens=False)]
        for at in (0, 7, 0):
            assert [np.frombuffer(g, "<u4").tolist() for x in range(at, len(own), 5) for g in small(own[x : x + 5])] == want[at:]
