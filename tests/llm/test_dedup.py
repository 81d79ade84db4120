"""Exact, near and substring duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from llm_odd import documents, nothing, prose


from granary.llm import exact, near, simhash, substring
from granary.llm.common import byte_hashes, spare
from granary.llm.components import connected_components
from granary.llm.queries import ORACLE_SQL, QUERIES


def collected(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_exact_dedup_is_what_sql_says(spark, sf_dir, duck):
    from compare import rows

    assert rows(QUERIES["op9_exact_dedup"](spark, sf_dir).toPandas()) == rows(duck.sql(ORACLE_SQL["op9_exact_dedup"]).df())


def test_exact_dedup_of_odd_rows(spark):
    docs = documents(spark)
    got = exact.duplicates(docs).collect()
    groups = defaultdict(list)
    for r in docs.collect():
        groups[r["text"] or ""].append(r["doc_id"])
    by_digest = {hashlib.sha256(t.encode()).digest(): ids for t, ids in groups.items()}
    assert len(got) == docs.count()
    for r in got:
        ids = by_digest[bytes(r["digest"])]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
    assert Counter(bytes(r["digest"]) for r in got if r["kept"]) == Counter(by_digest.keys())
    left = exact.drop_duplicates(docs)
    assert left.columns == docs.columns and sorted((r["text"] or "") for r in left.collect()) == sorted(groups)
    assert exact.duplicates(nothing(spark)).count() == 0 and exact.drop_duplicates(nothing(spark)).count() == 0


def test_misra_gries_holds_every_heavy_digest(spark):
    random.seed(1)
    values = [b"hot"] * 4000 + [b"warm"] * 900 + [str(random.random()).encode() for _ in range(6000)]
    random.shuffle(values)
    d = spark.createDataFrame([(v,) for v in values], "digest binary").repartition(7)
    found = {bytes(r["digest"]): r["n"] for r in exact.heavy_candidates(d).collect()}
    assert len(found) <= exact.COUNTERS and {b"hot", b"warm"} <= set(found) and found[b"hot"] <= 4000


def plain_fingerprint(text: str | None) -> int:
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    grams = [b" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows: list[tuple[int, int]]) -> dict[int, int]:
    """The smallest id that each fingerprint reaches, by brute force."""
    fps = sorted({f for _, f in rows})
    par = {f: f for f in fps}

    def find(f):
        while par[f] != f:
            f = par[f]
        return f

    x = np.array(fps, np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 4):
            par[find(fps[j])] = find(f)
    least = {}
    for i, f in rows:
        least[find(f)] = min(i, least.get(find(f), i))
    return {f: least[find(f)] for f in fps}


def test_simhash_query(spark, sf_dir):
    got = collected(QUERIES["op1_simhash"](spark, sf_dir), "doc_id", "fingerprint", "component_id")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {i: f for i, f, _ in got} == {i: f"{plain_fingerprint(t):016x}" for i, t in texts.items()}
    want = plain_components([(i, int(f, 16)) for i, f, _ in got])
    assert all(c == want[int(f, 16)] for _, f, c in got) and len(got) == len(texts)


def test_simhash_of_odd_rows(spark):
    docs = documents(spark)
    got = collected(simhash.near_duplicates(docs), "doc_id", "fp", "component_id")
    assert len(got) == docs.count()
    assert Counter((i, f % (1 << 64)) for i, f, _ in got) == Counter((r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect())
    want = plain_components([(i, f % (1 << 64)) for i, f, _ in got if i is not None])
    assert all(c == (None if i is None else want[f % (1 << 64)]) for i, f, c in got)
    assert simhash.near_duplicates(nothing(spark)).count() == 0
    assert simhash.drop_near_duplicates(docs).columns == docs.columns


def test_tally_rejects_pairs_before_their_bits_are_counted(monkeypatch):
    """In a list of fingerprints that share a triple and no more bytes no pair is verified; one more shared byte brings it there."""
    triple = 0
    rest = simhash._rest(triple)
    fp = np.array([sum((17 * k + p) % 256 << 8 * p for p in rest) for k in range(200)], np.uint64)
    seen, count = [], np.bitwise_count
    monkeypatch.setattr(simhash.np, "bitwise_count", lambda x: seen.append(len(x)) or count(x))
    at, key = np.zeros(20, np.int64), np.full(20, triple)
    assert simhash.forest(fp, triple) == [] and simhash._tallied(fp[:20], at, key)[0].tolist() == [] and sum(seen) == 0
    fp[7] = fp[5] ^ np.uint64(0b111 << 8 * rest[0])
    assert [(a.tolist(), b.tolist()) for a, b in simhash.forest(fp, triple)] == [([fp[5]], [fp[7]])]
    a, b = simhash._tallied(fp[:20], at, key)
    assert (a.tolist(), b.tolist()) == ([5], [7])


@pytest.mark.parametrize("block", [4096, 64])
def test_links_lose_no_component(spark, block, monkeypatch):
    """Dense groups, chains and chance neighbours; with a small block long lists are dealt out."""
    monkeypatch.setattr(simhash, "LIST_BLOCK", block)
    r = random.Random(3)
    fps = {0, 1, (1 << 64) - 1}
    for _ in range(30):
        f = r.getrandbits(64)
        for _ in range(40):
            fps.add(f)
            for b in r.sample(range(64), r.choice((1, 2, 4, 5))):
                f ^= 1 << b
    centre = r.getrandbits(64)
    for _ in range(600):
        f = centre
        for b in r.sample(range(64), r.choice((1, 2, 3))):
            f ^= 1 << b
        fps.add(f)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    pairs = found.collect()
    assert all(bin((p["a"] ^ p["b"]) & ((1 << 64) - 1)).count("1") <= 4 for p in pairs)
    roots = {p["node"]: p["root"] for p in connected_components(found).collect()}
    want = plain_components([(i, f % (1 << 64)) for i, f in enumerate(signed)])
    same = defaultdict(set)
    for f in signed:
        same[want[f % (1 << 64)]].add(roots.get(f, f))
    assert all(len(s) == 1 for s in same.values()) and len({next(iter(s)) for s in same.values()}) == len(same)


def test_triples_cover_every_four_positions():
    from itertools import combinations

    assert len(simhash.TRIPLES) == 20
    assert all(any(set(t) <= set(four) for t in simhash.TRIPLES) for four in combinations(range(8), 4))


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}}


def plain_removal(texts: list[str], window: int) -> list[tuple[int, int, str]]:
    ws = [t.encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in ws for i in range(len(w) - window + 1))
    out = []
    for w in ws:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


def test_substring_query(spark, sf_dir):
    got = {r[0]: r[1:] for r in collected(QUERIES["op8_substring_dedup"](spark, sf_dir), "doc_id", "n_words", "n_removed", "kept_sha256")}
    docs = sorted(collected(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))
    assert got == dict(zip((i for i, _ in docs), plain_removal([t or "" for _, t in docs], 35), strict=True))


@pytest.mark.parametrize("window", [5, 12, 35])
def test_substring_of_odd_rows(spark, window):
    docs = documents(spark)
    got = collected(substring.remove_repeats(docs, window, with_text=True), "n_words", "n_removed", "kept_sha256", "kept_text")
    assert Counter(r[:3] for r in got) == Counter(plain_removal([r["text"] or "" for r in docs.collect()], window))
    assert all(hashlib.sha256(t.encode()).hexdigest() == sha for *_, sha, t in got)
    assert substring.remove_repeats(nothing(spark), window).count() == 0


def test_every_alignment_shares_an_anchor():
    for period, cover in substring.COVERS.items():
        marked = set(cover)
        assert all(any((a + s) % period in marked and (b + s) % period in marked for s in range(period)) for a in range(period) for b in range(period))


def test_shifted_passages_are_found(spark):
    """One passage at every offset up to the period, in texts of their own."""
    passage = prose(35, 9)
    texts = [f"{prose(k, 100 + k)} {passage} {prose(20, 200 + k)}".strip() for k in range(23)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(collected(substring.remove_repeats(df), "doc_id", "n_removed"))
    assert got == {i: n for i, (_, n, _) in enumerate(plain_removal(texts, 35))} and min(got.values()) >= 35




def similarity(a: str | None, b: str | None) -> float:
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").encode().lower().split() for t in (a, b)))
    return len(x & y) / len(x | y)


def near_copies(n: int) -> list[str]:
    """Texts with some words changed, about half of them at 0.8 or more; chains, and prose of their own."""
    r = random.Random(8)
    texts = []
    for k in range(n):
        ws = prose(r.choice((8, 60, 200)), 5000 + k).split()
        for _ in range(4):
            texts.append(" ".join(ws))
            for i in r.sample(range(len(ws)), r.choice((1, 2, 3, len(ws) // 20 + 1))):
                ws[i] = f"new{r.random()}"
    return texts


@pytest.mark.parametrize("block", [1 << 21, 150])
def test_near_copies_at_the_similarity_are_dropped(spark, block, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", block)
    texts = near_copies(60)
    par = list(range(len(texts)))

    def find(i):
        while par[i] != i:
            i = par[i]
        return i

    far = 0
    for j in range(len(texts)):
        for i in range(j - j % 4, j):
            if similarity(texts[i], texts[j]) >= 0.8:
                far += bin(plain_fingerprint(texts[i]) ^ plain_fingerprint(texts[j])).count("1") > 4
                par[max(find(i), find(j))] = min(find(i), find(j))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert far > 20 and {r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()} == {find(i) for i in range(len(texts))}


def test_near_copies_are_dropped_by_row(spark):
    """Repeated ids: other texts of a losing id stay, and of near copies that share the smallest id one stays."""
    a, b, c = prose(100, 31), prose(100, 32), prose(100, 33)
    rows = [(1, a), (2, f"{a} more"), (2, b), (3, c), (3, f"{c} more"), (4, f"{c} again"), (5, "alone"), (5, "alone"), (None, a), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collected(simhash.drop_near_duplicates(docs), "doc_id", "text")
    threes = [t for i, t in got if i == 3]
    assert len(threes) == 1 and threes[0] in (c, f"{c} more")
    assert Counter(r for r in got if r[0] != 3) == Counter([(1, a), (2, b), (5, "alone"), (None, a), (None, a)])


def test_windows_of_words_in_a_pattern_are_told_apart(spark):
    """Thue-Morse words of letters in a word, and of words in a window, with their letters or words exchanged."""
    morse = lambda n, a, b: [b if i.bit_count() % 2 else a for i in range(n)]
    filler = [f"w{i}" for i in range(34)]
    texts = [" ".join([*filler[:17], "".join(morse(n, *ab)), *filler[17:]]) for n in (512, 1024, 2048, 8192) for ab in ("ab", "ba", "ca")]
    texts += [" ".join(morse(64, *ab)) for ab in (("ab", "cd"), ("cd", "ab"), ("b", "a"))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(docs).collect()}
    assert got == dict(enumerate(plain_removal(texts, 35)))
    assert all(got[i][1] == 0 for i in range(12))
    # Words that share their first 64 bytes, and words that differ in the last byte of a run of eight.
    words = [c * k + e for k in (7, 8, 15, 63, 64, 65, 200) for c in "ab" for e in "xy"]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(w) for w in words])
    assert all(len(set(byte_hashes(spare(data), end - [len(w) for w in words], end, which).tolist())) == len(words) for which in (0, 1))


def test_links_of_fingerprints_reach_the_near_stage(spark, monkeypatch):
    """Candidates of the byte index are taken without any shared band, and those that are not similar enough are left."""
    near_docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(400))), (2, " ".join(f"w{i}" for i in range(399)) + " other"), (3, "nothing like it at all")], "doc_id long, text string")
    apart = iter(range(1 << 40))
    monkeypatch.setattr(near, "band_keys", lambda hashes: np.array([hash((hashes.tobytes(), next(apart))) >> 1 for _ in range(near.BANDS)], np.int64))
    one = lambda docs, **kw: {r["doc_id"] for r in simhash.drop_near_duplicates(docs, **kw).collect()}
    linked = simhash.fingerprint(near_docs.first()["text"].encode()) ^ simhash.fingerprint(near_docs.collect()[1]["text"].encode())
    assert linked.bit_count() <= simhash.MAX_BITS
    assert one(near_docs) == {1, 3} and one(near_docs, similarity=0.999) == {1, 2, 3}
