"""Queries that SQL cannot say, whole, against plain loops over their tables."""

from __future__ import annotations

import math
import re
from collections import defaultdict, deque

import duckdb
import xxhash
from test_text import merged, packs, windows

from granary.plans.catalogue import QUERIES
from granary.streaming import limiter


def _table(sf_dir, sql):
    return duckdb.sql(sql.replace("{d}", sf_dir)).fetchall()


def _texts(sf_dir):
    return {i: t or "" for i, t in _table(sf_dir, "SELECT doc_id, text FROM '{d}/documents.parquet'")}


def test_packs(spark, sf_dir):
    want = []
    for i, t in _texts(sf_dir).items():
        cut = [x.strip() for x in re.split(r"(?<=[。！？.!?])\s+|\n+", t.strip())]
        want += [(i, n, p) for n, p in enumerate(packs([x for x in cut if x], 500))]
    assert sorted(map(tuple, QUERIES["q_pack500"](spark, sf_dir).collect())) == sorted(want)


def test_merged_sections(spark, sf_dir):
    parts = defaultdict(list)
    for r in sorted(QUERIES["q_sections"](spark, sf_dir).collect(), key=lambda r: (r["doc_id"], r["section"])):
        parts[r["doc_id"]].append((r["title"], r["content"]))
    want = [(i, n, *s) for i, own in parts.items() for n, s in enumerate(merged(own))]
    assert sorted(map(tuple, QUERIES["q_sections_merged"](spark, sf_dir).collect())) == sorted(want)


def test_rate_limit(spark, sf_dir):
    want = {}
    calls = _table(sf_dir, "SELECT event_type, epoch_us(ts) / 600e6, event_id FROM '{d}/events.parquet'")
    for tool in {c[0] for c in calls}:
        own = sorted(c[1:] for c in calls if c[0] == tool)
        want |= zip([i for _, i in own], limiter.admit([t for t, _ in own], deque()), strict=True)
    assert {r["event_id"]: r["allowed"] for r in QUERIES["q_rate_limit"](spark, sf_dir).collect()} == want


def _vector(t: str) -> list[float]:
    v = [0.0] * 64
    for w in set(re.findall("[a-z0-9]+", t.lower())):
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        v[(h - (h >> 63 << 64)) % 64] += 1
    size = math.sqrt(sum(x * x for x in v))
    return [x / size for x in v] if size else v


def test_hashed_search(spark, sf_dir):
    chunks = defaultdict(list)
    texts = _texts(sf_dir)
    for i, source in _table(sf_dir, "SELECT doc_id, source FROM '{d}/documents.parquet'"):
        chunks[source] += [((i, n), _vector(c)) for n, c in enumerate(windows(texts[i], 900, 120))]
    got = defaultdict(list)
    for r in QUERIES["q_hashed_search"](spark, sf_dir).collect():
        got[r["item_id"]].append((r["rank"], (r["doc_id"], r["chunk_index"]), r["similarity"]))
    for item, text in _table(sf_dir, "SELECT item_id, text FROM '{d}/benchmark.parquet'"):
        a = _vector(text)
        near = {key: sum(x * y for x, y in zip(a, b, strict=True)) for key, b in chunks[f"src{item % 20}"]}
        best = sorted(near.values(), reverse=True)[:3]
        own = sorted(got.pop(item, []))
        assert [rank for rank, _, _ in own] == list(range(1, len(best) + 1))
        for (_, key, s), want in zip(own, best, strict=True):
            assert abs(s - want) < 2e-6 and abs(near[key] - s) < 2e-6
    assert not got
