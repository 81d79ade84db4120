"""Few questions are counted in one pass, many are joined: both give the rows of a plain loop."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from granary.operators import overlap, retrieval


def _plain(questions, chunks, k):
    words = lambda t: set(re.findall("[a-z0-9]+", (t or "").lower()))
    out = []
    for i, q in questions:
        scored = sorted((-len(words(q) & words(c)), key) for *key, c in chunks if words(q) & words(c))
        out += [(i, rank, *key, round(-n / (len(words(q)) + 1), 6)) for rank, (n, key) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("few", [0, retrieval.FEW_WORDS])
def test_lexical_top_k(spark, few):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("a b c d e f g h i j").upper() for _ in range(n))
    chunks = [(d, i, text(rng.randrange(6))) for d in range(40) for i in range(3)] + [(99, 0, None), (99, 1, "")]
    questions = [(1, text(5)), (2, text(1)), (3, ""), (4, None), (5, "nothing like it"), (6, "a a A b")]
    c = spark.createDataFrame(chunks, "doc long, pos int, chunk string").repartition(5)
    q = spark.createDataFrame(questions, "item long, question string")
    got = retrieval.lexical_top_k(q, c, "item", ["doc", "pos"], 3, few=few).select("item", "rank", "doc", "pos", "score")
    assert sorted(map(tuple, got.collect())) == _plain(questions, chunks, 3)
    assert not retrieval.lexical_top_k(q.where("item > 90"), c, "item", ["doc", "pos"], 3, few=few).count()
    assert not retrieval.lexical_top_k(q, c.where("doc < 0"), "item", ["doc", "pos"], 3, few=few).count()


def test_blocks_of_cells(monkeypatch):
    """Counts in blocks of a few cells are those of one block."""
    import numpy as np
    import pyarrow as pa

    asked = overlap.Asked(pa.array([["a", "b"], ["b"], ["c", "a", "d"]]))
    lists = pa.array([["a", "b"], None, [], ["b", "x", "c"], ["d", "a", "c"]] * 4)
    want = np.concatenate([m for _, m in asked.shared(lists)])
    monkeypatch.setattr(overlap, "CELLS", 4)
    parts = list(asked.shared(lists))
    assert len(parts) == 20 and (np.concatenate([m for _, m in parts]) == want).all()
    assert want[:5].tolist() == [[2, 1, 1], [0, 0, 0], [0, 0, 0], [1, 1, 1], [1, 0, 3]]


@pytest.mark.parametrize("few", [0, retrieval.FEW_VECTORS])
def test_cosine_top_k(spark, few, monkeypatch):
    """By tiles or by a join in blocks: the rows of a plain loop, with many ties."""
    from granary.operators import tiles

    monkeypatch.setattr(retrieval, "BLOCK", 30)
    monkeypatch.setattr(tiles, "TILE", 7)
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(3)]) for i in range(150)]
    rows = [(i, v) for i, v in rows if any(v)]
    norm = lambda v: sum(x * x for x in v) ** 0.5
    want = []
    for i, a in rows:
        if i % 10 == 0:
            near = sorted((-round(sum(x * y for x, y in zip(a, b, strict=True)) / norm(a) / norm(b), 6), j) for j, b in rows if j != i)[:4]
            want += [(i, n, j) for n, (_, j) in enumerate(near, 1)]
    df = spark.createDataFrame(rows, "vec_id long, e array<double>").repartition(3)
    got = retrieval.cosine_top_k(df, F.col("vec_id") % 10 == 0, 4, "vec_id", "e", few=few)
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in got.collect()) == sorted(want)
    assert retrieval.cosine_top_k(df.where("vec_id < 0"), F.col("vec_id") % 10 == 0, 4, "vec_id", "e", few=few).count() == 0


def test_hashed_search_in_one_pass(spark, sf_dir, monkeypatch):
    """Few questions are held by the tasks, so chunks are cut once and not joined; many are joined, with the same rows."""
    from granary.plans.catalogue import QUERIES

    held = QUERIES["q_hashed_search"](spark, sf_dir)
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1
    monkeypatch.setattr(retrieval, "FEW_VECTORS", 0)
    joined = QUERIES["q_hashed_search"](spark, sf_dir)
    assert "Join" in joined._jdf.queryExecution().optimizedPlan().toString()
    columns = ["item_id", "rank", "doc_id", "chunk_index", "similarity"]
    assert sorted(map(tuple, held.select(columns).collect())) == sorted(map(tuple, joined.select(columns).collect()))
