"""The inverted file: recall against the exact search, upserts, odd rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from granary.operators import vector_index
from granary.plans.catalogue import QUERIES


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_recall(spark, folder):
    d = f"/root/testdata/{folder}"
    got, want = ({(r["query_id"], r["id"]) for r in QUERIES[name](spark, d).collect()} for name in ("q_vector_index", "q_vector_topk"))
    assert len(got & want) >= 0.9 * len(want)


def nearest(rows, queries, k, same=False):
    norm = lambda v: sum(x * x for x in v) ** 0.5
    fine = lambda v: v is not None and all(x is not None and abs(x) < float("inf") for x in v) and any(v)
    out = []
    for i, p, a in queries:
        own = [(-round(sum(x * y for x, y in zip(a, b, strict=True)) / norm(a) / norm(b), 6), j) for r, j, b in rows if j is not None and fine(b) and len(b) == len(a) and j != i and (not same or r == p)]
        out += [(i, n, j, -s) for n, (s, j) in enumerate(sorted(own)[:k], 1)]
    return sorted(out)


def test_upserts_and_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 40)
    rng = random.Random(4)
    vector = lambda: [rng.gauss(0, 1) for _ in range(5)]
    rows = [(f"p{i % 7}", i, vector()) for i in range(300)] + [("hot", 1000 + i, [1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(150)]
    odd = [("p1", 400, None), ("p1", 401, [0.0] * 5), ("p1", 402, [1.0, None, 0.0, 0.0, 0.0]), ("p1", 403, [float("nan")] * 5), ("p1", 404, [1.0, 2.0]), ("p1", None, vector()), (None, 405, vector())]
    schema, path = "paper string, id long, e array<double>, list int, v string", str(tmp_path / "index")
    frame = lambda rs: spark.createDataFrame([(*r, 1, "x") for r in rs], schema).repartition(3)
    vector_index.build(frame(rows + odd), path, "paper", "id", "e", lists=9)
    asked = [(r[1], r[0], r[2]) for r in rows[:20]] + [(405, None, odd[-1][2]), (1000, "hot", [1.0, 0.0, 0.0, 0.0, 0.0])]
    q = spark.createDataFrame(asked, "query_id long, paper string, v array<double>")
    search = lambda *a, **kw: sorted(map(tuple, vector_index.search(spark, path, q, 4, *a, **kw).collect()))
    close = lambda got, want: [x[:3] for x in got] == [x[:3] for x in want] and all(abs(x[3] - y[3]) < 2e-6 for x, y in zip(got, want, strict=True))
    assert close(search(99), nearest(rows + odd, asked, 4)) and close(search(99, same_paper=True), nearest(rows + odd, asked, 4, True))
    assert spark.read.parquet(f"{path}/meta").first()["salts"] > 1
    # A paper that is replaced by fewer rows, one that is emptied, a new one, and the null paper.
    new = [("p2", 2, vector()), ("p2", 900, vector()), ("p3", 3, None), ("new", 901, vector()), (None, 902, vector())]
    for _ in range(2):
        vector_index.upsert(frame(new), path, "paper", "id", "e")
        now = [r for r in rows + odd if r[0] not in ("p2", "p3", None)] + new
        assert close(search(99), nearest(now, asked, 4))
    vector_index.upsert(frame([("hot", 1000, None)]), path, "paper", "id", "e")
    assert close(search(99), nearest([r for r in now if r[0] != "hot"], asked, 4))


def test_no_vectors(spark, tmp_path):
    empty = spark.createDataFrame([], "paper string, id long, e array<double>")
    vector_index.build(empty, str(tmp_path / "a"), "paper", "id", "e")
    one = spark.createDataFrame([(1, [1.0])], "query_id long, v array<double>")
    assert vector_index.search(spark, str(tmp_path / "a"), one, 3).count() == 0
    vector_index.build(spark.createDataFrame([("p", 5, [2.0])], empty.schema), str(tmp_path / "b"), "paper", "id", "e")
    assert [tuple(r) for r in vector_index.search(spark, str(tmp_path / "b"), one, 3).collect()] == [(1, 1, 5, 1.0)]
    assert vector_index.search(spark, str(tmp_path / "b"), one.where(F.lit(False)), 3).count() == 0


@pytest.mark.parametrize("same", [False, True])
def test_held_queries_give_the_rows_of_joined_ones(spark, tmp_path, monkeypatch, same):
    """Ties, copies, null papers, few probes; work is dealt out by pairs, however few bytes it has."""
    rng = random.Random(6)
    rows = [(f"p{i % 3}" if i % 11 else None, i, [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(400)]
    table = spark.createDataFrame(rows, "paper string, id long, e array<double>")
    vector_index.build(table, str(tmp_path), "paper", "id", "e", lists=7)
    asked = table.where("id % 9 = 0").select(F.col("id").alias("query_id"), "paper", F.col("e").alias("v"))
    monkeypatch.setattr(vector_index, "PAIRS", 1000)
    monkeypatch.setattr(vector_index, "TILE", 16)
    for probes in (2, 99):
        held = vector_index.search(spark, str(tmp_path), asked, 3, probes, same)
        assert "REPARTITION_BY_NUM" in held._jdf.queryExecution().executedPlan().toString() and "Join" not in held._jdf.queryExecution().optimizedPlan().toString()
        got = sorted(map(tuple, held.collect()))
        monkeypatch.setattr(vector_index, "FEW", 0)
        assert got == sorted(map(tuple, vector_index.search(spark, str(tmp_path), asked, 3, probes, same).collect())) and got
        monkeypatch.setattr(vector_index, "FEW", 64 << 20)
