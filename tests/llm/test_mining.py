"""Hard negatives against plain loops, with pruning that is seen to happen."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from compare import rows
from pyspark.sql import functions as F

from granary.llm import mining
from granary.llm.mining import Bucket, Search, mine

SCHEMA = "vec_id long, embedding array<double>, label int, norm int, no string, V long, place int"


def plain(data, is_anchor, positives=5, negatives=10, low=30, high=90, base=100, scale=256):
    usable = [(i, y, tuple(math.floor(scale * x) for x in v)) for i, v, y in data if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, y, v in dict.fromkeys(usable):
        if not is_anchor(i):
            continue
        score = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, z, w in usable if j != i and len(w) == len(v)]
        for s, j, _ in sorted(x for x in score if x[2] == y)[:positives]:
            hard = sorted(x for x in score if x[2] != y and low * -s <= base * -x[0] <= high * -s)[:negatives]
            out += [(i, j, k, h, -s, -t) for k, (t, h, _) in enumerate(hard, 1)]
    return sorted(out)


def frame(spark, data):
    return spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], y, 1, "x", 2, 3) for i, v, y in data], SCHEMA).repartition(4)


def some(n, dim=6, seed=1):
    r = random.Random(seed)
    return [(i, [r.gauss(0, 1) * (1 + i % 5) for _ in range(dim)], r.randrange(4)) for i in range(n)]


def test_same_as_plain_loops(spark):
    data = some(260)
    data += [(300, None, 1), (301, [1.0, None, 1, 1, 1, 1], 1), (302, [float("nan")] * 6, 1), (303, [float("inf")] * 6, 1), (304, [0.5] * 6, None), (None, [0.5] * 6, 1)]
    data += [(305, [], 1), (310, [], 2), (306, [1.0, 2.0], 1), (320, [1.0, 2.0], 1), (307, [3.0, 2.0], 2), data[10], data[11], (20, data[30][1], 2), (330, [0.0] * 6, 0)]
    data += [(400 + i, [1.0, 1, 0, 0, 1, 0.5], i % 2) for i in range(130)]  # a third of all rows is one vector
    got = mine(frame(spark, data), F.col("vec_id") % 10 == 0)
    want = plain(data, lambda i: i % 10 == 0)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 500
    # Small tiles, buckets and runs give the same.
    assert sorted(map(tuple, mine(frame(spark, data), F.col("vec_id") % 10 == 0, held=2000).collect())) == want


def test_other_windows_and_large_numbers(spark):
    data = some(60, 3)
    got = mine(frame(spark, data), F.col("vec_id") % 3 == 0, 2, 3, 0, 120, 100, 16)
    assert sorted(map(tuple, got.collect())) == plain(data, lambda i: i % 3 == 0, 2, 3, 0, 120, 100, 16)
    big = [(i, [float(x * 2**18) for x in v], y) for i, v, y in data]
    assert sorted(map(tuple, mine(frame(spark, big), F.col("vec_id") % 3 == 0).collect())) == plain(big, lambda i: i % 3 == 0)
    with pytest.raises(ValueError):
        mine(frame(spark, data), F.col("vec_id") % 3 == 0, low=90, high=30)


def test_no_rows(spark):
    assert mine(frame(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert mine(frame(spark, [(0, [1.0], 1)]), F.col("vec_id") % 10 == 0).count() == 0


def test_buckets_out_of_reach_are_not_multiplied(monkeypatch):
    a = mining.Anchors(np.array([0]), np.array([0]), np.array([1]), np.array([[3.0, 4.0]]), np.array([[100]]), np.array([[10_000]]))
    search = Search(a, False, 2)
    far = Bucket(np.array([5, 6, 7]), np.array([2, 2, 1]), np.array([[30.0, 40.0], [15.0, 20.0], [30.0, 40.0]]), 50.0)
    assert search.take(far) and search.ids.tolist() == [[[5, 6]]] and search.scores.tolist() == [[[250, 125]]]
    monkeypatch.setattr(mining, "_product", lambda q, m: pytest.fail("multiplied"))
    # Below the kth score of the window, 125; a bound of 5 * 24 is.
    assert not search.take(Bucket(np.array([8]), np.array([2]), np.array([[14.0, 19.0]]), 24.0))
    # Below the window's lower limit, whatever was found.
    assert not Search(a, False, 2).take(Bucket(np.array([8]), np.array([2]), np.array([[1.0, 1.0]]), 19.0))


def test_query_gives_the_rows_of_its_sql(spark, sf_dir, duck):
    got, want = mining.op12_hard_negatives(spark, sf_dir).toPandas(), duck.sql(mining.OP12_SQL).df()
    assert sorted(got.columns) == sorted(want.columns) and len(want) and rows(got) == rows(want)
