"""Ball k-means against plain rounds over all vectors and centroids, and what the balls save."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
from compare import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm.balls import OP13_SQL, ball_k_means, exact, op13_ball_k_means, reassign

SCHEMA = "vec_id long, embedding array<double>, cluster int, V string, ids long"


def square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def plain(data, k, rounds, dim, scale, seed="3"):
    own = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in data if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(own, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in start[:k]]
    near = lambda v: min((square(v, x), j) for j, x in enumerate(c))
    for _ in range(rounds):
        groups = {}
        for _, v in own:
            groups.setdefault(near(v)[1], []).append(v)
        c = [tuple(sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)) if j in groups else old for j, old in enumerate(c)]
    return sorted(((str(i), near(v)[1], near(v)[0]) for i, v in own)), [list(x) for x in c]


def some(n, dim, seed=1):
    r = random.Random(seed)
    middle = [[r.uniform(-1, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, [x + r.gauss(0, 0.2) for x in middle[i % 6]]) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], 1, "x", 2) for i, v in data], SCHEMA).repartition(3)


def same(spark, data, *args):
    got, c = ball_k_means(frame(spark, data), *args)
    assert (sorted((str(r.vec_id), r.cluster, r.distance) for r in got.collect()), c) == plain(data, *args)


def test_same_as_plain_rounds(spark):
    data = some(300, 4)
    data += [(400, None), (401, [1, None, 1, 1]), (402, [float("nan")] * 4), (403, [float("inf")] * 4), (404, [0.5] * 3), (405, []), (None, [0.5] * 4), (None, [0.1] * 4), data[7], data[7], (7, data[8][1])]
    data += [(500 + i, [0.25, -0.25, 0.5, 0.0]) for i in range(150)]  # a third of all rows is one vector
    same(spark, data, 8, 10, 4, 1024)
    same(spark, data, 5, 2, 4, 3)  # coarse numbers have many ties


def test_large_numbers_few_vectors_and_none(spark):
    same(spark, [(i, [x * 2**20 for x in v]) for i, v in some(40, 3)], 4, 5, 3, 1024)
    same(spark, some(3, 2), 8, 10, 2, 1024)
    got, c = ball_k_means(frame(spark, [(1, None)]), 8, 10, 2)
    assert got.count() == 0 and c == []


@settings(deadline=None, max_examples=200)
@given(st.lists(st.tuples(st.integers(-3, 3), st.integers(-3, 3)), min_size=1, max_size=40), st.lists(st.tuples(st.integers(-3, 3), st.integers(-3, 3)), min_size=1, max_size=7), st.integers(0, 99), st.booleans())
def test_a_round_from_any_clusters_is_exact(points, centroids, seed, big):
    before = np.random.default_rng(seed).integers(0, len(centroids), len(points))
    by = 2**30 if big else 1
    m, c = exact(np.array(points, float) * by, np.array([[x * by for x in row] for row in centroids], object))
    cluster, dist, _ = reassign(m, before, c)
    want = [min((square(p, x) * by * by, j) for j, x in enumerate(centroids)) for p in points]
    assert list(zip(dist.tolist(), cluster.tolist(), strict=True)) == want


def test_stable_cores_are_not_compared():
    data = np.floor(1024 * np.array([v for _, v in some(600, 8, 3)]))
    c = np.floor(np.array([data[i::6].mean(0) for i in range(6)]))
    cluster, _, _ = reassign(data, np.zeros(600, np.int64), c)
    _, _, count = reassign(data, cluster, c)
    assert count < 600 * 2  # six for each row without the balls


def test_query_gives_the_rows_of_its_sql(spark, sf_dir, duck):
    got, want = op13_ball_k_means(spark, sf_dir).toPandas(), duck.sql(OP13_SQL).df()
    assert sorted(got.columns) == sorted(want.columns) and len(want) and rows(got) == rows(want)
