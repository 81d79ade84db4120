"""Best rows by cosine for a bounded set of queries: every task multiplies its vectors with the queries, tile by tile, and gives the
few that may be among the best; only those are shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Vectors of one product.
TILE = 4096
#: Similarities closer than this may be one after rounding to six places, so a task leaves their order to the ids.
CLOSE = 2e-6


def unit(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(size > 0, size, 1.0)


def matrices(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector; vectors that are null or hold nulls are left out."""
    edge, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(edge)
    fine = np.ones(len(col), bool) if not col.null_count else ~np.asarray(col.is_null())
    for n in np.unique(size[fine]):
        at = np.flatnonzero(fine & (size == n))
        m = flat[edge[at][:, None] + np.arange(n)]
        whole = ~np.isnan(m).any(1)
        yield at[whole], m[whole]


def counted(col: pa.Array, dim: int) -> np.ndarray:
    """A unit vector of ``dim`` counts for each list of slots; an empty list gives zeros."""
    edge = col.offsets.to_numpy()
    row = np.repeat(np.arange(len(col)), np.diff(edge))
    flat = col.values.to_numpy(zero_copy_only=False)[edge[0] : edge[-1]]
    return unit(np.bincount(row * dim + flat, minlength=len(col) * dim).reshape(len(col), dim).astype(np.float64))


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up from the first component on, as the JVM does it."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def best_within(asked: dict[str, tuple[np.ndarray, np.ndarray]], k: int, dim: int) -> Callable:
    """For batches (key, id, part, slots): (query_id, id, part, similarity) rows that hold the k best of each query of the row's key,
    and those close to them. Of rows equally near only the k of the least (id, part) count. ``asked``: ids and unit vectors by key."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = {key: np.full((len(ids), k), -np.inf) for key, (ids, _) in asked.items()}
        for b in it:
            coded = b.column(0).dictionary_encode()
            code, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
            ids, part, m = b.column(1).to_numpy(), b.column(2).to_numpy(), None
            for c, key in enumerate(names):
                if key not in asked:
                    continue
                m = counted(b.column(3), dim) if m is None else m
                at = np.flatnonzero(code == c)
                (qid, q), top = asked[key], least[key]
                s = q @ m[at].T
                both = np.concatenate([top, np.partition(s, s.shape[1] - min(k, s.shape[1]), axis=1)[:, -k:]], 1)
                top[:] = -np.sort(-both, axis=1)[:, :k]
                r, x = np.nonzero(s >= top[:, -1:] - CLOSE)
                if not len(r):
                    continue
                x = at[x]
                near = in_order(q[r], m[x])
                order = np.lexsort((part[x], ids[x], near, r))
                r, x, near = r[order], x[order], near[order]
                new = np.append(True, (r[1:] != r[:-1]) | (near[1:] != near[:-1]))
                start = np.flatnonzero(new)
                first = np.arange(len(r)) - np.repeat(start, np.diff(np.append(start, len(r)))) < k
                r, x, near = r[first], x[first], near[first]
                yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(ids[x]), pa.array(part[x]), pa.array(near)], ["query_id", "id", "part", "similarity"])

    return run


def best_cosines(asked: list[tuple[int, list[float]]], k: int) -> Callable:
    """For (id, vector) batches: (query_id, id, cosine) rows that hold the k best other rows of each query, and those close to them."""
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n in {len(v) for _, v in asked}:
        own = [(i, v) for i, v in asked if len(v) == n]
        by_length[n] = np.array([i for i, _ in own]), unit(np.array([v for _, v in own], float).reshape(len(own), n))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = {n: np.full((len(ids), k), -np.inf) for n, (ids, _) in by_length.items()}
        for b in it:
            ids = b.column(0).to_numpy()
            for at, m in matrices(b.column(1)):
                if m.shape[1] not in by_length:
                    continue
                qid, q = by_length[m.shape[1]]
                top = least[m.shape[1]]
                for i in range(0, len(at), TILE):
                    own, s = ids[at[i : i + TILE]], q @ unit(m[i : i + TILE]).T
                    s[qid[:, None] == own] = -np.inf
                    # The k best so far, sorted; what is not close to the kth of them is none of the best.
                    both = np.concatenate([top, np.partition(s, s.shape[1] - min(k, s.shape[1]), axis=1)[:, -k:]], 1)
                    top[:] = -np.sort(-both, axis=1)[:, :k]
                    r, c = np.nonzero((s >= top[:, -1:] - CLOSE) & (s > -np.inf))
                    if len(r):
                        yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(own[c]), pa.array(s[r, c])], ["query_id", "id", "cosine"])

    return run
