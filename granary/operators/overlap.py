"""Words that many texts share with a few questions, counted batch by batch in numpy: no shuffle but of the best k a task.

Words of a text are looked up in the questions' words at once; each hit adds one to the cells of the questions that hold the word.
Cells and hits are worked on in bounded blocks, and only k texts a question are kept, so memory does not grow with a partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cells (text, question) and hits that are held at once.
CELLS = 1 << 22


class Asked:
    """The words of questions, and for each the questions that hold it."""

    def __init__(self, lists: pa.ListArray):
        sizes = np.diff(lists.offsets.to_numpy())
        coded = lists.flatten().dictionary_encode()
        word, who = coded.indices.to_numpy(), np.repeat(np.arange(len(lists)), sizes)
        self.words, self.count = coded.dictionary, len(lists)
        self.who = who[np.argsort(word, kind="stable")]
        self.many = np.bincount(word, minlength=len(self.words))
        self.first = np.cumsum(self.many) - self.many

    def shared(self, lists: pa.ListArray) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, matrix of counts by row and question) for blocks of rows."""
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        word = pc.fill_null(pc.index_in(lists.flatten(), value_set=self.words), -1).to_numpy()
        row = np.repeat(np.arange(len(lists)), sizes)[word >= 0]
        word = word[word >= 0]
        step = max(1, CELLS // self.count)
        for at in range(0, len(lists), step):
            n = min(step, len(lists) - at)
            lo, hi = np.searchsorted(row, [at, at + n])
            cells = np.zeros(n * self.count, np.int64)
            total = np.cumsum(self.many[word[lo:hi]])
            while lo < hi:
                done = total[-(hi - lo)] - self.many[word[lo]]
                to = lo + max(1, int(np.searchsorted(total[-(hi - lo) :], done + CELLS, "right")))
                w, many = word[lo:to], self.many[word[lo:to]]
                within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                who = self.who[np.repeat(self.first[w], many) + within]
                cells += np.bincount(np.repeat(row[lo:to] - at, many) * self.count + who, minlength=len(cells))
                lo = to
            yield at, cells.reshape(n, self.count)


def _best(rows: pa.Table, keys: list[str], k: int) -> pa.Table:
    """The k rows of each question with the most shared words, earlier keys first among equals."""
    order = pc.sort_indices(rows, [("q", "ascending"), ("n", "descending"), *((c, "ascending") for c in keys)], null_placement="at_start")
    rows = rows.take(order)
    q = rows.column("q").to_numpy()
    return rows.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < k))


def best_shared(ids: pa.Array, lists: pa.ListArray, id_name: str, keys: list[str], k: int) -> Callable:
    """For mapInArrow over (keys..., words): (id_name, keys..., n, size), the k best texts a question and task."""
    size = pc.list_value_length(lists).cast(pa.int64())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, held = Asked(lists), None
        for b in it:
            if not b.num_rows:
                continue
            b = b.take(pc.sort_indices(b, [(c, "ascending") for c in keys], null_placement="at_start"))
            for at, cells in asked.shared(b.column("words")):
                n = len(cells)
                rank = np.where(cells > 0, cells * n + np.arange(n - 1, -1, -1)[:, None], -1)  # an earlier row is larger among equals
                take = min(k, n)
                row = np.argpartition(rank, n - take, axis=0)[n - take :]
                q = np.broadcast_to(np.arange(asked.count), row.shape)[there := np.take_along_axis(cells, row, 0) > 0]
                row = row[there]
                found = b.take(pa.array(at + row)).select(keys)
                part = pa.Table.from_arrays([*found.columns, pa.array(q), pa.array(cells[row, q])], [*keys, "q", "n"])
                held = _best(part if held is None else pa.concat_tables([held, part]).combine_chunks(), keys, k)
        if held is not None and len(held):
            q = held.column("q")
            cols = [pc.take(ids, q), *(held.column(c) for c in keys), held.column("n"), pc.take(size, q)]
            yield from pa.Table.from_arrays(cols, [id_name, *keys, "n", "size"]).to_batches()

    return run
