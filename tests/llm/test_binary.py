"""Packing by powers of two: pieces by plain arithmetic, ids by the library, sequences that are whole and alone."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_odd import SCHEMA, TEXTS, documents, nothing
from tokenizers import Tokenizer

from granary.llm.binary import decompose, pack_by_powers

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain(n: int, capacity: int) -> list[tuple[int, int]]:
    out, at = [], 0
    while n - at >= capacity:
        out.append((at, capacity))
        at += capacity
    for bit in reversed(range(capacity.bit_length() - 1)):
        if (n - at) >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


@settings(deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=20), st.sampled_from([1, 2, 64, 2048]))
def test_pieces_are_the_binary_digits(sizes, capacity):
    doc, start, length = decompose(np.array(sizes, np.int64), capacity)
    want = [(d, s, n) for d, size in enumerate(sizes) for s, n in plain(size, capacity)]
    assert list(zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)) == want


def test_every_id_lies_in_one_whole_sequence(spark):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    ids = lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 1]
    docs = documents(spark)
    got = pack_by_powers(docs, PATH, 256, with_ids=True).collect()
    want = sorted((str(r.doc_id), s, n, zlib.crc32(np.array(own[s : s + n], "<u4")), len(own), own[s : s + n]) for r in docs.collect() for own in [ids(r.text)] for s, n in plain(len(own), 256))
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens, list(r.ids)) for r in got) == want
    assert {r.offset for r in got} == {0}
    # Numbers have no gaps, and the sequences of a length are a range of them, longest first.
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    assert [r.length for r in sorted(got, key=lambda r: r.sequence_id)] == sorted((r.length for r in got), reverse=True)


def test_no_rows_and_wrong_capacity(spark):
    assert pack_by_powers(nothing(spark), PATH).count() == 0
    with pytest.raises(ValueError):
        pack_by_powers(nothing(spark), PATH, 2000)


def test_takes_clashing_names(spark):
    odd = spark.createDataFrame([(1, "a b", "x", 5, 6)], "doc_id long, text string, length string, part int, Text int")
    assert [(r.doc_id, r.start, r.length) for r in pack_by_powers(odd, PATH).sort("start").collect()] == [(1, 0, 2), (1, 2, 1)]
    empty = pack_by_powers(spark.createDataFrame([(None, None, None, None, None, None, None, None, None)], SCHEMA), PATH).collect()
    assert [(r.doc_id, r.length, r.doc_tokens, r.sequence_id) for r in empty] == [(None, 1, 1, 0)] and len(TEXTS) > 20
