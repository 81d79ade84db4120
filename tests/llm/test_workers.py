"""What Python workers hold once another operator is at work in them."""

from __future__ import annotations

import public_tokenizers

from granary.llm import chunks, features
from granary.llm.packing import pack


def test_one_operator_remembers():
    words, path = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
    first = features.quality_features(b"some words, some more").tolist()
    assert features._hash and features._shape
    assert chunks.library_encoder(words, True)(["some words"])
    assert not features._hash and not features._shape and not features._hash.old
    one = chunks.library_encoder(words, True)
    assert one is chunks.library_encoder(words, True)
    chunks.library_encoder(path, False)
    assert len(chunks._encoders) == 1
    assert features.quality_features(b"some words, some more").tolist() == first
    assert features._hash and not chunks._encoders


def test_plan_of_sequences_needs_no_workers(spark):
    docs = spark.createDataFrame([(1, "a few words"), (2, None)], "doc_id long, text string")
    got = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert "LocalRelation [r_length" in got._jdf.queryExecution().analyzed().toString()
    assert [r["offset"] for r in got.orderBy("length").collect()] == [4, 0]
