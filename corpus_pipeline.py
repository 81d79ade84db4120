"""From raw documents to packed sequences: quality, exact and near duplicates, personal data, packing.

Each stage takes what its predecessor kept, as a Parquet table with the columns of ``documents``, and its decisions take effect:
rejected documents and duplicates are gone, personal data is replaced by its kind. The last stage returns the packed pieces.

Columns ``doc_id`` and ``text`` are taken by their exact names; any others are only carried. Null and empty texts, repeated rows,
ties and empty tables have a defined result in every stage, stated at each.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from granary.llm.common import drop_scratch, kept, scratch, table
from granary.llm.exact import drop_duplicates
from granary.llm.nbsvm import keep_good
from granary.llm.packing import pack
from granary.llm.pii import redact_documents
from granary.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a quality of 0.3 or more; a null text is scored as empty, equal texts fare alike, no rows give none."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the largest doc_id, one row where that repeats; null equals empty, a null id is the smallest."""
    return drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a Jaccard similarity of 0.8 or more of their five-word shingles the row of the smallest doc_id; rows
    with a null id stay, blank and null texts are alike."""
    return drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind in brackets; a null text stays null."""
    return redact_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens; a null or empty text is one piece with the end id."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("personal_data", personal_data), ("packing", packing)]

#: A fitted classifier, a random field and a tokenizer have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written, read again by the next stage, and dropped after that, or when a
    stage fails. An empty table gives no pieces."""
    docs, last = table(spark, sf_dir, "documents"), None
    try:
        for name, stage in STAGES[:-1]:
            path = scratch(spark, f"pipeline-{name}")
            before, last = last, path
            try:
                stage(spark, docs, sf_dir).write.parquet(path)
            finally:
                if before:
                    drop_scratch(spark, before)
            docs = spark.read.parquet(path)
        return kept(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        if last:
            drop_scratch(spark, last)
