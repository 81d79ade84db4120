"""Rows that every operator has to take: nulls, empty and long texts, repeats, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, part int, score double, fp long"

random.seed(5)
WORDS = ["".join(random.choice("abcdefgh") for _ in range(random.randint(1, 8))) for _ in range(300)]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


LONG = prose(30_000, 1)
PASSAGE = prose(60, 2)
TEXTS = [
    None, "", "   ", "\n", "one", "two words", "exactly three words", "now there are four", "ONE", "é ünï", "a\x1cb c", LONG, "x" * 50_000, PASSAGE, f"{prose(50, 3)} {PASSAGE} {prose(50, 4)}",
    f"{prose(40, 5)} {PASSAGE}", f"{PASSAGE} {PASSAGE}", "mail bob@example.com or +1 (803) 555-5351 now", "from 10.0.0.1 paid 4111 1111 1111 1111.", "ring (803) 555-5351 please", "the end.", "<|endoftext|> it's 'fine'  \t\r\n ok",
]


def documents(spark: SparkSession) -> DataFrame:
    rows = [(i, t, "en" if i % 2 else None, "s", None, "d", i % 3, 0.5, 7) for i, t in enumerate(TEXTS)]
    # Repeated rows, a repeated id with another text, null ids, a third of all rows equal.
    rows += [rows[3], rows[13], (4, "another text for four", None, None, None, None, None, None, None), (None, "no id here", None, None, None, None, None, None, None), (None, "one", None, None, None, None, None, None, None)]
    rows += [(1000 + i, "the same text for a third of all rows", "en", "hot", None, None, None, None, None) for i in range(14)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
