"""What queries leave behind in the shared folder."""

from __future__ import annotations

import gc
import time
from pathlib import Path

import pytest

from granary.plans.catalogue import QUERIES
from granary.streaming.windows import shared_dir


def left(folder: Path) -> list[Path]:
    return [p for p in folder.rglob("*") if p.is_file() and not p.name.startswith(".")]


@pytest.mark.parametrize("name", ["q_token_log", "q_chunk_store", "q_stream_windows", "q_pdf_text"])
def test_nothing_stays(name, spark, sf_dir):
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(left(folder))
    rows = QUERIES[name](spark, sf_dir)
    assert rows.count()
    assert not [p for p in set(left(folder)) - before if "granary-" in str(p.relative_to(folder))]
    del rows
    for _ in range(30):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        if not set(left(folder)) - before:
            break
        time.sleep(0.5)
    assert not set(left(folder)) - before
