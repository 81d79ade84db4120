"""What operators leave behind in the shared folder, once their result was written and let go."""

from __future__ import annotations

import gc
import time
from pathlib import Path

import pytest

from granary.llm.common import kept, shared_dir
from granary.llm.components import connected_components
from granary.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nothing_stays(name, spark, sf_dir, tmp_path):
    folder = Path(shared_dir(spark).removeprefix("file:"))
    left = lambda: {p for p in folder.rglob("*") if p.is_file() and not p.name.startswith(".")}
    before = left()
    QUERIES[name](spark, sf_dir).write.parquet(str(tmp_path / "out"))
    for _ in range(40):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        if not left() - before:
            break
        time.sleep(0.5)
    assert not left() - before


def test_rounds_leave_no_shuffle_files(spark):
    """Shuffle files of a round go with it, and not when the driver collects its garbage; the setting is for these frames alone."""
    folders = [Path(d.getPath()) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    left = lambda: {p for d in folders for p in d.rglob("shuffle_*")}
    links = spark.range(400).selectExpr("id AS a", "id + 1 AS b")
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    before = left()
    roots = connected_components(links)
    for _ in range(10):
        if not left() - before:
            break
        time.sleep(0.5)
    assert not left() - before
    assert {tuple(r) for r in roots.collect()} == {(i, 0) for i in range(401)}
    own = links.groupBy("a").count()
    assert kept(own).count() == own.count() == len(own.collect()) == len(own.collect()) == 400
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
