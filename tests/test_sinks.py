"""Sinks, and functions that work together."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from granary.functions import text as tx
from granary.operators import collaborate as co
from granary.sources import files, sinks, tables


def test_chunks_are_replaced_by_paper(spark, tmp_path):
    path, schema = str(tmp_path / "c"), "paper_id string, chunk_index int, chunk string"
    sinks.write_chunks(spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], schema), path)
    sinks.write_chunks(spark.createDataFrame([("a", 0, " new "), ("a", 1, "  ")], schema), path)
    got = spark.read.parquet(path).where("chunk IS NOT NULL")
    assert sorted((r["paper_id"], r["chunk"]) for r in got.collect()) == [("a", "new"), ("b", "z")]
    plan = sinks.read_chunks(spark, path, "a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(paper_id,a)" in plan
    assert sinks.read_chunks(spark, path, "a").first()["chunk_id"].startswith("a:0:")
    sinks.write_chunks(spark.createDataFrame([("a", 0, " \n"), ("a", 1, None)], schema), path)
    assert sinks.read_chunks(spark, path, "a").count() == 0 and [r["chunk"] for r in sinks.read_chunks(spark, path, "b").collect()] == ["z"]


def test_papers_that_share_a_folder(spark, tmp_path):
    path, schema = str(tmp_path / "c"), "paper long, chunk_index int, chunk string"
    want = {i: f"old {i}" for i in range(40)}
    sinks.write_chunks(spark.createDataFrame([(i, 0, t) for i, t in want.items()], schema), path, "paper", 3)
    sinks.write_chunks(spark.createDataFrame([(i, 0, "" if i % 2 else f"new {i}") for i in range(0, 40, 5)] + [(77, 0, "x")], schema), path, "paper", 3)
    want = {i: f"new {i}" if i % 5 == 0 else t for i, t in want.items() if i % 10 != 5} | {77: "x"}
    assert {r["paper"]: r["chunk"] for r in spark.read.parquet(path).where("chunk IS NOT NULL").collect()} == want
    assert len(list((tmp_path / "c").glob("bucket=*"))) == 3
    assert [r["chunk"] for r in sinks.read_chunks(spark, path, 11, "paper", 3).collect()] == ["old 11"]
    assert sinks.read_chunks(spark, path, 15, "paper", 3).count() == 0


def test_a_large_folder_of_chunks_is_written_by_several_tasks(spark, tmp_path):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "64k")
    try:
        chunks = spark.range(20_000).repartition(4).select(F.col("id").alias("paper"), F.lit(0).alias("chunk_index"), F.sha2(F.col("id").cast("string"), 256).alias("chunk"))
        sinks.write_chunks(chunks, str(tmp_path / "c"), "paper", 1)
    finally:
        spark.conf.unset(size)
    assert len(list((tmp_path / "c" / "bucket=0").glob("*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "c")).where("chunk IS NOT NULL").agg(F.count("*"), F.countDistinct("paper")).first()[:] == (20_000, 20_000)


def test_logs_and_results(spark, sf_dir, tmp_path):
    calls = spark.createDataFrame([(1, "m", 2, 3, "chat", "t")], "user_id long, model string, prompt_tokens long, completion_tokens long, action string, created_at string")
    for _ in range(2):
        sinks.append_log(sinks.token_rows(calls), str(tmp_path / "log"))
    assert [r["total_tokens"] for r in spark.read.parquet(str(tmp_path / "log")).collect()] == [5, 5]
    rows = [(1, "summary", "a.md", "one"), (1, "ideas", "a.md", "two"), (2, "summary", "b.v2.md", None)]
    sinks.write_results(spark.createDataFrame(rows, "paper_id long, kind string, template string, content string"), str(tmp_path / "out"))
    sinks.write_results(spark.createDataFrame([(1, "ideas", "a.md", "three\nlines")], "paper_id long, kind string, template string, content string"), str(tmp_path / "out"))
    kinds = spark.createDataFrame([(1, "summary", "a.md"), (1, "ideas", "x.md"), (2, "summary", "b.v2.md"), (3, "summary", "a.md")], "paper_id long, kind string, template string")
    assert {(r["paper_id"], r["kind"]): r["content"] for r in tables.results(spark, str(tmp_path / "out"), kinds).collect()} == {(1, "summary"): "one", (1, "ideas"): "three\nlines", (2, "summary"): "", (3, "summary"): ""}
    assert (tmp_path / "out" / "2" / "summary_b.v2.md").exists()
    with pytest.raises(PySparkException):
        files.write_files(spark.createDataFrame([("../x", "y")], "path string, content string"), str(tmp_path / "out"))
    calls.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in"))
    sinks.stream_log(stream, str(tmp_path / "s"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "s")).count() == 1


def test_packed_files_are_few_archives_and_the_newest_counts(spark, tmp_path):
    names = [f"p {i}/{n}" for i in range(300) for n in ("a.md", "b.txt", ".c.md")] + ["é/_d/e.md", "long/" * 40 + "f.md"]
    rows = lambda names, text: spark.createDataFrame([(x, text * (i % 40)) for i, x in enumerate(names)], "path string, content string").repartition(3)
    for text, some in (("old", names), ("new", names[::7]), ("last", names[::21])):
        files.write_files(rows(some, text), str(tmp_path), packed=True)
    there = [x for x in tmp_path.rglob("*") if not x.name.endswith(".crc")]
    assert 3 <= len(there) <= 9 and all(files.ARCHIVE.fullmatch(x.name) for x in there)
    (tmp_path / "p 1").mkdir()
    (tmp_path / "p 1" / "a.md").write_text("single")
    (tmp_path / "other.zip").write_text("none")
    want = {x: "old" * (i % 40) for i, x in enumerate(names)} | {x: "new" * (i % 40) for i, x in enumerate(names[::7])} | {x: "last" * (i % 40) for i, x in enumerate(names[::21])}
    want = {x: text for x, text in want.items() if x.endswith(".md") and not any(part[0] in "._" for part in x.split("/"))} | {"p 1/a.md": "single"}
    newest = files.read_versions(spark, str(tmp_path), ".md").groupBy("path").agg(F.max_by("content", "written").cast("string").alias("content"), F.count("*").alias("n"), F.countDistinct("written").alias("d"))
    got = newest.collect()
    assert {r["path"]: r["content"] for r in got} == want and all(r["n"] == r["d"] for r in got)
    for bad in ("../x", "/x", "a\0b"):
        with pytest.raises(PySparkException):
            files.write_files(spark.createDataFrame([(bad, "y")], "path string, content string"), str(tmp_path), packed=True)
    assert {r["path"] for r in files.read_versions(spark, str(tmp_path), ".md").select("path").distinct().collect()} == set(want)


def test_archives_are_closed_when_full(spark, tmp_path):
    files.write_files(spark.range(0, 40_000, 1, 1).select(F.concat("id", F.lit("/x")).alias("path"), F.lit(None).cast("binary").alias("content")), str(tmp_path), packed=True)
    assert len(list(tmp_path.glob("*.zip"))) == 3
    assert files.read_versions(spark, str(tmp_path)).agg(F.countDistinct("path"), F.sum(F.length("content"))).first()[:] == (40_000, 0)


def test_archives_of_failed_attempts_are_not_read(spark, tmp_path):
    import pyarrow as pa

    w = files.ArchiveWriter(f"file://{tmp_path}")
    batch = lambda text: pa.RecordBatch.from_pydict({"path": ["a/summary.md"], "content": [text]}, pa.schema([("path", pa.string()), ("content", pa.string())]))
    lost, kept, gone = (w.write(iter([batch(x)])) for x in ("lost", "kept", "gone"))
    w.commit([kept, None])
    w.abort([gone, None])
    assert lost.names and [bytes(r["content"]) for r in files.read_versions(spark, str(tmp_path)).collect()] == [b"kept"]
    w.commit([w.write(iter([batch("again")]))])
    assert bytes(files.read_versions(spark, str(tmp_path)).agg(F.max_by("content", "written")).first()[0]) == b"again"


def test_contents_of_results_are_not_shuffled(spark, tmp_path):
    schema = "paper_id long, kind string, template string, content string"
    rows = lambda text, ids: spark.createDataFrame([(i, k, "a.md", f"{text} {k} {i}") for i in ids for k in ("summary", "ideas")], schema)
    sinks.write_results(rows("old", range(60)), str(tmp_path), packed=True)
    sinks.write_results(rows("new", range(0, 60, 7)), str(tmp_path), packed=True)
    sinks.write_results(rows("single", [3]), str(tmp_path))
    kinds = spark.createDataFrame([(i, k, "a.md") for i in range(70) for k in ("summary", "ideas")], "paper_id long, kind string, template string")
    got = tables.results(spark, str(tmp_path), kinds)
    text = lambda i: "single" if i == 3 else "new" if i % 7 == 0 else "old"
    assert {(r["paper_id"], r["kind"]): r["content"] for r in got.collect()} == {(i, k): f"{text(i)} {k} {i}" if i < 60 else "" for i in range(70) for k in ("summary", "ideas")}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "content" not in plan[plan.index("RepartitionByExpression"):]


@pytest.mark.parametrize("name", ["q_results", "q_tool_folders"])
def test_queries_of_many_files_make_few(name, spark, sf_dir, monkeypatch):
    from pathlib import Path

    from granary.plans.catalogue import QUERIES
    from granary.streaming import windows

    made, settled = [], windows.settled

    def counted(rows, path, *more):
        made.extend(x for x in Path(path.removeprefix("file:").replace("//", "/")).rglob("*") if x.suffix != ".crc")
        return settled(rows, path, *more)

    monkeypatch.setattr(windows, "settled", counted)
    assert QUERIES[name](spark, sf_dir).count() and 0 < len(made) <= 16


def test_state_files_skip_what_does_not_parse(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "a", "status": "pending"}')
    (tmp_path / "b.json").write_text('{"id": "b", "status": "approved"}')
    (tmp_path / "c.json").write_text("{broken")
    rows = tables.read_json_rows(spark, str(tmp_path), "id string, status string").where("status = 'pending'")
    assert [r["id"] for r in rows.collect()] == ["a"]


def test_patterns(spark):
    df = spark.createDataFrame([(1, "one. two."), (2, "fail")], "id long, t string")
    t = F.col("t")
    fails = lambda c: F.when(~F.contains(c, F.lit("fail")), F.upper(c))
    mark = lambda c: F.concat(c, F.lit("!"))
    rows = df.select(co.round_robin([fails, mark], t).alias("r"), co.debate([fails, mark], lambda p: F.length(p) > 5, t).alias("d"), co.clarify(t, lambda c: F.concat(F.lit("what about "), c), 5).alias("c")).collect()
    assert [tuple(r) for r in rows] == [("ONE. TWO.!", "ONE. TWO.", "what about one. two."), ("fail!", "fail!", None)]
    got = {r["id"]: r["answer"] for r in co.supervise(df, "id", "t", tx.sentences, fails, "|").collect()}
    assert got == {1: "ONE.|TWO.", 2: "fail"}
    loop = co.tool_loop(df, "t", lambda c: F.length(c) < 8, mark, lambda c: F.concat(F.lit("> "), c))
    assert [r["answer"] for r in loop.orderBy("id").collect()] == ["> one. two.", "> fail!!!!"]
