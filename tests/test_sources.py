"""Files that a document platform reads, and the operators that write tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from granary.functions import encode as enc
from granary.operators import relational as rel
from granary.operators import render
from granary.sources import files
from granary.sources import tables as src


def test_metadata_and_templates(spark, tmp_path):
    (tmp_path / "papers.json").write_text(json.dumps([{"paper_id": "a", "title": "A", "template": "tinghua.md", "created_at": "2024-01-01", "domain_tags": ["NLP", "General"]}, {"paper_id": "b", "title": "B", "template": "backdoor_attacks.md", "created_at": "2024-02-01", "domain_tags": None}]))
    got = [(r["paper_id"], r["domain_tags"]) for r in src.paper_metadata(spark, str(tmp_path / "papers.json")).collect()]
    assert got == [("b", ["Backdoor Attack"]), ("a", ["General", "NLP"])]
    for name in ("one.md", "two.md", "skip.txt"):
        (tmp_path / name).write_text(f"# {name}")
    assert [r["name"] for r in src.templates(spark, str(tmp_path)).collect()] == ["one.md", "two.md"]
    assert src.read_template(spark, str(tmp_path), "../two.md", "one.md").first()["content"] == "# one.md"
    assert src.read_template(spark, str(tmp_path), "two.md", "one.md").first()["content"] == "# two.md"


def test_pages_feeds_and_tables(spark):
    pages = spark.createDataFrame([("a", [" x ", "", "y"]), ("b", [" "])], "paper_id string, pages array<string>")
    assert {r["paper_id"]: r["text"] for r in src.pdf_pages(pages).collect()} == {"a": "[Page 1]\nx\n\n[Page 3]\ny", "b": src.NO_TEXT}
    xml = "<feed><entry><title>T  1</title><published>2024</published><id>u</id><summary>s</summary></entry><entry><id>v</id></entry></feed>"
    assert [tuple(r) for r in src.atom_entries(spark.createDataFrame([(xml,)], "xml string")).collect()] == [("T 1", "2024", "u", "s")]
    payload = json.dumps({"results": [{"title": str(i), "url": "u", "content": "c" * 600, "score": 0.5} for i in range(9)]})
    got = src.web_results(spark.createDataFrame([(payload,)], "payload string"), most=99).collect()
    assert len(got) == 5 and len(got[0]["content"]) == 500
    lines = ["# head", "| time | project | model | p | c | t |", "|---|---|---|---|---|---|", "| 1 | a | m | 2 | 3 | 5 |", "| 1 | a | m | x | 3 | 5 |", "| short |"]
    rows = src.token_table(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["project"], r["total"]) for r in rows] == [("a", 5)]


def test_title_names_and_rendering(spark):
    df = spark.createDataFrame([("Untitled 1", "/x/My.Paper.pdf"), ("Good title", "f.pdf")], "t string, f string")
    assert [r[0] for r in df.select(src.pdf_title(F.col("t"), F.col("f"))).collect()] == ["My.Paper", "Good title"]
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(render.result_name(F.lit("summary"), F.lit("a/tinghua.md"))) == "summary_tinghua.md"


def test_upserts_and_tools(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert sorted(map(tuple, rel.upsert(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    t = enc.Tools()
    t.register("add", lambda a, b: a + b, ("a", "b"))
    assert t.run("add", {"a": 1, "b": 2}) == {"result": 3} and "missing" in t.run("add", {})["error"] and "unknown" in t.run("x", {})["error"]
    assert t.run("add", {"a": 1, "b": None})["error"] and t.calls["add"] == 3


def test_trees_are_listed_by_tasks(spark, tmp_path):
    """Flat and deep, few and many folders: each file once, and no file known to the driver."""
    names = ["a.md", "b.txt", ".c.md", "_d/e.md", "deep/er/f.md"] + [f"many/{i}/g {i}.md" for i in range(40)]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    want = sorted(x for x in names if x.endswith(".md") and x[0] not in "._")
    got = files.read_files(spark, str(tmp_path), ".md")
    assert sorted(map(tuple, got.select("path", F.col("content").cast("string")).collect())) == [(x, x) for x in want]
    assert files.read_files(spark, str(tmp_path / "none")).isEmpty()
    for rows in (src.tool_folders(spark, str(tmp_path)), src.states(spark, str(tmp_path)), src.results(spark, str(tmp_path), spark.createDataFrame([(1, "ideas", "x")], "paper_id long, kind string, template string"))):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert not rows.inputFiles() and "FileScan" not in plan and "Broadcast" not in plan


def test_state_files_that_are_none(spark, tmp_path):
    for name, text in {"a": '{"request_id": "a", "payload": {"x": 1}}', "b": "", "c": "{broken", "d": '{"other": 1}', "e": "[]", "f": '[{"request_id": "f", "status": "done"},\n {"request_id": "g"}]'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = {(r["id"], r["status"], r["payload"]) for r in src.states(spark, str(tmp_path)).where("NOT broken").collect()}
    assert got == {("a", "pending", '{"x":1}'), ("f", "done", "{}"), ("g", "pending", "{}")} and src.states(spark, str(tmp_path)).where("broken").count() == 4


def test_uploads_come_once(spark, tmp_path):
    """A stream over folders that is started again sees only what is new, and the driver has no list of it."""
    def go() -> None:
        src.uploads(spark, str(tmp_path / "in")).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()

    for lot in ({"a.pdf": "1", "x/b.pdf": "2", "x/c.txt": "3"}, {"x/d.pdf": "4", "a.pdf": "5"}, {}):
        for name, text in lot.items():
            (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / "in" / name).write_text(text)
        go()
    got = spark.read.parquet(str(tmp_path / "out")).select("path", F.col("content").cast("string"))
    assert sorted(map(tuple, got.collect())) == [("a.pdf", "1"), ("x/b.pdf", "2"), ("x/d.pdf", "4")]
    assert not any("a.pdf" in f.read_text(errors="replace") for f in (tmp_path / "state" / "offsets").iterdir())
