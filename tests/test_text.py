"""Text functions against plain restatements of their rules."""

from __future__ import annotations

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from granary.functions import scalars
from granary.functions import text as tx


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def windows(t: str, size: int, overlap: int) -> list[str]:
    t, out, start = re.sub(r"\s+", " ", t).strip(), [], 0
    while t:
        out.append(t[start : start + size].strip())
        if start + size >= len(t):
            break
        start += size - overlap
    return [x for x in out if x]


@pytest.mark.parametrize("text", ["", "   ", "a" * 899, "a" * 900, "a" * 901, "b" * 1680, "c" * 1681, "word " * 700, "x y　z\x1cw"])
def test_chunks(spark, text):
    assert one(spark, tx.chunks(F.col("t")), t=text) == windows(text, 900, 120)


def test_overlap_has_to_be_smaller_than_the_window():
    with pytest.raises(ValueError, match="overlap"):
        tx.chunks(F.lit("x"), 10, 10)


def packs(units: list[str], most: int) -> list[str]:
    out, now = [], ""
    for u in units:
        if len(u) > most:
            out += [now] * bool(now) + [u[i : i + most] for i in range(0, len(u), most)]
            now = ""
        elif now and len(now) + 1 + len(u) > most:
            out, now = [*out, now], u
        else:
            now = f"{now} {u}" if now else u
    return out + [now] * bool(now)


@pytest.mark.parametrize("units", [[], ["a"], ["a" * 250, "b" * 249], ["a" * 250, "b" * 250], ["a" * 500], ["a", "b" * 501, "c"], ["a" * 1201, "b"], ["x"] * 400])
def test_pack(spark, units):
    df = spark.createDataFrame([(units,)], "u array<string>")
    assert df.select(tx.pack(F.col("u")).alias("x")).first()["x"] == packs(units, 500)


@pytest.mark.parametrize(
    ("line", "title", "rest"),
    [
        ("1. Introduction", "## 1 引言", ""),
        ("2.3 Method details", "### 2.3 方法", "details"),
        ("RESULTS", "## 结果", ""),
        ("A.1 APPENDIX", "### A.1 附录", ""),
        ("IV. EVALUATION", "## IV 实验", ""),
        ("3 BIG TITLE", "## 3 BIG TITLE", ""),
        ("[Page 3] ABSTRACT text", "## 摘要", "text"),
        ("I N TRODUCTION", "## 引言", ""),
        ("摘要：内容", "## 摘要", "内容"),
        ("4.1.2.3 DEEP DIVE", "#### 4.1.2.3 DEEP DIVE", ""),
    ],
)
def test_headings(spark, line, title, rest):
    got = one(spark, tx.parse_heading(F.col("t")), t=line)
    assert (got["title"], got["rest"]) == (title, rest)


@pytest.mark.parametrize("line", ["Results show that", "123 BIG TITLE", "摘要内容", "plain words", ""])
def test_no_heading(spark, line):
    assert one(spark, tx.parse_heading(F.col("t")), t=line) is None


def merged(sections: list[tuple[str, str]]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for title, content in sections:
        short = " ".join(content.split())
        if short and out and title == out[-1][0]:
            out[-1] = (out[-1][0], f"{out[-1][1]}\n{content}".strip())
        elif short and out and len(short) < 80:
            out[-1] = (out[-1][0], f"{out[-1][1]}\n{short}".strip())
        elif short:
            out.append((title, content))
    return out or [("## 全文", "")]


@pytest.mark.parametrize("sections", [[], [("a", "x")], [("a", "x" * 79), ("b", "y" * 79)], [("a", "x" * 80), ("b", "y" * 80), ("c", "z"), ("b", "w" * 90)], [("a", "x" * 90), ("b", " "), ("a", "y")], [("a", "x" * 90), ("c", "s"), ("a", "y")]])
def test_merge(spark, sections):
    df = spark.createDataFrame([([{"title": t, "content": c} for t, c in sections],)], "s array<struct<title:string,content:string>>")
    got = df.select(tx.merge_sections(F.col("s")).alias("x")).first()["x"]
    assert [(r["title"], r["content"]) for r in got] == merged(sections)


@pytest.mark.parametrize(("text", "n"), [("", 0), ("abc", 1), ("中文", 3), ("中文ab", 3), ("中" * 7, 10)])
def test_token_estimate(spark, text, n):
    assert one(spark, tx.token_estimate(F.col("t")), t=text) == n


@pytest.mark.parametrize(("text", "want"), [("Été à Zürich!", "ete_a_zurich"), ("日本", "paper"), ("", "paper"), ("a" * 60, "a" * 48), ("--x--y--", "x_y"), ("a" * 47 + " bc", "a" * 47 + "_"), ("ĳs ﬁn Ǆ ２０２４ x² ½ ①", "ijs_fin_dz_2024_x2_12_1")])
def test_slug(spark, text, want):
    assert one(spark, tx.slug(F.col("t")), t=text) == want


def test_ascii_of_every_character(spark):
    every = [chr(c) for c in (*range(0x80, 0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE0200))]
    df = spark.createDataFrame([(i, f"<{c}>") for i, c in enumerate(every)], "i int, t string")
    got = [r["x"] for r in df.select("i", tx.ascii_of(F.col("t")).alias("x")).sort("i").collect()]
    assert [c for c, x in zip(every, got, strict=True) if x != f"<{unicodedata.normalize('NFKD', c).encode('ascii', 'ignore').decode()}>"] == []


@pytest.mark.parametrize(("lines", "want"), [
    ([], []), (["INTRODUCTION"], [(0, "## 全文", "INTRODUCTION")]), (["ABSTRACT", "1 METHOD"], [(0, "## 全文", "ABSTRACT\n1 METHOD")]), (["a", "b"], [(0, "## 全文导读", "a\nb")]),
    (["a", "RESULTS", "b", "c", "CONCLUSION", "摘要：d"], [(0, "## 全文导读", "a"), (1, "## 结果", "b\nc"), (3, "## 摘要", "d")]),
])
def test_sections(spark, lines, want):
    df = spark.createDataFrame([(lines,)], "l array<string>").select(tx.sections(F.col("l")).alias("s"))
    assert [tuple(s) for s in df.first()["s"]] == want


def test_json_and_keys(spark):
    assert one(spark, tx.first_json_object(F.col("t")), t='so {"a": {"b": 1}} ok') == '{"a": {"b": 1}}'
    assert one(spark, tx.first_json_object(F.col("t")), t="so {a ok}") is None
    c = one(spark, scalars.candidate(F.col("t"), F.lit(0)), t='{"name": " ", "ASR_Gain": "7", "stealthiness": "high"}')
    assert (c["name"], c["plan"], c["asr_gain"], c["stealthiness"]) == ("候选方案 1", "N/A", 7.0, 5.0)
    assert one(spark, scalars.decrypted(scalars.encrypted(F.col("t"), "s"), "s"), t="key é") == "key é"
    assert one(spark, scalars.json_list(F.col("t")), t='["a"]') == ["a"] and one(spark, scalars.json_list(F.col("t")), t='{"a":1}') is None
