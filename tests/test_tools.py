"""Tools on executors: binding, errors of a row, counts of a run; globs against fnmatch."""

from __future__ import annotations

import fnmatch

import pytest
from pyspark.sql import functions as F

from granary.functions import tools
from granary.plans.stream_queries import TOOLS
from granary.streaming import events


def broken(a, b=2, *rest, **more):
    if a == 0:
        raise ValueError("no zero")
    return {"error": "own"} if a == 9 else {"a": a, "b": b, "more": sorted(more)}


@pytest.mark.parametrize(("arguments", "want"), [
    ({"a": 1}, {"a": 1, "b": 2, "more": []}), ({"a": 1, "b": 5, "c": 0}, {"a": 1, "b": 5, "more": ["c"]}), ({}, {"error": "missing required argument: a"}),
    ({"a": 0}, {"error": "tool execution failed: no zero"}), ({"a": 9}, {"error": "own"}),
])
def test_binding(arguments, want):
    assert tools.execute(broken, "broken", arguments, {}) == want


def test_counts_of_a_run(spark):
    calls = [(1, "halve", '{"value": 7}'), (2, "halve", "{}"), (3, "halve", "not json"), (4, None, None), (5, "other", ""), (6, "facts", None), (7, "owner", '{"text": "é"}')]
    df = spark.createDataFrame([(i, t, a, "x", 1) for i, t, a in calls], "call_id long, tool string, arguments string, result string, error int").repartition(3)
    rows, seen = tools.watched(tools.run_tools(df, TOOLS), ["halve", "facts", "owner"])
    got = {r["call_id"]: (r["result"], r["error"]) for r in rows.collect()}
    assert got[1] == ('{"result":3}', None) and got[6] == ('{"n":0,"names":[]}', None) and got[5] == (None, "tool not registered: other") and got[4] == (None, "tool not registered: None")
    assert got[2] == (None, "missing required argument: value") and got[3][1].startswith("tool execution failed: Expecting value") and got[7][1] == "tool execution failed: 'user'"
    assert seen.get == {"calls": 7, "failures": 5, "halve_calls": 3, "halve_failures": 2, "facts_calls": 1, "facts_failures": 0, "owner_calls": 1, "owner_failures": 1}
    assert tools.run_tools(df.where("call_id < 0"), TOOLS).count() == 0


def test_globs(spark):
    patterns, names = ["*", "web.*", "?eb.a", "[wx]eb.[!a]*", "a.b", "a+b(c)", "*$^"], ["web.a", "xeb.b", "a.b", "aXb", "a+b(c)", "x$^", "", "a\nb"]
    pairs = spark.createDataFrame([(p, n) for p in patterns for n in names], "p string, n string")
    got = {(r["p"], r["n"]): r["ok"] for r in pairs.select("p", "n", events.glob(F.col("p")).alias("re")).select("p", "n", F.expr("rlike(n, re)").alias("ok")).collect()}
    assert got == {(p, n): fnmatch.fnmatchcase(n, p) for p in patterns for n in names}
