"""Streams give what their batch forms give."""

from __future__ import annotations

import random
import time
from collections import deque

import pytest
from compare import rows
from pyspark.sql import functions as F

from granary.plans import stream_queries as sq
from granary.streaming import broker, limiter, sessions, tasks, windows


def _run(spark, folder, table, plan, mode):
    table.coalesce(1).write.parquet(f"{folder}/in")
    source = spark.readStream.schema(table.schema).parquet(f"{folder}/in")
    q = plan(source).writeStream.outputMode(mode).format("memory").queryName("out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table("out")


def test_task_state(spark, sf_dir, tmp_path):
    reports = sq.reports(spark, sf_dir)
    got = _run(spark, tmp_path, reports, tasks.stream, "update")
    assert rows(got.toPandas()) == rows(tasks.latest(reports).toPandas())


def test_rate_limit(spark, tmp_path):
    calls = spark.createDataFrame([("a", i, i * 0.5) for i in range(400)] + [("b", 1000 + i, float(i)) for i in range(61)] + [("b", 2000, 60.0), ("b", 2001, 500.0)], "tool string, event_id long, at double")
    batch = limiter.allowed(calls).toPandas()
    want = {}
    for tool in ("a", "b"):
        own = sorted((r["at"], r["event_id"]) for r in calls.where(F.col("tool") == tool).collect())
        for (_, i), ok in zip(own, limiter.admit([t for t, _ in own], deque()), strict=True):
            want[i] = ok
    assert dict(zip(batch["event_id"], batch["allowed"], strict=True)) == want
    assert rows(_run(spark, tmp_path, calls, limiter.stream, "append").toPandas()) == rows(batch)


def test_rate_limit_of_bursts(spark):
    """Calm times, bursts and ties in many buckets of time: as one pass in order decides."""
    rng, calls, i = random.Random(3), [], 0
    for tool in "abc":
        t = 0.0
        for _ in range(40):
            t += rng.choice([1.0, 30.0, 59.9, 60.0, 61.0, 400.0])
            for _ in range(rng.choice([1, 20, 59, 60, 61, 130])):
                t += rng.choice([0.0, 0.1, 0.5, 1.0, 1.5])
                calls.append((tool, i, t))
                i += 1
    want = {}
    for tool in "abc":
        own = sorted((t, i) for c, i, t in calls if c == tool)
        want |= zip([i for _, i in own], limiter.admit([t for t, _ in own], deque()), strict=True)
    assert 0 < sum(want.values()) < len(want)
    got = limiter.allowed(spark.createDataFrame([*calls, ("a", -1, None), (None, -2, 1.0)], "tool string, event_id long, at double").repartition(7)).collect()
    assert len(got) == len(calls) + 2
    assert {r["event_id"]: r["allowed"] for r in got} == want | {-1: True, -2: True}


def test_trailing_count(spark):
    rng = random.Random(4)
    times = [rng.randrange(400) for _ in range(300)]
    calls = spark.createDataFrame([*enumerate(times), (300, None)], "i long, at long").withColumn("k", F.col("i") % 2)
    got = {r["i"]: r["trailing"] for r in windows.trailing_count(calls, "k", "at", 50).collect()}
    want = {i: sum(j % 2 == i % 2 and t - 50 < u <= t for j, u in enumerate(times)) for i, t in enumerate(times)}
    assert got == want | {300: 1}


def test_admit_is_strict_and_rejected_calls_do_not_count():
    assert limiter.admit([0.0] * 61, deque()) == [True] * 60 + [False]
    assert limiter.admit([0.0] * 60 + [59.9, 60.0], deque()) == [True] * 60 + [False, True]


def test_decision_stream(spark, sf_dir, tmp_path):
    e = windows.timed(spark.read.parquet(f"{sf_dir}/events.parquet"))
    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    both = windows.decision_stream(s.where("event_type = 'signup'"), s.where("event_type IN ('purchase', 'error')"))
    q = both.writeStream.outputMode("append").format("memory").queryName("pairs").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["request"] for r in spark.table("pairs").where("answer IS NOT NULL").collect()}
    want = windows.decisions(e.where("event_type = 'signup'"), e.where("event_type IN ('purchase', 'error')")).where("decision <> 'timeout'")
    assert got == {r["request"] for r in want.collect()}


def lots_of(spark, rows, schema, cuts):
    df = spark.createDataFrame(rows, schema)
    return [df.where((F.col("seq") >= a) & (F.col("seq") < b)) for a, b in zip(cuts, cuts[1:], strict=False)]


COMMANDS = "task long, second long, seq long, what string, subscriber string, status string, model string"


@pytest.mark.parametrize("cuts", [[0, 99], [0, 4, 6, 99], [0, 2, 5, 7, 8, 99]])
def test_frames_do_not_depend_on_micro_batches(spark, cuts):
    """Signs of life by the clock of commands: sent with the next command or by a timer, and each once."""
    rows = [
        (1, 100, 0, "update", None, "parsing", "m"), (1, 101, 1, "subscribe", "a", None, None), (1, 131, 2, "create", None, "queued", "m"), (2, 131, 3, "create", None, "queued", None),
        (1, 146, 4, "update", None, "parsing", None), (1, 150, 5, "cancel", None, None, None), (1, 160, 6, "cancel", None, None, None), (1, 170, 7, "subscribe", "b", None, None),
        (1, 200, 8, "update", None, "done", "n"), (1, 230, 9, "update", None, "parsing", None), (2, 231, 10, "subscribe", "c", None, None), (2, 300, 11, "update", None, "failed", None),
    ]
    lots = [x.withColumn("at", F.timestamp_seconds("second")).drop("second") for x in lots_of(spark, rows, COMMANDS, cuts)]
    got = windows.in_goes(spark, lots, broker.frames).select("task", "subscriber", F.unix_seconds("at"), "kind", "status", "model", "idle")
    life = lambda task, who, *at: [(task, who, t, "keep-alive", None, None, i) for i, t in enumerate(at, 1)]
    want = [(1, "a", 131, "state", "queued", "m", 1), (1, "a", 146, "state", "parsing", "m", 0), (1, "a", 150, "state", "cancelled", "m", 0), (1, "b", 170, "state", "cancelled", "m", 0)]
    want += [(1, w, 200, "state", "done", "n", n) for w, n in (("a", 3), ("b", 1))] + [(2, "c", 231, "state", "queued", None, 0), (2, "c", 300, "state", "failed", None, 4)]
    want += life(1, "a", 116) + life(1, "a", 165, 180, 195) + life(1, "b", 185) + life(2, "c", 246, 261, 276, 291)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("cuts", [[0, 99], [0, 2, 5, 7, 99]])
def test_states_without_their_signs_of_life(spark, cuts):
    """A subscriber who waits for ten years: the state tells of the signs of life before it, and none is made."""
    year = 31_536_000
    rows = [
        (1, 10, 0, "subscribe", "a", None, None), (1, 40, 1, "create", None, "queued", "m"), (1, 50, 2, "subscribe", "b", None, None), (1, 55, 3, "cancel", None, None, None), (1, 60, 4, "cancel", None, None, None),
        (1, 70, 5, "update", None, "parsing", None), (1, 70 + 10 * year, 6, "update", None, "done", None), (1, 80 + 10 * year, 7, "update", None, "failed", None), (2, 90 + 10 * year, 8, "create", None, "queued", None),
    ]
    lots = [x.withColumn("at", F.timestamp_seconds("second")).drop("second") for x in lots_of(spark, rows, COMMANDS, cuts)]
    got = windows.in_goes(spark, lots, lambda s: broker.frames(s, signs=False)).select("subscriber", F.unix_seconds("at"), "kind", "status", "idle")
    want = [("a", 40, "state", "queued", 1), ("b", 50, "state", "queued", 0)] + [(w, 55, "state", "cancelled", 0) for w in "ab"] + [(w, 70, "state", "parsing", 0) for w in "ab"] + [(w, 70 + 10 * year, "state", "done", (10 * year - 1) // 15) for w in "ab"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_signs_of_life_by_the_clock_of_the_machine(spark, tmp_path):
    """No command comes, yet frames do; and a task is forgotten when its time is over."""
    rows = [(1, 100, 0, "create", None, "queued", None), (1, 101, 1, "subscribe", "a", None, None)]
    spark.createDataFrame(rows, COMMANDS).withColumn("at", F.timestamp_seconds("second")).drop("second").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("task long, seq long, what string, subscriber string, status string, model string, at timestamp").parquet(str(tmp_path / "in"))
    write = broker.frames(stream, 1, "processing", ttl=3600).writeStream.outputMode("append").format("memory").queryName("life").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second")
    q = broker.start(spark, write.start)
    try:
        for _ in range(60):
            time.sleep(1)
            if spark.table("life").where("kind = 'keep-alive'").count() > 1:
                break
    finally:
        q.stop()
    got = spark.table("life").orderBy("at").collect()
    assert [r["kind"] for r in got[:3]] == ["state", "keep-alive", "keep-alive"] and [r["idle"] for r in got[:3]] == [0, 1, 2]
    with pytest.raises(ValueError):
        broker.frames(stream, ttl=5)


@pytest.mark.parametrize("cuts", [[0, 99], [0, 4, 7, 99]])
def test_sessions_of_owners(spark, cuts):
    say = lambda seq, s: (1, seq, "say", s, f"text {seq}")
    rows = [
        (1, 0, "list", None, None), (1, 1, "create", None, None), (1, 2, "get_or_create", "1-1", None), (1, 3, "get_or_create", "1-9", None), say(4, "1-1"), say(5, "1-1"), say(6, "1-3"), (1, 7, "get", "1-1", None),
        (1, 8, "list", None, None), (1, 9, "close", "1-1", None), (1, 10, "close", "1-1", None), say(11, "1-1"), (1, 12, "get", "1-3", None), (1, 13, "get", None, None), (1, 14, "list", None, None), (2, 15, "get", "1-3", None), (2, 16, "list", None, None),
        (1, 17, "close", "1-3", None), (1, 18, "list", None, None), (1, 19, "create", None, None), say(20, "1-19"),
    ]
    got = windows.in_goes(spark, lots_of(spark, rows, "owner long, seq long, what string, session string, text string", cuts), sessions.answers).orderBy("seq")
    want = [("", True, 0), ("1-1", True, 1), ("1-1", True, 0), ("1-3", True, 2), ("1-1", True, 1), ("1-1", True, 2), ("1-3", True, 1), ("1-1", True, 2)]
    want += [("1-1,1-3", True, 2), ("1-1", True, 1), ("1-1", False, 1), ("1-1", False, 0), ("1-3", True, 1), (None, False, 0), ("1-3", True, 1), ("1-3", False, 0), ("", True, 0), ("1-3", True, 0), ("", True, 0), ("1-19", True, 1), ("1-19", True, 1)]
    assert [(r["session"], r["ok"], r["n"]) for r in got.collect()] == want


def test_decisions_meet_by_bucket(spark):
    """Rows are matched by user and time together; pairs at the edges of the hour and of a bucket are those of a plain loop."""
    hour, base = 3600, 1_704_067_200
    asked = [(i, base + s, i % 2) for i, s in enumerate((0, 1, hour - 1, hour, hour + 1, 5 * hour - 1))]
    told = [(100 + i, base + s, i % 2) for i, s in enumerate((0, 1, hour - 1, hour, hour, hour + 1, 2 * hour - 1, 2 * hour, 2 * hour + 1, 6 * hour))]
    frame = lambda rows: spark.createDataFrame(rows, "event_id long, s long, user_id long").select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", F.lit("x").alias("event_type"), F.lit(1.0).alias("value"))
    met = windows.decision_stream(frame(asked), frame(told))
    keys = met._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter", 1)[1].split("\n", 1)[0]
    assert "(b#" in keys and "user_id" in keys
    rows = met.collect()
    want = {(r, a) for r, t, u in asked for a, x, v in told if u == v and t <= x <= t + hour}
    pairs = [(r["request"], r["answer"]) for r in rows if r["answer"] is not None]
    assert len(pairs) == len(want) and set(pairs) == want
    assert {r["request"] for r in rows} == {r for r, _, _ in asked}
