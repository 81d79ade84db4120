"""A limit on calls in a trailing window, where a rejected call does not count."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .windows import trailing_count

LIMIT, SECONDS = 60, 60.0


def admit(times: list[float], recent: deque, limit: int = LIMIT, seconds: float = SECONDS) -> list[bool]:
    """Calls in order of time; ``recent`` has those let through, at most ``limit`` of them, and is changed."""
    out = []
    for t in times:
        while recent and recent[0] <= t - seconds:
            recent.popleft()
        ok = len(recent) < limit
        if ok:
            recent.append(t)
        out.append(ok)
    return out


def _decide(limit: int, seconds: float) -> Callable:
    """For mapInPandas over whole runs in order: one run after another, with no more than ``limit`` times in memory."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, recent = None, deque()
        for pdf in it:
            for key, part in pdf.groupby(["tool", "run"], sort=False):
                if key != before:
                    before, recent = key, deque()
                ok = admit(part["at"].tolist(), recent, limit, seconds)
                yield part.assign(allowed=ok).loc[part["own"], ["tool", "event_id", "allowed"]]

    return run


def allowed(calls: DataFrame, limit: int = LIMIT, seconds: float = SECONDS) -> DataFrame:
    """(tool, event_id, allowed) from (tool, event_id, at: seconds).

    A call with at most ``limit`` calls in the window before it, itself included, is let through whatever became of the others.
    Only buckets of time with a call beyond that are decided in order: neighbouring ones make a run, which starts with the calls
    of the calm bucket before it, all let through. Runs are decided apart. Within a run each decision hangs on the ones before, so
    a tool that is over its limit without a pause is one run: it streams through one task, sorted, with ``limit`` times in memory.
    A call without a time or tool is let through and counts for nothing.
    """
    # A bucket is longer than the window, so calls two buckets back are out of it however a quotient is rounded.
    width = seconds * 17 / 16
    timed = calls.select("tool", "event_id", "at", F.floor(F.col("at") / F.lit(width)).cast("long").alias("b"))
    crowded = trailing_count(timed.where("at IS NOT NULL AND tool IS NOT NULL").select("tool", "at", "b"), "tool", "at", width).where(F.col("trailing") > limit).select("tool", "b").distinct()
    runs = crowded.withColumn("run", F.col("b") - F.row_number().over(Window.partitionBy("tool").orderBy("b")))
    first = runs.groupBy("tool", "run").agg((F.min("b") - 1).alias("b")).select("tool", "b", "run", F.lit(False).alias("own"))
    parts = runs.select("tool", "b", "run", F.lit(True).alias("own")).unionByName(first)
    met = timed.join(parts, ["tool", "b"], "left")
    calm = met.where("own IS NULL OR NOT own").select("tool", "event_id", F.lit(True).alias("allowed"))
    order = ["tool", "run", "at", "event_id"]
    busy = met.where("run IS NOT NULL").select(*order, "own").repartition("tool", "run").sortWithinPartitions(*order)
    return calm.unionByName(busy.mapInPandas(_decide(limit, seconds), "tool string, event_id long, allowed boolean"))


def _update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    recent = deque(state.get[0] if state.exists else [])
    for pdf in batches:
        pdf = pdf.sort_values(["at", "event_id"])
        yield pd.DataFrame({"tool": key[0], "event_id": pdf["event_id"], "allowed": admit(pdf["at"].tolist(), recent)})
    state.update((list(recent),))


def stream(calls: DataFrame) -> DataFrame:
    """The same for a stream whose calls come in order; the state of a tool has at most LIMIT times."""
    return calls.groupBy("tool").applyInPandasWithState(_update, "tool string, event_id long, allowed boolean", "recent array<double>", "append", "NoTimeout")
