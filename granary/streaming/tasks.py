"""Task state: the batch form, and the same rules for a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TERMINAL = ("done", "failed", "cancelled")


def latest(reports: DataFrame) -> DataFrame:
    """(task, status, model, updates) from (task, at, status, model): reports after the first ending one do not count.

    Two aggregates with partial sums and one join on the task; no task's reports have to meet in one place.
    """
    ended = reports.where(F.col("status").isin(*TERMINAL)).groupBy("task").agg(F.min("at").alias("ended"))
    live = reports.join(ended, "task", "left").where("ended IS NULL OR at <= ended")
    named = F.when(F.col("model").isNotNull(), F.col("at"))
    return live.groupBy("task").agg(F.max_by("status", "at").alias("status"), F.max_by("model", named).alias("model"), F.count("*").alias("updates"))


def cancel(states: DataFrame, requests: DataFrame) -> DataFrame:
    """(task, accepted, status after it) of each request: only a known task that has not ended can be cancelled."""
    met = requests.select("task").distinct().join(states.select("task", "status"), "task", "left")
    runs = F.col("status").isNotNull() & ~F.col("status").isin(*TERMINAL)
    after = F.when(F.col("status").isNull(), "unknown").when(runs, "cancelled").otherwise(F.col("status"))
    return met.select("task", F.coalesce(runs, F.lit(False)).alias("accepted"), after.alias("status"))


#: A subscription ends on these; a cancelled task may still be heard of.
LAST = ("done", "failed")


def frames(reports: DataFrame, subscribers: DataFrame, every: int = 15) -> DataFrame:
    """(task, at, status, idle) from (task, at: whole seconds, status) and (task, since): what a subscriber is sent.

    First the state at that time, if the task is known; then each change until one that ends it. ``idle`` is the number of signs
    of life sent before, one for each ``every`` seconds without a change; a change on that very second goes first.
    """
    met = reports.join(subscribers, "task")
    now = met.where("at <= since").groupBy("task", "since").agg(F.max_by("status", "at").alias("status")).select("task", F.col("since").alias("at"), "status", "since")
    all_ = now.unionByName(met.where("at > since").select("task", "at", "status", "since"))
    w = Window.partitionBy("task").orderBy("at")
    over = F.max(F.col("status").isin(*LAST)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.col("at") - F.coalesce(F.lag("at").over(w), F.col("since"))
    idle = F.greatest(F.floor((gap - 1) / F.lit(every)), F.lit(0)).cast("long")
    return all_.select("task", "at", "status", idle.alias("idle"), F.coalesce(over, F.lit(False)).alias("over")).where("NOT over").drop("over")


STATE = "status string, model string, updates long"
OUTPUT = "task long, status string, model string, updates long"


def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """For applyInPandasWithState: the state of one task after the reports of a micro-batch, in order of ``at``."""
    status, model, n = state.get if state.exists else (None, None, 0)
    rows = pd.concat(list(batches)).sort_values("at")
    changed = False
    for r in rows.itertuples():
        if status in TERMINAL:
            break
        status, n, changed = r.status, n + 1, True
        if isinstance(r.model, str):
            model = r.model
    state.update((status, model, n))
    if changed:
        yield pd.DataFrame({"task": [key[0]], "status": [status], "model": [model], "updates": [n]})


def stream(reports: DataFrame) -> DataFrame:
    """The changes of each task's state, in update mode."""
    return reports.groupBy("task").applyInPandasWithState(update, OUTPUT, STATE, "update", "NoTimeout")
