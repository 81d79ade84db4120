"""Tasks and those who listen to them, by ``transformWithState``: value state, map state, timers and a time to live.

Commands (task, at: timestamp, seq, what, subscriber, status, model) come in order of time; those of one second by ``seq``:

- ``create``: the task is queued, with the model that is given; a task that is there starts anew.
- ``update``: a status, and a model where one is given, else the last one stays. An unknown task is not touched.
- ``cancel``: a task that has not ended is cancelled; ended and unknown ones are not touched.
- ``subscribe``: the task's state, if it is known, then each change until one that is done or failed; a sign of life after each
  ``every`` seconds without a frame. A change on that very second goes first.

Frames (task, subscriber, at, kind, status, model, idle): kind is ``state`` or ``keep-alive``; ``idle`` counts the signs of life
since the last state, so states alone tell them all. Frames do not depend on how commands fall into micro-batches: signs of life
before a command are sent with it, later ones by a timer, as far as the watermark is. On ``clock="processing"`` the time of the
machine decides instead, commands count when they come, and tasks are forgotten ``ttl`` seconds after their last command.

A subscriber that waits long is sent many signs of life, as many as the seconds by ``every``, whatever the number of commands. With
``signs=False`` states alone are sent: ``idle`` is worked out from the time of the last one and no timer is set, so the work grows
with the commands. The states and their ``idle`` are the same.

A task's commands of one micro-batch are held together, and its subscribers are looked through at each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from granary.session import ship

from .tasks import LAST, TERMINAL

FRAMES = "task long, subscriber string, at timestamp, kind string, status string, model string, idle long"
#: State with several columns and timers is kept by this provider alone.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def start(spark: SparkSession, write: Callable):
    """Start a stream with the state store that ``transformWithState`` needs; the session's own setting is put back."""
    ship(spark)
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        return write()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER[0])
        else:
            spark.conf.set(PROVIDER[0], before)


class Broker(StatefulProcessor):
    def __init__(self, every: int, processing: bool, ttl: int | None, signs: bool = True):
        self.every, self.processing, self.ttl, self.signs = every * 1000, processing, ttl, signs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", "status string, model string", self.ttl * 1000 if self.ttl else None)
        self.listeners = handle.getMapState("listeners", "subscriber string", "last long, idle long", self.ttl * 1000 if self.ttl else None)

    def close(self) -> None:
        pass

    def _heard(self) -> dict[str, tuple[int, int]]:
        return {who: tuple(at) for (who,), at in self.listeners.iterator()}

    def _keep(self, before: dict[str, tuple[int, int]], heard: dict[str, tuple[int, int]]) -> None:
        """State is read and written once for all commands that come together, as each access is a call of the JVM."""
        for who in before.keys() - heard.keys():
            self.listeners.removeKey((who,))
        for who, at in heard.items():
            if before.get(who) != at:
                self.listeners.updateValue((who,), at)
        if self.signs:
            self._timer(heard)

    def _life(self, key: tuple, heard: dict[str, tuple[int, int]], until: int, out: list[tuple]) -> None:
        """Signs of life of all subscribers before a time, which is in milliseconds."""
        for who, (last, idle) in heard.items():
            n = max(0, (until - last - 1) // self.every)
            out += [(*key, who, last + k * self.every, "keep-alive", None, None, idle + k) for k in range(1, n + 1)]
            heard[who] = (last + n * self.every, idle + n)

    def _tell(self, key: tuple, state: tuple, heard: dict[str, tuple[int, int]], who: str, at: int, out: list[tuple]) -> None:
        """A subscriber is sent the state."""
        last, idle = heard[who]
        out.append((*key, who, at, "state", *state, idle if self.signs else max(0, (at - last - 1) // self.every)))
        if state[0] in LAST:
            del heard[who]
        else:
            heard[who] = (at, 0)

    def _timer(self, heard: dict[str, tuple[int, int]]) -> None:
        """One timer, for the next sign of life."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if heard:
            self.handle.registerTimer(min(last for last, _ in heard.values()) + self.every)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        text = lambda x: x if isinstance(x, str) else None
        before = state = tuple(self.task.get()) if self.task.exists() else None
        listened = self._heard()
        heard = dict(listened)
        for r in pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable").itertuples():
            at = timerValues.getCurrentProcessingTimeInMs() if self.processing else r.at.value // 1_000_000
            if self.signs:
                self._life(key, heard, at, out)
            if r.what == "subscribe":
                heard[r.subscriber] = (at, 0)
                if state:
                    self._tell(key, state, heard, r.subscriber, at, out)
                continue
            if r.what == "create":
                state = (r.status, text(r.model))
            elif state and r.what == "update":
                state = (r.status, text(r.model) or state[1])
            elif state and r.what == "cancel" and state[0] not in TERMINAL:
                state = ("cancelled", state[1])
            else:
                continue
            for who in list(heard):
                self._tell(key, state, heard, who, at, out)
        if state and (self.ttl or state != before):
            self.task.update(state)
        self._keep(listened, heard)
        yield _frames(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        now = timerValues.getCurrentProcessingTimeInMs() + 1 if self.processing else timerValues.getCurrentWatermarkInMs()
        listened = self._heard()
        heard = dict(listened)
        self._life(key, heard, now, out)
        self._keep(listened, heard)
        yield _frames(out)


def _frames(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["task", "subscriber", "at", "kind", "status", "model", "idle"])
    return out.assign(at=pd.to_datetime(out["at"].astype("int64"), unit="ms"), idle=out["idle"].astype("int64"), task=out["task"].astype("int64"))


def frames(commands: DataFrame, every: int = 15, clock: str = "event", ttl: int | None = None, signs: bool = True) -> DataFrame:
    """The frames of a stream of commands, with the signs of life or the states alone."""
    ship(commands.sparkSession)
    processing = clock == "processing"
    if ttl and not processing:
        raise ValueError("a time to live is one of the machine's clock")
    if processing and not signs:
        raise ValueError("on the machine's clock there are signs of life")
    timed = commands if processing else commands.withWatermark("at", "0 seconds")
    return timed.groupBy("task").transformWithStateInPandas(Broker(every, processing, ttl, signs), FRAMES, "Append", "ProcessingTime" if processing else "EventTime")
