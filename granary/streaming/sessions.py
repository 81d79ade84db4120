"""Chat sessions by key, by ``transformWithState``: a map of the open ones, a list of what was said, and a time to live.

Commands (owner, seq, what, session, text) come in order of ``seq``; each gives one answer (owner, seq, what, session, ok, n):

- ``create``: a new session, named owner-seq; n is the number of open ones.
- ``get``: whether the session is open; n is the number of messages that it holds.
- ``get_or_create``: the session if it is open, else a new one.
- ``say``: a message for an open session; n is the number that it holds then.
- ``close``: ok if it was open; its messages are forgotten; n is the number of open ones.
- ``list``: the names of the open sessions, in order of their making, as ``session``, joined by commas; n is their number.

An owner's commands of one micro-batch are held together. With ``ttl`` sessions that were not made or spoken in for so many
seconds of the machine's clock are forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from granary.session import ship

ANSWERS = "owner long, seq long, what string, session string, ok boolean, n long"


class Sessions(StatefulProcessor):
    def __init__(self, ttl: int | None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        ms = self.ttl * 1000 if self.ttl else None
        self.open = handle.getMapState("open", "session string", "made long, messages long", ms)
        self.said = handle.getListState("said", "session string, text string", ms)

    def close(self) -> None:
        pass

    def _count(self) -> int:
        return sum(1 for _ in self.open.keys())  # noqa: SIM118

    def _one(self, owner: int, seq: int, what: str, session: str | None, text: str | None) -> tuple[str | None, bool, int]:
        """(session, ok, n) of a command."""
        if what == "list":
            names = [name for (name,), _ in sorted(self.open.iterator(), key=lambda x: (x[1][0], x[0]))]
            return ",".join(names), True, len(names)
        there = isinstance(session, str) and self.open.containsKey((session,))
        if what == "create" or (what == "get_or_create" and not there):
            self.open.updateValue((f"{owner}-{seq}",), (seq, 0))
            return f"{owner}-{seq}", True, self._count()
        if not there:
            return session, False, self._count() if what == "close" else 0
        made, n = self.open.getValue((session,))
        if what == "say":
            n += 1
            self.open.updateValue((session,), (made, n))
            self.said.appendValue((session, text))
        elif what == "close":
            self.open.removeKey((session,))
            if n:
                rest = [x for x in self.said.get() if x[0] != session]
                self.said.put(rest) if rest else self.said.clear()  # a list without entries is no value
            n = self._count()
        return session, True, n

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        text = lambda x: x if isinstance(x, str) else None
        own = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = [(key[0], r.seq, r.what, *self._one(key[0], r.seq, r.what, text(r.session), text(r.text))) for r in own.itertuples()]
        yield pd.DataFrame(out, columns=["owner", "seq", "what", "session", "ok", "n"])


def answers(commands: DataFrame, ttl: int | None = None) -> DataFrame:
    """The answers to a stream of commands."""
    ship(commands.sparkSession)
    return commands.groupBy("owner").transformWithStateInPandas(Sessions(ttl), ANSWERS, "Append", "ProcessingTime" if ttl else "None")
