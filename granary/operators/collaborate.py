"""Ways in which several functions of a Column work on one task; each function is plugged in and may be an Arrow UDF.

A function's failure is a null. All of it is one plan: no text comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Agent = Callable[[Column], Column]
#: Rounds of tool calls before a closing call.
ROUNDS = 4


def round_robin(agents: list[Agent], task: Column) -> Column:
    """Each works on what the one before it gave; one that fails is passed over."""
    return reduce(lambda c, a: F.coalesce(a(c), c), agents, task)


def debate(agents: list[Agent], review: Callable[[Column], Column], task: Column) -> Column:
    """The first proposal that is there and that the review takes; else the first that is there."""
    proposals = [a(task) for a in agents]
    good = [F.when(review(p), p) for p in proposals]
    return F.coalesce(*good, *proposals)


def supervise(tasks: DataFrame, key: str, column: str, split: Callable[[Column], Column], worker: Agent, glue: str = "\n") -> DataFrame:
    """(key, answer): a task in parts, each part worked on apart, the answers put together in order."""
    parts = tasks.select(key, F.posexplode(split(F.col(column))).alias("pos", "part"))
    done = parts.withColumn("answer", F.coalesce(worker(F.col("part")), F.col("part")))
    return done.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "answer"))), lambda x: x["answer"]), glue).alias("answer"))


def tool_loop(tasks: DataFrame, column: str, wants_tool: Callable[[Column], Column], tool: Agent, chat: Agent, rounds: int = ROUNDS) -> DataFrame:
    """``answer``: up to ``rounds`` calls of a tool for the rows that want one, then a closing call of the model for all."""
    state = F.col(column)
    for _ in range(rounds):
        state = F.when(wants_tool(state), F.coalesce(tool(state), state)).otherwise(state)
    return tasks.withColumn("answer", chat(state))


def clarify(question: Column, ask: Agent, least: int = 15) -> Column:
    """A question back for long enough questions; NO or a very short answer is none."""
    answer = ask(question)
    return F.when((F.length(question) > least) & (F.upper(F.trim(answer)) != "NO") & (F.length(answer) >= 10), answer)


PATTERNS = {"round_robin": round_robin, "debate": debate, "supervise": supervise, "tool_loop": tool_loop}
