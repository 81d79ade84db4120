"""Tools on executors: Python functions by name, run by an Arrow table function over rows of calls.

A call's arguments are bound by the function's own signature: named ones, ``_context`` with the call's context, all others where the
function takes any. A missing argument, an unknown tool, arguments that are no JSON object and a failure are errors of their own
row and of no other; what is no dict comes back as {"result": ...}. Rows go to Python in batches of columns, part by part, and no
call is shuffled. Counts of calls and failures come from an ``Observation`` of the same run, not from anything on the driver.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from granary.session import ship


def execute(f: Callable | None, name: str, arguments: dict, context: dict) -> dict:
    """What a call gives, as a dict; an error is one with ``error``."""
    if f is None:
        return {"error": f"tool not registered: {name}"}
    try:
        parameters, given = inspect.signature(f).parameters, {}
        for key, p in parameters.items():
            if key == "_context":
                given[key] = context
            elif key in arguments:
                given[key] = arguments[key]
            elif p.default is p.empty and p.kind not in (p.VAR_POSITIONAL, p.VAR_KEYWORD):
                return {"error": f"missing required argument: {key}"}
        if any(p.kind == p.VAR_KEYWORD for p in parameters.values()):
            given = {**arguments, **given}
        got = f(**given)
        return got if isinstance(got, dict) else {"result": got}
    except Exception as e:  # a tool's failure is its result
        return {"error": f"tool execution failed: {e}"}


def _read(text: str | None) -> dict:
    """A JSON object; nothing is an empty one."""
    got = json.loads(text) if text else {}
    if got is not None and not isinstance(got, dict):
        raise ValueError("arguments are no JSON object")
    return got or {}


def _write(got: dict) -> str:
    return json.dumps(got, ensure_ascii=False, separators=(",", ":"), default=str)


def run_tools(calls: DataFrame, tools: dict[str, Callable]) -> DataFrame:
    """(call_id, tool, result, error) from ``calls`` (call_id long, tool, arguments: JSON[, context: JSON]): one of the two is null."""
    ship(calls.sparkSession)

    class Run:
        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            out: list[tuple[str | None, str | None]] = []
            for name, arguments, context in zip(*(rows.column(c).to_pylist() for c in ("tool", "arguments", "context")), strict=True):
                try:
                    got = execute(tools.get(name), name, _read(arguments), _read(context))
                    out.append((None, str(got["error"])) if "error" in got else (_write(got), None))
                except Exception as e:  # arguments that do not parse, results that cannot be written
                    out.append((None, f"tool execution failed: {e}"))
            yield pa.table({"call_id": rows.column("call_id"), "tool": rows.column("tool"), "result": pa.array([r for r, _ in out], pa.string()), "error": pa.array([e for _, e in out], pa.string())})

    context = F.col("context").cast("string") if "context" in calls.columns else F.lit(None).cast("string")
    rows = calls.select(F.col("call_id").cast("long").alias("call_id"), F.col("tool").cast("string").alias("tool"), F.col("arguments").cast("string").alias("arguments"), context.alias("context"))
    return F.arrow_udtf(Run, returnType="call_id long, tool string, result string, error string")(rows.asTable())


def watched(answers: DataFrame, tools: list[str]) -> tuple[DataFrame, Observation]:
    """The answers with an observation: ``calls`` and ``failures`` of all, and of each tool as ``<tool>_calls`` and ``<tool>_failures``.

    It is filled by the action that runs the answers; one metric for each of the given names.
    """
    seen, failed = Observation(), F.col("error").isNotNull()
    per = [x for t in tools for own in (F.col("tool") == t,) for x in (F.count_if(own).alias(f"{t}_calls"), F.count_if(own & failed).alias(f"{t}_failures"))]
    return answers.observe(seen, F.count("*").alias("calls"), F.count_if(failed).alias("failures"), *per), seen
