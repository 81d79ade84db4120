"""Pluggable column functions: an encoder, a translator and a chat model, each with a deterministic stand-in in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .scalars import unit
from .text import let, tokens

#: Dimensions of the stand-in encoder.
DIM = 64


def hashed_slots(c: Column, dim: int = DIM) -> Column:
    """For each distinct word the dimension that it counts in."""
    return F.transform(tokens(c), lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))


def hashed_vector(c: Column, dim: int = DIM) -> Column:
    """Distinct words hashed into ``dim`` counts, of length one: what stands in for a sentence encoder."""
    counts = let(hashed_slots(c, dim), lambda own: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.size(own) - F.size(F.array_remove(own, i))).cast("double")))
    return let(counts, unit)


def identity_translation(c: Column) -> Column:
    """The stand-in translator gives the text back; a text that holds "fail" fails."""
    return F.when(~F.contains(F.lower(c), F.lit("fail")), c)


_PLUGGED: dict[str, Callable[[Column], Column]] = {"encode": hashed_vector, "translate": identity_translation, "chat": lambda c: F.concat(F.lit("echo: "), c)}


def plug(name: str, f: Callable[[Column], Column]) -> None:
    """Put a service's function of a Column (an Arrow UDF, say) in place of a stand-in."""
    if name not in _PLUGGED:
        raise KeyError(f"no such function: {name}; known are {sorted(_PLUGGED)}")
    _PLUGGED[name] = f


def plugged(name: str) -> Callable[[Column], Column]:
    return _PLUGGED[name]


class Tools:
    """Tools by name: each checks its arguments and never raises; a result or an error comes back, and calls are counted."""

    def __init__(self) -> None:
        self._tools: dict[str, tuple[Callable, tuple[str, ...]]] = {}
        self.calls: dict[str, int] = {}

    def register(self, name: str, f: Callable, required: tuple[str, ...] = ()) -> None:
        self._tools[name] = (f, required)

    def run(self, name: str, arguments: dict) -> dict:
        self.calls[name] = self.calls.get(name, 0) + 1
        if name not in self._tools:
            return {"error": f"unknown tool: {name}"}
        f, required = self._tools[name]
        if missing := [r for r in required if r not in arguments]:
            return {"error": f"missing arguments: {', '.join(missing)}"}
        try:
            got = f(**arguments)
        except Exception as e:  # a tool's failure is a result
            return {"error": str(e)}
        return got if isinstance(got, dict) else {"result": got}

    def as_udf(self, spark: SparkSession, name: str, returns: str = "string") -> None:
        """Register a tool for use in SQL."""
        spark.udf.register(name, self._tools[name][0], returns)
