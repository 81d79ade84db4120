"""An event bus: events of a stream go to all subscribers whose pattern fits, each apart from the others.

Patterns are globs (``*``, ``?``, ``[ab]``, ``[!ab]``) on ``layer.action`` or on the component; a null pattern takes every event.
Subscribers are a table of at most ``MOST`` rows, which every task holds; its size is checked. An event without a time is stamped.
A handler is an expression for each subscriber that gives a text, or null where it fails; a failure is a row of its own subscriber
with ``ok`` false, and no other delivery is touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 10_000


def glob(pattern: Column) -> Column:
    """The regular expression of a glob."""
    plain = F.regexp_replace(pattern, r"([.\\^$+{}()|])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(F.replace(F.replace(plain, F.lit("[!"), F.lit("[^")), F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def deliveries(events: DataFrame, subscribers: DataFrame, now: Column, handlers: dict[str, Column]) -> DataFrame:
    """(subscriber, event_id, stamp, ok, answer) from ``events`` (event_id, at, layer, component, action, ...) and ``subscribers``
    (subscriber, pattern); works on streams and tables alike. A subscriber without a handler answers with an empty text."""
    n = subscribers.limit(MOST + 1).count()
    if n > MOST:
        raise ValueError(f"more than {MOST} subscribers")
    rules = F.broadcast(subscribers.select("subscriber", glob(F.col("pattern")).alias("re")))
    key = F.concat_ws(".", "layer", "action")
    fits = F.col("re").isNull() | F.expr("rlike(_key, re)") | F.expr("rlike(component, re)")
    met = events.withColumn("_key", key).withColumn("stamp", F.coalesce("at", now)).join(rules, F.coalesce(fits, F.lit(False)))
    answer = F.coalesce(*(F.when(F.col("subscriber") == s, F.struct(h.cast("string").alias("text"))) for s, h in handlers.items()), F.struct(F.lit("").alias("text"))) if handlers else F.struct(F.lit("").alias("text"))
    return met.select("subscriber", "event_id", "stamp", answer["text"].isNotNull().alias("ok"), answer["text"].alias("answer"))
