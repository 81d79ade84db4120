"""Queries of chat and task control: histories for a prompt, sums by round, cancelling, subscriptions, functions that work together.

Models are services; here deterministic functions of a Column stand for them, so that SQL can say the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions import text as tx
from granary.operators import collaborate as co
from granary.operators import relational as rel
from granary.sources import sinks
from granary.sources.tables import load
from granary.streaming import tasks, windows

from . import sql as q
from .registry import query
from .stream_queries import _STATUS, reports
from .text_queries import chunk_rows


@query("""
WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
SELECT conv_id, '【之前的对话历史】' || string_agg(chr(10) || CASE role WHEN 'user' THEN '用户' ELSE '助手' END || '：' || substr(coalesce(text, ''), 1, 200), '' ORDER BY turn) AS history FROM m WHERE back <= 10 GROUP BY 1
""")
def q_history_lines(spark: SparkSession, d: str) -> DataFrame:
    """The last ten messages of a session, 200 characters of each, as one block for a prompt."""
    last = rel.best_per(load(spark, d, "conversations"), ["conv_id"], [F.desc("turn")], 10)
    return last.groupBy("conv_id").agg(tx.history_lines(F.array_sort(F.collect_list(F.struct("turn", "role", "text")))).alias("history"))


@query("""
SELECT conv_id, turn, CAST(count(*) FILTER (role = 'assistant') OVER w AS BIGINT) AS round, CAST(coalesce(sum(length(text)) FILTER (role = 'user') OVER w, 0) AS BIGINT) AS prompt, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant') OVER w, 0) AS BIGINT) AS completion
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def q_usage_by_round(spark: SparkSession, d: str) -> DataFrame:
    """What a session has used after each message: sums that run over its rounds (characters stand for tokens)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    own = lambda role: F.coalesce(F.sum(F.when(F.col("role") == role, F.length("text"))).over(w), F.lit(0)).cast("long")
    rounds = F.count_if(F.col("role") == "assistant").over(w)
    return load(spark, d, "conversations").select("conv_id", "turn", rounds.alias("round"), own("user").alias("prompt"), own("assistant").alias("completion"))


_LATEST = f"""r AS (SELECT user_id AS task, event_id AS seq, {_STATUS} AS status FROM events WHERE event_id <= user_id % 97 * 20),
e AS (SELECT task, min(seq) AS ended FROM r WHERE status IN ('done', 'failed', 'cancelled') GROUP BY 1)"""


@query(f"""
WITH {_LATEST}, l AS (SELECT task, max_by(status, seq) AS status FROM r LEFT JOIN e USING (task) WHERE ended IS NULL OR seq <= ended GROUP BY 1),
c AS (SELECT DISTINCT c_custkey AS task FROM customer WHERE c_custkey % 2 = 0)
SELECT c.task, coalesce(status NOT IN ('done', 'failed', 'cancelled'), false) AS accepted, CASE WHEN status IS NULL THEN 'unknown' WHEN status IN ('done', 'failed', 'cancelled') THEN status ELSE 'cancelled' END AS status FROM c LEFT JOIN l USING (task)
""")
def q_task_cancel(spark: SparkSession, d: str) -> DataFrame:
    """Requests to cancel: taken from tasks that still run, refused by ended and unknown ones. Each comes at a time of its own."""
    asked = load(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("task"))
    so_far = reports(spark, d).where(F.col("at") <= F.col("task") % 97 * 20)
    return tasks.cancel(tasks.latest(so_far), asked)


@query(f"""
WITH r AS (SELECT user_id AS task, event_id AS seq, {_STATUS} AS status FROM events),
s AS (SELECT DISTINCT user_id AS task, user_id % 97 * 20 AS since FROM events),
f AS (SELECT task, since AS seq, max_by(r.status, r.seq) AS status FROM r JOIN s USING (task) WHERE r.seq <= since GROUP BY 1, 2 UNION ALL SELECT task, r.seq, status FROM r JOIN s USING (task) WHERE r.seq > since),
e AS (SELECT task, min(seq) AS ended FROM f WHERE status IN ('done', 'failed') GROUP BY 1),
k AS (SELECT f.* FROM f LEFT JOIN e USING (task) WHERE ended IS NULL OR seq <= ended)
SELECT task, seq AS "at", status, CAST(greatest((seq - coalesce(lag(seq) OVER (PARTITION BY task ORDER BY seq), since) - 1) // 15, 0) AS BIGINT) AS idle FROM k JOIN s USING (task)
""")
def q_subscription(spark: SparkSession, d: str) -> DataFrame:
    """What a subscriber of each task is sent: its state, then its changes until it ends, with signs of life while it is idle."""
    since = load(spark, d, "events").select(F.col("user_id").alias("task"), (F.col("user_id") % 97 * 20).alias("since")).distinct()
    return tasks.frames(reports(spark, d).select("task", "at", "status"), since)


def _ask(c: Column) -> Column:
    n = F.col("item_id") % 3
    return F.when(n == 0, " no ").when(n == 1, "Why?").otherwise(F.concat(F.lit("Do you mean: "), F.substring(c, 1, 20)))


@query("SELECT item_id, CASE WHEN length(q) > 15 AND item_id % 3 = 2 THEN 'Do you mean: ' || substr(q, 1, 20) END AS clarification FROM (SELECT item_id, CASE WHEN item_id % 4 = 0 THEN substr(text, 1, 15) ELSE text END AS q FROM benchmark)")
def q_clarify(spark: SparkSession, d: str) -> DataFrame:
    """A question back, for long enough questions and answers; every fourth question is cut to 15 characters, too short for one."""
    rows = load(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 4 == 0, F.substring("text", 1, 15)).otherwise(F.col("text")).alias("q"))
    return rows.select("item_id", co.clarify(F.col("q"), _ask).alias("clarification"))


@query("""
SELECT item_id, CASE WHEN length(text) % 2 = 0 THEN replace(text, ' ', '_') ELSE text END || '!' AS refined,
  CASE WHEN length(text) % 3 = 0 THEN 'a: ' || text WHEN length(text) % 2 = 0 THEN 'bb: ' || text ELSE 'c' END AS debated FROM benchmark
""")
def q_collaboration(spark: SparkSession, d: str) -> DataFrame:
    """Agents in turn, of which one fails at times, and a debate whose review takes proposals of more than two characters."""
    n = F.length("text")
    turns = [lambda c: F.when(n % 2 == 0, F.replace(c, F.lit(" "), F.lit("_"))), lambda c: F.concat(c, F.lit("!"))]
    sides = [lambda c: F.when(n % 3 == 0, F.concat(F.lit("a: "), c)), lambda c: F.when(n % 2 == 0, F.concat(F.lit("bb: "), c)), lambda c: F.lit("c")]
    return load(spark, d, "benchmark").select("item_id", co.round_robin(turns, F.col("text")).alias("refined"), co.debate(sides, lambda p: F.length(p) > 2, F.col("text")).alias("debated"))


@query("SELECT item_id, string_agg(CASE WHEN length(part) % 5 = 0 THEN part ELSE replace(part, ' ', '_') END, chr(10) ORDER BY pos) AS answer FROM (SELECT item_id, unnest(string_split(text, '. ')) AS part, generate_subscripts(string_split(text, '. '), 1) AS pos FROM benchmark) GROUP BY 1")
def q_supervised(spark: SparkSession, d: str) -> DataFrame:
    """Tasks in parts; a part whose worker fails stays as it is."""
    worker = lambda c: F.when(F.length(c) % 5 != 0, F.replace(c, F.lit(" "), F.lit("_")))
    return co.supervise(load(spark, d, "benchmark"), "item_id", "text", lambda c: F.split(c, r"\. "), worker)


@query("SELECT item_id, 'answer: ' || repeat('+', CAST(least(4, greatest(0, item_id % 7)) AS INTEGER)) || text AS answer FROM benchmark")
def q_tool_loop(spark: SparkSession, d: str) -> DataFrame:
    """A tool for as long as the model wants it, four times at most, then a closing call."""
    marks = lambda c: F.length(c) - F.length("text")
    done = co.tool_loop(load(spark, d, "benchmark"), "text", lambda c: marks(c) < F.col("item_id") % 7, lambda c: F.concat(F.lit("+"), c), lambda c: F.concat(F.lit("answer: "), c))
    return done.select("item_id", "answer")


@query("SELECT user_id, event_type AS model, CAST(sum(event_id % 100 + event_id % 7) AS BIGINT) AS total_tokens, count(*) AS calls FROM events GROUP BY 1, 2")
def q_token_log(spark: SparkSession, d: str) -> DataFrame:
    """Calls appended to a log in two goes and read back."""
    path = windows.scratch(spark, "log")
    e = load(spark, d, "events")
    calls = e.select("user_id", F.col("event_type").alias("model"), (F.col("event_id") % 100).alias("prompt_tokens"), (F.col("event_id") % 7).alias("completion_tokens"), F.lit("chat").alias("action"), F.col("ts").alias("created_at"), "event_id")
    for go in (0, 1):
        sinks.append_log(sinks.token_rows(calls.where(F.col("event_id") % 2 == go)), path)
    return windows.settled(spark.read.parquet(path).groupBy("user_id", "model").agg(F.sum("total_tokens").alias("total_tokens"), F.count("*").alias("calls")), path)


@query(f"WITH c AS ({q.CHUNKS}) SELECT doc_id, chunk_index, CASE WHEN doc_id % 10 = 1 THEN 'new ' || chunk ELSE chunk END AS chunk FROM c WHERE doc_id % 10 <> 2")
def q_chunk_store(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all documents written by paper; then some papers are replaced and some emptied, and the table is read back."""
    path, rows = windows.scratch(spark, "chunks"), chunk_rows(spark, d)
    sinks.write_chunks(rows, path, "doc_id", 16)
    again = rows.where("doc_id % 10 IN (1, 2)").withColumn("chunk", F.when(F.col("doc_id") % 10 == 1, F.concat(F.lit("new "), "chunk")))
    sinks.write_chunks(again, path, "doc_id", 16)
    return windows.settled(spark.read.parquet(path).where("chunk IS NOT NULL").select("doc_id", "chunk_index", "chunk"), path)
