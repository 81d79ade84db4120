"""Queries of the analytics plane: token use, paging, visibility, sessions, upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions import dates, scalars
from granary.functions import text as tx
from granary.operators import relational as rel
from granary.sources.tables import load
from granary.streaming import windows

from .registry import query

START, END = "2024-01-03", "2024-01-25"
_USE = """(SELECT event_id, ts, user_id, event_type AS model, CASE WHEN user_id % 3 = 0 THEN 'chat' WHEN user_id % 3 = 1 THEN 'translate' ELSE 'summarize' END AS action,
  CAST(floor(value) AS BIGINT) AS prompt, CAST(floor(value / 2) AS BIGINT) AS completion FROM events)"""
_RANGE = f"ts >= TIMESTAMP '{START}' AND ts <= TIMESTAMP '{END} 23:59:59'"
_SUMS = "CAST(coalesce(sum(prompt), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(completion), 0) AS BIGINT) AS completion_tokens, CAST(coalesce(sum(prompt + completion), 0) AS BIGINT) AS total_tokens, count(*) AS calls"


def usage(spark: SparkSession, d: str, ranged: bool = True) -> DataFrame:
    """The log of token use: event_id, ts, user_id, model, action, prompt, completion."""
    e = load(spark, d, "events")
    u = F.col("user_id") % 3
    rows = e.select("event_id", "ts", "user_id", F.col("event_type").alias("model"), F.when(u == 0, "chat").when(u == 1, "translate").otherwise("summarize").alias("action"), F.floor("value").cast("long").alias("prompt"), F.floor(F.col("value") / 2).cast("long").alias("completion"))
    return rows.where(dates.within_days(F.col("ts"), START, END)) if ranged else rows


def sums() -> list:
    return [F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in ((F.col("prompt"), "prompt_tokens"), (F.col("completion"), "completion_tokens"), (F.col("prompt") + F.col("completion"), "total_tokens"))] + [F.count("*").alias("calls")]


@query(f"SELECT {_SUMS} FROM {_USE} u WHERE {_RANGE}")
def q_usage_totals(spark: SparkSession, d: str) -> DataFrame:
    return usage(spark, d).agg(*sums())


@query("SELECT CAST(coalesce(sum(prompt), 0) AS BIGINT) AS prompt_tokens, count(*) AS calls FROM " + _USE + " u WHERE ts >= TIMESTAMP '2030-01-01'")
def q_usage_empty(spark: SparkSession, d: str) -> DataFrame:
    """No rows in range: zeros, not nulls."""
    return usage(spark, d, False).where(dates.within_days(F.col("ts"), "2030-01-01", None)).agg(F.coalesce(F.sum("prompt"), F.lit(0)).alias("prompt_tokens"), F.count("*").alias("calls"))


@query(f"SELECT model, {_SUMS} FROM {_USE} u WHERE {_RANGE} GROUP BY 1")
def q_usage_by_model(spark: SparkSession, d: str) -> DataFrame:
    return usage(spark, d).groupBy("model").agg(*sums())


@query(f"SELECT action, {_SUMS} FROM {_USE} u WHERE {_RANGE} GROUP BY 1")
def q_usage_by_action(spark: SparkSession, d: str) -> DataFrame:
    return usage(spark, d).groupBy("action").agg(*sums())


_PERIOD = {
    "day": "strftime(ts, '%Y-%m-%d')",
    "week": "strftime(date_trunc('day', ts) - to_days(CAST(dayofweek(ts) AS INTEGER)), '%Y%U')",
    "month": "strftime(ts, '%Y-%m')",
}


def _trend(period: str):
    @query(f"SELECT {_PERIOD[period]} AS period, {_SUMS} FROM {_USE} u WHERE {_RANGE} GROUP BY 1 ORDER BY 1", name=f"q_usage_{ {'day': 'daily', 'week': 'weekly', 'month': 'monthly'}[period] }")
    def trend(spark: SparkSession, d: str) -> DataFrame:
        return usage(spark, d).groupBy(dates.PERIODS[period](F.col("ts")).alias("period")).agg(*sums()).orderBy("period")

    return trend


for _p in _PERIOD:
    _trend(_p)


@query(f"""
WITH u AS (SELECT *, strftime(ts, '%Y-%m-%d') AS period FROM {_USE} x WHERE {_RANGE})
SELECT CAST(grouping(model) * 4 + grouping(action) * 2 + grouping(period) AS BIGINT) AS grouping, model, action, period, {_SUMS}
FROM u GROUP BY GROUPING SETS ((), (model), (action), (period))
""")
def q_usage_dashboard(spark: SparkSession, d: str) -> DataFrame:
    """Totals, by model, by action and by day in one pass over the log."""
    rows = usage(spark, d).withColumn("period", dates.day(F.col("ts")))
    keys = [F.col(c) for c in ("model", "action", "period")]
    return rows.groupingSets([[], [keys[0]], [keys[1]], [keys[2]]], *keys).agg(F.grouping_id().alias("grouping"), *sums()).select("grouping", "model", "action", "period", "prompt_tokens", "completion_tokens", "total_tokens", "calls")


@query(f"""
SELECT u.user_id, coalesce(c_name, 'unknown') AS username, coalesce(lower(c_mktsegment) || '@example.org', '') AS email, {_SUMS}
FROM {_USE} u LEFT JOIN customer ON user_id = c_custkey AND c_custkey % 4 <> 0 WHERE {_RANGE} GROUP BY 1, 2, 3
""")
def q_user_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Sums come before the join: what meets the users is one row for each of them, not the log."""
    per_user = usage(spark, d).groupBy("user_id").agg(*sums())
    users = load(spark, d, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("user_id"), "c_name", F.concat(F.lower("c_mktsegment"), F.lit("@example.org")).alias("mail"))
    got = per_user.join(users, "user_id", "left")
    return got.select("user_id", F.coalesce("c_name", F.lit("unknown")).alias("username"), F.coalesce("mail", F.lit("")).alias("email"), "prompt_tokens", "completion_tokens", "total_tokens", "calls").orderBy(F.desc("total_tokens"), "user_id")


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS period, {_SUMS} FROM {_USE} u WHERE user_id = 8 AND {_RANGE} GROUP BY 1 ORDER BY 1")
def q_user_detail(spark: SparkSession, d: str) -> DataFrame:
    return usage(spark, d).where("user_id = 8").groupBy(dates.day(F.col("ts")).alias("period")).agg(*sums()).orderBy("period")


@query(f"SELECT model, round(100.0 * sum(prompt + completion) / sum(sum(prompt + completion)) OVER (), 4) AS share FROM {_USE} u GROUP BY 1")
def q_model_share(spark: SparkSession, d: str) -> DataFrame:
    per = usage(spark, d, False).groupBy("model").agg(F.sum(F.col("prompt") + F.col("completion")).alias("n"))
    return per.select("model", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("share"))


@query(f"""
WITH u AS (SELECT * FROM {_USE} x), p AS (SELECT 'project' AS kind, action AS name, sum(prompt + completion) AS n, min(event_id) AS first FROM u GROUP BY 2
  UNION ALL SELECT 'model', model, sum(prompt + completion), min(event_id) FROM u GROUP BY 2)
SELECT kind, string_agg('- ' || name || ': ' || CAST(n AS BIGINT), chr(10) ORDER BY first) AS report FROM p GROUP BY kind
""")
def q_usage_report(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the Markdown report, in the order in which names were first seen."""
    u = usage(spark, d, False)
    per = [u.groupBy(F.col(c).alias("name")).agg(F.sum(F.col("prompt") + F.col("completion")).alias("n"), F.min("event_id").alias("first")).withColumn("kind", F.lit(k)) for k, c in (("project", "action"), ("model", "model"))]
    line = F.concat(F.lit("- "), "name", F.lit(": "), F.col("n").cast("string"))
    return per[0].unionByName(per[1]).groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("first", line.alias("l")))).alias("ls")).select("kind", F.array_join(F.transform("ls", lambda x: x["l"]), "\n").alias("report"))


def token_report(log: DataFrame) -> DataFrame:
    """(part, ord, line): the whole report on token use, in order: totals, sums by project and by model in the order in which they
    were first seen, then the log (seq, at, project, model, prompt, completion), newest first. Lines are rows, so the log may be large."""
    total = F.col("prompt") + F.col("completion")
    text = lambda part, *lines: log.sparkSession.createDataFrame([(part, i, x) for i, x in enumerate(lines)], "part int, ord long, line string")
    # The report's heads.
    heads = [text(0, "# 🤖 全局大模型 Token 消耗记录", "", "## 📊 汇总数据"), text(2, "", "### 📁 按项目统计"), text(4, "", "### 🧠 按模型统计"), text(6, "", "## 📝 详细日志", "| 时间 | 项目名称 | 模型名称 | 输入 Tokens | 输出 Tokens | 总 Tokens |", "|---|---|---|---|---|---|")]
    whole = log.agg(F.coalesce(F.sum(total), F.lit(0)).alias("n")).select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("ord"), F.concat(F.lit("- 全局总消耗: `"), "n", F.lit("` Tokens")).alias("line"))
    per = lambda part, c: log.groupBy(F.col(c).alias("name")).agg(F.sum(total).alias("n"), F.min("seq").alias("ord")).select(F.lit(part).alias("part"), "ord", F.concat(F.lit("- "), "name", F.lit(": `"), "n", F.lit("` Tokens")).alias("line"))
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", "at", "project", "model", "prompt", "completion", total), F.lit(" |"))
    rows = log.select(F.lit(7).alias("part"), (-F.col("seq")).alias("ord"), cells.alias("line"))
    return reduce(DataFrame.unionByName, [*heads, whole, per(3, "project"), per(5, "model"), rows])


@query(f"""
WITH u AS (SELECT event_id AS seq, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t, action AS project, model, prompt, completion FROM {_USE} x)
SELECT part, ord, line FROM (VALUES (0, 0, '# 🤖 全局大模型 Token 消耗记录'), (0, 1, ''), (0, 2, '## 📊 汇总数据'), (2, 0, ''), (2, 1, '### 📁 按项目统计'), (4, 0, ''), (4, 1, '### 🧠 按模型统计'), (6, 0, ''), (6, 1, '## 📝 详细日志'),
  (6, 2, '| 时间 | 项目名称 | 模型名称 | 输入 Tokens | 输出 Tokens | 总 Tokens |'), (6, 3, '|---|---|---|---|---|---|')) h(part, ord, line)
UNION ALL SELECT 1, 0, '- 全局总消耗: `' || CAST(coalesce(sum(prompt + completion), 0) AS BIGINT) || '` Tokens' FROM u
UNION ALL SELECT 3, min(seq), '- ' || project || ': `' || CAST(sum(prompt + completion) AS BIGINT) || '` Tokens' FROM u GROUP BY project
UNION ALL SELECT 5, min(seq), '- ' || model || ': `' || CAST(sum(prompt + completion) AS BIGINT) || '` Tokens' FROM u GROUP BY model
UNION ALL SELECT 7, -seq, '| ' || t || ' | ' || project || ' | ' || model || ' | ' || prompt || ' | ' || completion || ' | ' || (prompt + completion) || ' |' FROM u
""")
def q_token_report(spark: SparkSession, d: str) -> DataFrame:
    """The report on token use with its log."""
    return token_report(usage(spark, d, False).select(F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.col("action").alias("project"), "model", "prompt", "completion"))


ACTIVE = ("queued", "parsing", "translating", "summarizing", "critiquing")
_PAPERS = "(SELECT o_orderkey AS paper_id, o_custkey AS user_id, o_orderdate AS created_at, o_orderstatus AS status, o_totalprice AS price FROM orders)"
_TASKS = "(SELECT l_orderkey AS paper_id, l_orderkey * 10 + l_linenumber AS task_id, CASE l_linestatus WHEN 'O' THEN 'queued' ELSE 'done' END AS status FROM lineitem)"


def papers(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))


def tasks(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("l_linestatus") == "O", "queued").otherwise("done")
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("task_id"), status.alias("status"))


@query(f"""
WITH n AS (SELECT count(*) AS total FROM {_PAPERS} p), p AS (SELECT * FROM {_PAPERS} p ORDER BY created_at DESC, paper_id DESC LIMIT 12 OFFSET 24),
t AS (SELECT paper_id, max(task_id) AS task_id FROM {_TASKS} t WHERE status IN ('queued', 'parsing', 'translating', 'summarizing', 'critiquing') GROUP BY 1)
SELECT p.paper_id, p.created_at, p.status, coalesce(t.task_id, -1) AS task_id, n.total, CAST(ceil(n.total / 12.0) AS BIGINT) AS total_pages FROM p LEFT JOIN t USING (paper_id), n
""")
def q_paper_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of papers with their latest active task; the page is cut before it meets the tasks."""
    p = papers(spark, d)
    total = p.agg(F.count("*").alias("total"))
    rows = rel.page(p, [F.desc("created_at"), F.desc("paper_id")], 3, 12)
    # A page has 100 rows at most, so it is broadcast and the tasks are scanned but not shuffled whole.
    active = tasks(spark, d).where(F.col("status").isin(*ACTIVE)).join(F.broadcast(rows.select("paper_id")), "paper_id", "left_semi").groupBy("paper_id").agg(F.max("task_id").alias("task_id"))
    return rows.join(active, "paper_id", "left").crossJoin(F.broadcast(total)).select("paper_id", "created_at", "status", F.coalesce("task_id", F.lit(-1)).alias("task_id"), "total", F.ceil(F.col("total") / 12).alias("total_pages"))


@query(f"SELECT paper_id, user_id, status FROM {_PAPERS} p WHERE user_id = 370 OR price > 490000")
def q_visible_papers(spark: SparkSession, d: str) -> DataFrame:
    """A user's own rows; papers above a price stand for the public ones."""
    return papers(spark, d).where((F.col("user_id") == 370) | (F.col("price") > 490000)).select("paper_id", "user_id", "status")


@query("SELECT s_suppkey AS id, s_name AS name, CAST(CASE WHEN s_suppkey % 5 <> 0 THEN s_nationkey ELSE -1 END AS INTEGER) AS owner FROM supplier WHERE s_suppkey % 5 = 0 OR s_nationkey = 7 ORDER BY 3, 1")
def q_visible_templates(spark: SparkSession, d: str) -> DataFrame:
    owner = F.when(F.col("s_suppkey") % 5 != 0, F.col("s_nationkey"))
    rows = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), owner.alias("owner"))
    rows = rows.where(F.col("owner").isNull() | (F.col("owner") == 7))
    return rows.withColumn("owner", F.coalesce("owner", F.lit(-1))).orderBy("owner", "id")


@query(f"SELECT paper_id, CASE WHEN user_id = 370 THEN 'allowed' ELSE 'forbidden' END AS decision FROM {_PAPERS} p UNION ALL SELECT 999999999, 'missing'")
def q_ownership(spark: SparkSession, d: str) -> DataFrame:
    """Allowed, forbidden or missing, for asked ids."""
    asked = papers(spark, d).select("paper_id").union(spark.range(999999999, 1000000000).toDF("paper_id"))
    p = papers(spark, d).select("paper_id", "user_id")
    return asked.join(p, "paper_id", "left").select("paper_id", F.when(F.col("user_id").isNull(), "missing").when(F.col("user_id") == 370, "allowed").otherwise("forbidden").alias("decision"))


@query("SELECT o_orderkey AS id, o_custkey AS user_id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' AND o_orderdate + INTERVAL 10 MINUTE > TIMESTAMP '1998-01-01'")
def q_valid_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes of one action, unused and not yet expired at a given time."""
    rows = load(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F'")
    return rows.where(dates.expires(F.col("o_orderdate"), 10) > F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"))


_TAGGED = "(SELECT doc_id, coalesce(text, '') AS title, [source, lang] AS tags FROM documents)"


@query(f"SELECT doc_id, substr(title, 1, 60) AS title FROM {_TAGGED} t WHERE contains(lower(title), 'the') AND list_contains(tags, 'en')")
def q_title_tag_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("title"), F.array("source", "lang").alias("tags"))
    return rows.where(F.contains(F.lower("title"), F.lit("the")) & F.array_contains("tags", "en")).select("doc_id", F.substring("title", 1, 60).alias("title"))


@query("SELECT DISTINCT unnest([source, CASE lang WHEN 'en' THEN 'General' ELSE lang END]) AS tag FROM documents")
def q_tag_list(spark: SparkSession, d: str) -> DataFrame:
    tags = F.array("source", F.when(F.col("lang") == "en", "General").otherwise(F.col("lang")))
    return load(spark, d, "documents").select(F.explode(tags).alias("tag")).distinct().orderBy((F.col("tag") == "General").cast("int"), "tag")


@query("""
SELECT conv_id, count(*) AS messages, max(turn) AS last_turn, substr(max_by(text, turn) FILTER (role = 'assistant'), 1, 80) AS last_answer,
  substr(min_by(text, turn) FILTER (role = 'user'), 1, 100) AS first_question FROM conversations GROUP BY 1
""")
def q_session_summary(spark: SparkSession, d: str) -> DataFrame:
    """Count, last answer and first question of each session in one aggregate instead of a look-up for each."""
    c = load(spark, d, "conversations")
    own = lambda role: F.when(F.col("role") == role, F.col("turn"))
    return c.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"), F.substring(F.max_by("text", own("assistant")), 1, 80).alias("last_answer"), F.substring(F.min_by("text", own("user")), 1, 100).alias("first_question"))


_HISTORY = "(SELECT conv_id % 20 AS session_id, conv_id * 1000 + turn AS pos, role, coalesce(text, '') AS text FROM conversations)"


@query(f"""
WITH h AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n, row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) AS back FROM {_HISTORY} x)
SELECT session_id, CAST(0 AS BIGINT) AS pos, 'system' AS role, '以下是早期对话的摘要（已压缩）：' || coalesce(string_agg(chr(10) || '- 用户问：' || substr(text, 1, 100), '' ORDER BY pos) FILTER (role = 'user'), '') AS content
FROM h WHERE n > 20 AND back > 10 GROUP BY 1
UNION ALL SELECT session_id, pos + 1, role, text FROM h WHERE n <= 20 OR back <= 10
""")
def q_history_compress(spark: SparkSession, d: str) -> DataFrame:
    """Short histories whole; of long ones the last ten messages behind a digest of the user's older questions."""
    c = load(spark, d, "conversations").select((F.col("conv_id") % 20).alias("session_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), "role", F.coalesce("text", F.lit("")).alias("content"))
    w = Window.partitionBy("session_id")
    h = c.withColumn("n", F.count("*").over(w)).withColumn("back", F.row_number().over(w.orderBy(F.desc("pos"))))
    recent = h.where("n <= 20 OR back <= 10").select("session_id", (F.col("pos") + 1).alias("pos"), "role", "content")
    line = F.when(F.col("role") == "user", F.struct("pos", F.concat(F.lit("- 用户问："), F.substring("content", 1, 100)).alias("l")))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"])
    old = h.where("n > 20 AND back > 10").groupBy("session_id").agg(F.array_join(F.concat(F.array(F.lit("以下是早期对话的摘要（已压缩）：")), lines), "\n").alias("content"))
    return old.select("session_id", F.lit(0).cast("long").alias("pos"), F.lit("system").alias("role"), "content").unionByName(recent)


@query("SELECT conv_id, coalesce(max_by(text, turn) FILTER (role = 'assistant' AND turn % 4 <> 3), max_by(text, turn)) AS answer FROM conversations GROUP BY 1")
def q_last_answer(spark: SparkSession, d: str) -> DataFrame:
    """The last answer without a tool call (turns 3, 7, ... stand for calls), else the last message."""
    final = F.when((F.col("role") == "assistant") & (F.col("turn") % 4 != 3), F.col("turn"))
    return load(spark, d, "conversations").groupBy("conv_id").agg(F.coalesce(F.max_by("text", final), F.max_by("text", "turn")).alias("answer"))


@query("SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS round FROM conversations")
def q_rounds(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return load(spark, d, "conversations").select("conv_id", "turn", F.sum((F.col("role") == "assistant").cast("long")).over(w).alias("round"))


@query("SELECT c_custkey AS id, CASE WHEN length(k) > 8 THEN substr(k, 1, 4) || '****' || right(k, 4) WHEN k IS NOT NULL THEN '****' END AS masked FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN c_mktsegment ELSE c_name END AS k FROM customer)")
def q_mask_keys(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_custkey") % 7
    key = F.when(n == 0, F.lit(None)).when(n == 1, F.col("c_mktsegment")).otherwise(F.col("c_name"))
    return load(spark, d, "customer").select(F.col("c_custkey").alias("id"), tx.mask(key).alias("masked"))


# Requests that are logged, in order; the first that fits decides.
AUDIT_RULES = (
    ("POST", "/api/auth/register", "register", "user"),
    ("POST", "/api/auth/login", "login", "user"),
    ("POST", "/api/upload", "upload", "paper"),
    ("DELETE", "/api/papers", "delete_paper", "paper"),
    ("PUT", "/api/settings/api-keys", "config_change", "config"),
    ("PUT", "/api/admin/settings", "config_change", "config"),
    ("PUT", "/api/auth/users", "role_change", "user"),
)
_RULES = ", ".join(f"({i}, '{m}', '{p}', '{a}', '{k}')" for i, (m, p, a, k) in enumerate(AUDIT_RULES))
_REQUEST = "(SELECT page_id, ['POST', 'DELETE', 'PUT'][CAST(page_id % 3 AS BIGINT) + 1] AS method, ['/api/auth/login', '/api/papers', '/api/auth/users', '/api/upload', '/x'][CAST(page_id % 5 AS BIGINT) + 1] || regexp_extract(url, 'https?://[^/]+([^?]*)', 1) AS path FROM pages)"


def audit(requests: DataFrame) -> DataFrame:
    """(page_id, method, path) with action, resource type, resource id and detail; requests without a rule are not logged.

    The rules are a list of fixed size within the expression, so a row is decided where it is, in a table or a stream.
    """
    rules = F.array(*(F.struct(*(F.lit(x).alias(k) for k, x in zip(("m", "prefix", "action", "resource_type"), r, strict=True))) for r in AUDIT_RULES))
    first = F.get(F.filter(rules, lambda r: (F.col("method") == r["m"]) & F.startswith(F.col("path"), r["prefix"])), 0)
    hit = requests.withColumn("rule", first).where("rule IS NOT NULL")
    detail = F.to_json(F.struct("method", "path", "status_code")) if "status_code" in requests.columns else F.to_json(F.struct("method", "path"))
    return hit.select("page_id", "method", "path", "rule.action", "rule.resource_type", F.element_at(F.split(F.regexp_replace("path", "/+$", ""), "/"), -1).alias("resource_id"), detail.alias("detail"))


def requests(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (F.col("page_id") % n).cast("int") + 1)
    path = F.concat(pick(("/api/auth/login", "/api/papers", "/api/auth/users", "/api/upload", "/x"), 5), F.regexp_extract("url", "https?://[^/]+([^?]*)", 1))
    return load(spark, d, "pages").select("page_id", pick(("POST", "DELETE", "PUT"), 3).alias("method"), path.alias("path"))


@query(f"""
WITH r(ord, m, prefix, action, resource_type) AS (VALUES {_RULES}), h AS (SELECT q.*, r.*, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS n FROM {_REQUEST} q JOIN r ON q.method = r.m AND starts_with(q.path, r.prefix))
SELECT page_id, method, path, action, resource_type, string_split(regexp_replace(path, '/+$', ''), '/')[-1] AS resource_id FROM h WHERE n = 1
""")
def q_audit_match(spark: SparkSession, d: str) -> DataFrame:
    return audit(requests(spark, d)).drop("detail")


@query(f"""
WITH r(ord, m, prefix, action, resource_type) AS (VALUES {_RULES}), h AS (SELECT q.*, r.*, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS n FROM {_REQUEST} q JOIN r ON q.method = r.m AND starts_with(q.path, r.prefix))
SELECT page_id, action, resource_type, string_split(regexp_replace(path, '/+$', ''), '/')[-1] AS resource_id, '{{"method":"' || method || '","path":"' || path || '","status_code":' || (200 + page_id % 3) || '}}' AS detail FROM h WHERE n = 1
""")
def q_audit_stream(spark: SparkSession, d: str) -> DataFrame:
    """The audit log that a stream of requests has appended, with the detail of each."""
    rows = requests(spark, d).withColumn("status_code", F.col("page_id") % 3 + 200)
    got = windows.in_goes(spark, [rows.where("page_id % 2 = 0"), rows.where("page_id % 2 = 1")], audit)
    return got.select("page_id", "action", "resource_type", "resource_id", "detail")


#: Subscribers and the patterns of events that they ask for.
SUBSCRIBERS = (("log", "*.*"), ("alerts", "web.error"), ("sales", "*.purchase"), ("funnel", "web.*"), ("clicks", "mobile.cl*"))


@query(f"""
WITH s(subscriber, pattern) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in SUBSCRIBERS)}), e AS (SELECT CASE user_id % 2 WHEN 0 THEN 'web' ELSE 'mobile' END || '.' || event_type AS name FROM events)
SELECT subscriber, name, count(*) AS deliveries FROM e JOIN s ON name GLOB pattern GROUP BY 1, 2
""")
def q_event_glob(spark: SparkSession, d: str) -> DataFrame:
    """Events are counted by name first, so the patterns meet names and not events."""
    name = F.concat(F.when(F.col("user_id") % 2 == 0, "web").otherwise("mobile"), F.lit("."), "event_type")
    per = load(spark, d, "events").groupBy(name.alias("name")).agg(F.count("*").alias("deliveries"))
    subs = spark.createDataFrame(SUBSCRIBERS, "subscriber string, pattern string").withColumn("re", F.concat(F.lit("^"), F.replace(F.replace("pattern", F.lit("."), F.lit("\\.")), F.lit("*"), F.lit(".*")), F.lit("$")))
    return per.join(F.broadcast(subs), F.expr("name RLIKE re")).select("subscriber", "name", "deliveries")


@query("""
WITH new AS (SELECT o_orderkey + 7 AS o_orderkey, o_custkey, 'N' AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 100 = 3 UNION ALL SELECT 900000000, 1, 'N', 5.0),
o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders)
SELECT * FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new) UNION ALL SELECT * FROM new
""")
def q_upsert(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 100 = 3").select((F.col("o_orderkey") + 7).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    extra = spark.range(1).select(F.lit(900000000).cast("long").alias("o_orderkey"), F.lit(1).cast("long").alias("o_custkey"), F.lit("N").alias("o_orderstatus"), F.lit(5.0).alias("o_totalprice"))
    return rel.upsert(o, new.unionByName(extra), "o_orderkey")


@query("""
WITH new AS (SELECT l_orderkey, CAST(l_linenumber + 100 AS INTEGER) AS l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 50 = 1)
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 50 <> 1 UNION ALL SELECT * FROM new
""")
def q_replace_by_key(spark: SparkSession, d: str) -> DataFrame:
    """All chunks of a paper go before its new ones come."""
    old = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new = old.where("l_orderkey % 50 = 1").withColumn("l_linenumber", (F.col("l_linenumber") + 100).cast("int"))
    return rel.replace_by_key(old, new, "l_orderkey")


@query("""
WITH gone AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'), o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone))
SELECT 'customer' AS tab, count(*) AS rest FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT 'orders', count(*) FROM o
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone))
""")
def q_cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Users go, and with them their papers and those papers' tasks."""
    c, o, li = (load(spark, d, t) for t in ("customer", "orders", "lineitem"))
    gone = c.where("c_mktsegment = 'BUILDING'").select("c_custkey")
    lost = o.join(gone, o["o_custkey"] == gone["c_custkey"], "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    left = [("customer", rel.delete(c, gone, "c_custkey")), ("orders", rel.delete(o.withColumnRenamed("o_custkey", "c_custkey"), gone, "c_custkey")), ("lineitem", rel.delete(li, lost, "l_orderkey"))]
    counted = [x.agg(F.count("*").alias("rest")).select(F.lit(n).alias("tab"), "rest") for n, x in left]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("""
SELECT coalesce(o.key, n.key) AS key, coalesce(n.value, o.value) AS value, coalesce(nullif(n.description, ''), o.description) AS description
FROM (SELECT n_name AS key, CAST(n_regionkey AS VARCHAR) AS value, 'region of ' || n_name AS description FROM nation) o
FULL JOIN (SELECT CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE n_name || '_NEW' END AS key, 'v' || n_nationkey AS value, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE 'changed' END AS description FROM nation) n ON o.key = n.key
""")
def q_settings_upsert(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "nation")
    old = n.select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"), F.concat(F.lit("region of "), "n_name").alias("description"))
    new = n.select(F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).otherwise(F.concat("n_name", F.lit("_NEW"))).alias("key"), F.concat(F.lit("v"), F.col("n_nationkey").cast("string")).alias("value"), F.when(F.col("n_nationkey") % 2 == 0, "").otherwise("changed").alias("description"))
    return rel.settings_upsert(old, new)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN NULL ELSE upper(c_name) END AS value FROM customer")
def q_null_patch(spark: SparkSession, d: str) -> DataFrame:
    """Null keeps, a blank clears, a value replaces."""
    k = F.col("c_custkey") % 3
    new = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "  ").otherwise(F.upper("c_name"))
    return load(spark, d, "customer").select(F.col("c_custkey").alias("id"), scalars.patched(new, F.col("c_name")).alias("value"))


_MD = "CASE WHEN page_id % 2 = 0 THEN '[home](' || url || ') and [again](' || url || ') or [next](http://next.example.com/' || page_id || ')' ELSE 'no links [x](ftp://y)' END"


@query(f"""
WITH m AS (SELECT page_id, {_MD} AS t FROM pages), l AS (SELECT page_id, unnest(regexp_extract_all(t, '\\[([^\\]]+)\\]\\((https?://[^)\\s]+)\\)', 1)) AS title, unnest(regexp_extract_all(t, '\\[([^\\]]+)\\]\\((https?://[^)\\s]+)\\)', 2)) AS url,
  generate_subscripts(regexp_extract_all(t, '\\[([^\\]]+)\\]\\((https?://[^)\\s]+)\\)', 1), 1) AS pos FROM m)
SELECT page_id, title, url FROM (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS n FROM l) WHERE n = 1
""")
def q_links(spark: SparkSession, d: str) -> DataFrame:
    """Markdown links of each answer, the first of each URL."""
    url, page = F.col("url"), F.col("page_id")
    text = F.when(page % 2 == 0, F.concat(F.lit("[home]("), url, F.lit(") and [again]("), url, F.lit(") or [next](http://next.example.com/"), page, F.lit(")"))).otherwise("no links [x](ftp://y)")
    rows = load(spark, d, "pages").select("page_id", F.posexplode(tx.links(text)).alias("pos", "l")).select("page_id", "pos", "l.title", "l.url")
    return rel.best_per(rows, ["page_id", "url"], [F.col("pos")]).select("page_id", "title", "url")


@query("""
WITH t AS (SELECT source AS name, min(doc_id) AS id, 0 AS prio, 'private' AS kind FROM documents WHERE lang = 'en' AND doc_id % 3 = 0 GROUP BY 1 UNION ALL SELECT source, min(doc_id), 1, 'public' FROM documents WHERE lang = 'de' GROUP BY 1 UNION ALL SELECT DISTINCT source, CAST(-1 AS BIGINT), 2, 'file' FROM documents)
SELECT name, id, kind FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY prio) AS n FROM t) WHERE n = 1
""")
def q_template_resolution(spark: SparkSession, d: str) -> DataFrame:
    """A user's own template before a public one before the file."""
    docs = load(spark, d, "documents").select(F.col("source").alias("name"), "doc_id", "lang")
    own = docs.where("lang = 'en' AND doc_id % 3 = 0").groupBy("name").agg(F.min("doc_id").alias("id")).select("name", "id", F.lit(0).alias("prio"), F.lit("private").alias("kind"))
    public = docs.where("lang = 'de'").groupBy("name").agg(F.min("doc_id").alias("id")).select("name", "id", F.lit(1).alias("prio"), F.lit("public").alias("kind"))
    files = docs.select("name").distinct().select("name", F.lit(-1).cast("long").alias("id"), F.lit(2).alias("prio"), F.lit("file").alias("kind"))
    return rel.best_per(own.unionByName(public).unionByName(files), ["name"], [F.col("prio")]).select("name", "id", "kind")


@query("SELECT s_suppkey AS id, s_name AS name, coalesce(c_name, '') AS owner FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey * 20 ORDER BY s_suppkey % 2 DESC, s_suppkey DESC")
def q_template_owners(spark: SparkSession, d: str) -> DataFrame:
    s, c = load(spark, d, "supplier"), load(spark, d, "customer")
    rows = s.join(c, c["c_custkey"] == s["s_suppkey"] * 20, "left")
    return rows.orderBy(F.desc(F.col("s_suppkey") % 2), F.desc("s_suppkey")).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.coalesce("c_name", F.lit("")).alias("owner"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 5000)")
def q_not_taken(spark: SparkSession, d: str) -> DataFrame:
    """A guard: only what is not there yet."""
    taken = load(spark, d, "customer").where("c_acctbal < 5000").select(F.col("c_custkey").alias("o_custkey"))
    return load(spark, d, "orders").join(taken, "o_custkey", "left_anti").select(F.col("o_orderkey").alias("id"))
