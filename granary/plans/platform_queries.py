"""Queries of the platform plane: settings, sources, sinks, frames, calls and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions import dates, scalars
from granary.functions import text as tx
from granary.operators import relational as rel
from granary.operators import render
from granary.sources import pdf
from granary.sources import tables as src
from granary.sources.files import slices_of
from granary.sources.tables import load, spread
from granary.streaming import windows

from . import sql as q
from .registry import query

_SETTINGS = "(SELECT n_nationkey AS id, lower(n_name) AS key, CASE n_nationkey % 5 WHEN 0 THEN '12' WHEN 1 THEN '0.5' WHEN 2 THEN 'true' WHEN 3 THEN 'x' ELSE n_name END AS value, ['int', 'float', 'bool', 'int', 'string'][n_nationkey % 5 + 1] AS type FROM nation)"


def settings(spark: SparkSession, d: str) -> DataFrame:
    """(id, key, value, type): names of nations as settings of every type, some with values that do not fit."""
    pick = lambda *xs: F.element_at(F.array(*(x if isinstance(x, F.Column) else F.lit(x) for x in xs)), F.col("n_nationkey") % 5 + 1)
    return load(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("key"), pick("12", "0.5", "true", "x", F.col("n_name")).alias("value"), pick("int", "float", "bool", "int", "string").alias("type"))


@query(f"""
SELECT id, key, coalesce(CASE WHEN type = 'int' THEN TRY_CAST(value AS BIGINT) END, -1) AS as_int, coalesce(CASE WHEN type = 'float' THEN TRY_CAST(value AS DOUBLE) END, -1) AS as_float,
  coalesce(CASE WHEN type = 'bool' THEN CASE WHEN TRY_CAST(value AS BOOLEAN) THEN 'yes' ELSE 'no' END END, '') AS as_bool, CASE WHEN type = 'string' THEN value ELSE '' END AS as_text FROM {_SETTINGS} s ORDER BY id
""")
def q_settings_typed(spark: SparkSession, d: str) -> DataFrame:
    """Settings by the type that stands beside them; what does not fit is missing."""
    of = lambda t, c, default: F.coalesce(F.when(F.col("type") == t, c), F.lit(default))
    v = F.col("value")
    yes = F.when(v.try_cast("boolean"), "yes").otherwise("no")
    return settings(spark, d).select("id", "key", of("int", v.try_cast("long"), -1).alias("as_int"), of("float", v.try_cast("double"), -1.0).alias("as_float"), of("bool", yes, "").alias("as_bool"), of("string", v, "").alias("as_text")).orderBy("id")


GROUPS = {"limits": ("algeria", "brazil", "china"), "models": ("france", "germany")}


@query(f"SELECT key, CASE WHEN key IN ('algeria', 'brazil', 'china') THEN 'limits' WHEN key IN ('france', 'germany') THEN 'models' ELSE 'other' END AS section FROM {_SETTINGS} s")
def q_setting_groups(spark: SparkSession, d: str) -> DataFrame:
    section = F.when(F.col("key").isin(*GROUPS["limits"]), "limits").when(F.col("key").isin(*GROUPS["models"]), "models").otherwise("other")
    return settings(spark, d).select("key", section.alias("section"))


@query("SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'system' ELSE 'user' END AS part, s_suppkey AS id FROM supplier")
def q_template_parts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 5 == 0, "system").otherwise("user").alias("part"), F.col("s_suppkey").alias("id"))


@query("SELECT item_id, CASE WHEN length(t) < 1 OR length(t) > 2000 THEN 'question' WHEN k < 1 OR k > 20 THEN 'top_k' ELSE 'ok' END AS verdict, least(20, greatest(1, k)) AS clamped FROM (SELECT item_id, CASE WHEN item_id % 10 = 0 THEN '' ELSE text END AS t, CAST(item_id % 25 - 1 AS INTEGER) AS k FROM benchmark)")
def q_request_check(spark: SparkSession, d: str) -> DataFrame:
    """Requests against their bounds: 1 to 2000 characters, 1 to 20 results."""
    rows = load(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 10 == 0, "").otherwise(F.col("text")).alias("t"), (F.col("item_id") % 25 - 1).cast("int").alias("k"))
    bad = F.when(~F.length("t").between(1, 2000), "question").when(~F.col("k").between(1, 20), "top_k").otherwise("ok")
    return rows.select("item_id", bad.alias("verdict"), scalars.clamp(F.col("k"), 1, 20).alias("clamped"))


_CFG = """CASE event_id % 3 WHEN 0 THEN '{"name":"a' || event_id || '","description":"d"}' WHEN 1 THEN '{"function":{"name":"b' || event_id || '","description":"e"}}' ELSE '{"tools":[{"function":{"name":"c' || event_id || '"}}]}' END"""


@query(f"SELECT event_id, coalesce(json_extract_string(c, '$.name'), json_extract_string(c, '$.function.name'), json_extract_string(c, '$.tools[0].function.name')) AS name, coalesce(json_extract_string(c, '$.description'), json_extract_string(c, '$.function.description'), '') AS description FROM (SELECT event_id, {_CFG} AS c FROM events)")
def q_tool_schema(spark: SparkSession, d: str) -> DataFrame:
    """Three layouts of a tool's schema, read as one."""
    i, n = F.col("event_id").cast("string"), F.col("event_id") % 3
    c = F.when(n == 0, F.concat(F.lit('{"name":"a'), i, F.lit('","description":"d"}'))).when(n == 1, F.concat(F.lit('{"function":{"name":"b'), i, F.lit('","description":"e"}}'))).otherwise(F.concat(F.lit('{"tools":[{"function":{"name":"c'), i, F.lit('"}}]}')))
    rows = load(spark, d, "events").select("event_id", c.alias("c"))
    first = lambda *ps: F.coalesce(*(F.get_json_object("c", p) for p in ps))
    return rows.select("event_id", first("$.name", "$.function.name", "$.tools[0].function.name").alias("name"), F.coalesce(first("$.description", "$.function.description"), F.lit("")).alias("description"))


@query("SELECT o_orderkey AS paper_id, CASE WHEN o_orderkey % 50 = 4 THEN 'completed' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 50 = 4 THEN 'General|NLP' ELSE o_orderpriority END AS tags FROM orders")
def q_status_update(spark: SparkSession, d: str) -> DataFrame:
    """A keyed update: status, and tags with the template's first and no tag twice."""
    hit = F.col("o_orderkey") % 50 == 4
    tags = tx.distinct_in_order(F.concat(F.array(tx.domain_tag(F.lit("tinghua.md"))), F.array(F.lit("NLP"), F.lit("General"), F.lit(""))))
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("paper_id"), F.when(hit, "completed").otherwise(F.col("o_orderstatus")).alias("status"), F.when(hit, F.array_join(tags, "|")).otherwise(F.col("o_orderpriority")).alias("tags"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'summary_' || source || '.md' ELSE 'translation.md' END AS name FROM documents")
def q_result_names(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 2 == 0, "summary").otherwise("translation")
    return load(spark, d, "documents").select("doc_id", render.result_name(kind, F.concat(F.col("source"), F.lit(".md"))).alias("name"))


@query("SELECT item_id, 'https://export.example.org/api?search=' || replace(url_encode(text), '%20', '+') AS url FROM benchmark")
def q_url_encode(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "benchmark").select("item_id", F.concat(F.lit("https://export.example.org/api?search="), F.url_encode("text")).alias("url"))


@query("SELECT conv_id, CAST(coalesce(sum(length(text)) FILTER (role = 'user'), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS output_tokens FROM conversations GROUP BY 1")
def q_message_tokens(spark: SparkSession, d: str) -> DataFrame:
    own = lambda r: F.coalesce(F.sum(F.when(F.col("role") == r, F.length("text"))), F.lit(0)).cast("long")
    return load(spark, d, "conversations").groupBy("conv_id").agg(own("user").alias("input_tokens"), own("assistant").alias("output_tokens"))


@query("SELECT l_orderkey AS paper_id, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS failures, count(*) AS pieces FROM lineitem GROUP BY 1")
def q_failures(spark: SparkSession, d: str) -> DataFrame:
    """Pieces that failed, summed up for each paper."""
    return load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("paper_id")).agg(F.count_if(F.col("l_returnflag") == "R").alias("failures"), F.count("*").alias("pieces"))


@query("SELECT event_id, event_type AS kind, CAST(user_id AS BIGINT) AS user FROM events WHERE event_id % 3 <> 2")
def q_sse_parse(spark: SparkSession, d: str) -> DataFrame:
    """Frames read back: lines that start with data: and hold JSON; comments and half lines fall away."""
    n = F.col("event_id") % 3
    body = F.to_json(F.struct("event_id", F.col("event_type").alias("kind"), F.col("user_id").alias("user")))
    raw = F.when(n == 0, F.concat(F.lit(": ping\ndata: "), body, F.lit("\n\n"))).when(n == 1, F.concat(F.lit("event: x\ndata: "), body, F.lit("\n\n"))).otherwise(F.concat(F.lit("data: "), F.substring(body, 1, 12)))
    lines = load(spark, d, "events").select(F.explode(F.split(raw, "\n")).alias("line")).where(F.startswith("line", F.lit("data: ")))
    read = lines.select(F.from_json(F.expr("substring(line, 7)"), "event_id long, kind string, user long", {"mode": "PERMISSIVE"}).alias("r"))
    return read.where("r.kind IS NOT NULL AND r.user IS NOT NULL").select("r.event_id", "r.kind", "r.user")


@query("SELECT user_id AS round, event_id % 3 AS idx, min_by(event_type, event_id) AS name, string_agg(event_type, '' ORDER BY event_id) AS arguments FROM events GROUP BY 1, 2")
def q_tool_calls_merged(spark: SparkSession, d: str) -> DataFrame:
    """Fragments of tool calls by round and index: the first name, the arguments put together."""
    rows = load(spark, d, "events").groupBy(F.col("user_id").alias("round"), (F.col("event_id") % 3).alias("idx"))
    parts = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
    return rows.agg(F.min_by("event_type", "event_id").alias("name"), F.array_join(F.transform(parts, lambda x: x["event_type"]), "").alias("arguments"))


@query("SELECT 'sessions' AS tab, count(DISTINCT conv_id) AS rest FROM conversations WHERE conv_id % 7 <> 3 UNION ALL SELECT 'messages', count(*) FROM conversations WHERE conv_id % 7 <> 3")
def q_session_delete(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "conversations")
    sessions = c.select("conv_id").distinct()
    gone = sessions.where("conv_id % 7 = 3")
    left = [("sessions", rel.delete(sessions, gone, "conv_id")), ("messages", rel.delete(c, gone, "conv_id"))]
    counted = [x.agg(F.count("*").alias("rest")).select(F.lit(n).alias("tab"), "rest") for n, x in left]
    return counted[0].unionByName(counted[1])


@query("SELECT c_custkey AS user_id, c_custkey * 10 AS paper_id, 'new' AS origin FROM customer WHERE c_custkey NOT IN (SELECT conv_id FROM conversations) UNION ALL SELECT DISTINCT conv_id, conv_id * 10, 'old' FROM conversations")
def q_get_or_create(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that are there, and new ones where there is none."""
    old = load(spark, d, "conversations").select(F.col("conv_id").alias("user_id")).distinct().withColumn("origin", F.lit("old"))
    new = load(spark, d, "customer").select(F.col("c_custkey").alias("user_id")).withColumn("origin", F.lit("new"))
    return rel.fallback(old, new, ["user_id"]).select("user_id", (F.col("user_id") * 10).alias("paper_id"), "origin")


@query("SELECT 'generator + reviewer' || ' (' || count(DISTINCT event_type) || ' tools)' AS label, count(DISTINCT user_id) AS users FROM events")
def q_system_label(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").agg(F.countDistinct("event_type").alias("n"), F.countDistinct("user_id").alias("users")).select(F.concat(F.lit("generator + reviewer ("), F.col("n").cast("string"), F.lit(" tools)")).alias("label"), "users")


@query("SELECT '2024' AS at, source AS project, lang AS model, doc_id AS prompt, doc_id + 1 AS completion, 2 * doc_id + 1 AS total FROM documents WHERE doc_id % 5 <> 0")
def q_token_table(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the Markdown log read back; every fifth line has a bad number."""
    i = F.col("doc_id").cast("string")
    cells = [F.lit("| 2024 |"), F.lit(" "), "source", F.lit(" | "), "lang", F.lit(" | "), F.when(F.col("doc_id") % 5 == 0, "n/a").otherwise(i), F.lit(" | "), (F.col("doc_id") + 1).cast("string"), F.lit(" | "), (F.col("doc_id") * 2 + 1).cast("string"), F.lit(" |")]
    lines = load(spark, d, "documents").select(F.concat(*cells).alias("value"))
    return src.token_table(lines.unionByName(spark.createDataFrame([("| time | project | model | p | c | t |",), ("|---|---|---|---|---|---|",), ("# log",)], "value string")))


#: Characters of a page, where documents are made to files.
PAGE = 1500


@query(f"""
WITH p AS (SELECT doc_id, i, {q.strip(f"substr(coalesce(text, ''), CAST(i * {PAGE} + 1 AS BIGINT), {PAGE})")} AS t FROM documents, unnest(range(CAST(ceil(length(coalesce(text, '')) / {PAGE}.0) AS BIGINT))) u(i))
SELECT doc_id AS paper_id, CASE WHEN doc_id % 10 = 3 THEN '{src.NO_TEXT}' ELSE coalesce(string_agg('[Page ' || (i + 1) || ']' || chr(10) || t, chr(10) || chr(10) ORDER BY i) FILTER (t <> ''), '{src.NO_TEXT}') END AS text
FROM documents LEFT JOIN p USING (doc_id) GROUP BY doc_id
""")
def q_pdf_text(spark: SparkSession, d: str) -> DataFrame:
    """All documents as PDF files of pages, read back page by page; every tenth file is no PDF at all."""
    pdf.register(spark)
    path = windows.scratch(spark, "pdf")
    text = F.coalesce("text", F.lit(""))
    broken = F.col("doc_id") % 10 == 3
    files = load(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("name"), F.when(~broken, tx.blocks(text, PAGE)).alias("pages"), F.when(broken, F.encode(text, "UTF-8")).alias("raw")
    )
    spread(files, "name").write.format("pdf").mode("append").option("path", path).option("sharded", True).save()
    got = pdf.texts(spark.read.format("pdf").option("slices", slices_of(spark)).load(path))
    return windows.settled(got.select(F.regexp_extract("path", r"(-?\d+)\.pdf$", 1).cast("long").alias("paper_id"), "text"), path, ("",))


@query(f"SELECT doc_id AS paper_id, coalesce(nullif(array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda p, i: CASE WHEN {q.strip('p')} <> '' THEN '[Page ' || i || ']' || chr(10) || {q.strip('p')} END), lambda x: x IS NOT NULL), chr(10) || chr(10)), ''), '{src.NO_TEXT}') AS text FROM documents")
def q_pdf_pages(spark: SparkSession, d: str) -> DataFrame:
    """Lines stand for pages."""
    pages = load(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), F.split(F.coalesce("text", F.lit("")), "\n").alias("pages"))
    return src.pdf_pages(pages)


@query("SELECT page_id, CASE WHEN length(trim(t)) > 2 AND NOT contains(lower(t), 'untitled') THEN trim(t) ELSE 'file_' || page_id END AS title FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'Untitled ' || html WHEN page_id % 4 = 1 THEN ' ' ELSE ' ' || regexp_extract(html, '<title>([^<]*)', 1) END AS t FROM pages)")
def q_pdf_title(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id") % 4
    t = F.when(n == 0, F.concat(F.lit("Untitled "), "html")).when(n == 1, " ").otherwise(F.concat(F.lit(" "), F.regexp_extract("html", "<title>([^<]*)", 1)))
    return load(spark, d, "pages").select("page_id", src.pdf_title(t, F.concat(F.lit("/up/file_"), F.col("page_id").cast("string"), F.lit(".pdf"))).alias("title"))


#: What XML may not hold, and letters beyond ASCII.
_NOT_PLAIN = r"[^\x20-\x7e\n\t]"


@query(f"""
WITH f AS (SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN {q.collapse("regexp_extract(html, '<title>([^<]*)', 1)")} ELSE '' END AS title, url, {q.collapse(f"regexp_replace(html, {q.quoted(_NOT_PLAIN)}, ' ', 'g')")} AS summary FROM pages)
SELECT page_id, title, url, substr(summary, 1, 320) AS summary FROM f WHERE title <> ''
""")
def q_feed_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of Atom feeds made of pages, whole HTML as the summary; those without a title go. The number of a page goes with its feed."""
    text = lambda c: tx.html_escape(c)
    title = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("<title> "), text(F.regexp_extract("html", "<title>([^<]*)", 1)), F.lit("\n</title>")))
    plain = F.regexp_replace("html", _NOT_PLAIN, " ")
    xml = F.concat(F.lit("<feed><entry>"), title, F.lit("<published>2024</published><id> "), text(F.col("url")), F.lit("</id><summary>"), text(plain), F.lit("</summary></entry><entry><id>none</id></entry></feed>"))
    return src.atom_entries(load(spark, d, "pages").select("page_id", xml.alias("xml")), keys=["page_id"]).select("page_id", "title", "url", F.coalesce("summary", F.lit("")).alias("summary"))


@query("SELECT conv_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(list(v)), lambda x: {'k': list_position(list(v ORDER BY turn), x), 'v': x})), lambda s: s.v), '|') AS seen FROM (SELECT conv_id, turn, role AS v FROM conversations) GROUP BY 1")
def q_unique_in_order(spark: SparkSession, d: str) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return load(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(tx.distinct_in_order(parts), "|").alias("seen"))


@query("SELECT event_id, strftime(ts + INTERVAL 10 MINUTE, '%Y-%m-%d %H:%M:%S') AS code_until, strftime(ts + INTERVAL 1440 MINUTE, '%Y-%m-%d %H:%M:%S') AS token_until FROM events")
def q_expiry(spark: SparkSession, d: str) -> DataFrame:
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return load(spark, d, "events").select("event_id", show(dates.expires(F.col("ts"), 10)).alias("code_until"), show(dates.expires(F.col("ts"), 1440)).alias("token_until"))


@query("SELECT c_custkey AS id, c_name AS opened, length(c_name) < 44 AS longer FROM customer")
def q_encrypt_round(spark: SparkSession, d: str) -> DataFrame:
    """Keys as they are stored, opened again."""
    sealed = scalars.encrypted(F.col("c_name"), "secret")
    return load(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name", sealed.alias("s")).select("id", scalars.decrypted(F.col("s"), "secret").alias("opened"), (F.length("s") >= 44).alias("longer"))


@query("SELECT event_id, coalesce(array_to_string(CASE WHEN event_id % 3 = 0 THEN [event_type, 'b'] END, '|'), 'none') AS items FROM events")
def q_json_list(spark: SparkSession, d: str) -> DataFrame:
    """A JSON column is a list or nothing."""
    n = F.col("event_id") % 3
    j = F.when(n == 0, F.concat(F.lit('["'), "event_type", F.lit('","b"]'))).when(n == 1, F.col("props"))
    return load(spark, d, "events").select("event_id", F.coalesce(F.array_join(scalars.json_list(j), "|"), F.lit("none")).alias("items"))


@query("SELECT label, round(sum(q), 4) AS score, CAST(rank() OVER (ORDER BY round(sum(q), 4) DESC, label) AS INTEGER) AS place FROM (SELECT label, vec_id % 10 AS q FROM embeddings) GROUP BY label")
def q_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """Totals by label with their place; the labels, not the rows, meet in one window."""
    per = load(spark, d, "embeddings").groupBy("label").agg(F.round(F.sum((F.col("vec_id") % 10).cast("double")), 4).alias("score"))
    return per.select("label", "score", F.rank().over(Window.orderBy(F.desc("score"), "label")).alias("place"))
