"""Queries of the scoring plane, and of expensive functions called once for each distinct text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import encode as enc
from granary.functions import scalars
from granary.functions import text as tx
from granary.operators import relational as rel
from granary.sources.tables import load

from . import sql as q
from .registry import query


@query("""
WITH c AS (SELECT p_partkey, p_brand, CAST(p_size AS DOUBLE) AS gain, p_partkey % 7 + 0.5 AS cost, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey % 4 + 0.25 END AS stealth FROM part),
r AS (SELECT doc_id AS p_partkey, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY 1),
s AS (SELECT c.p_partkey, p_brand, round(1.0 * coalesce(q * 10.0, gain, 5) - 1.0 * coalesce(t * 3.0, cost, 5) + 1.0 * coalesce(stealth, 5), 3) AS score FROM c LEFT JOIN r USING (p_partkey)),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS INTEGER) AS rank FROM s)
SELECT p_brand, 'B' || rank AS branch, p_partkey, score, rank = 1 AS winner FROM n WHERE rank <= 3
""")
def q_candidate_rank(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each brand with their reviews, weighted, ranked, cut to three; the first one wins."""
    k = F.col("p_partkey")
    c = load(spark, d, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("gain"), (k % 7 + F.lit(0.5)).alias("cost"), F.when(k % 5 != 0, k % 4 + F.lit(0.25)).alias("stealth"))
    r = load(spark, d, "labels").groupBy(F.col("doc_id").alias("p_partkey")).agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    five = F.lit(5.0)
    s = c.join(r, "p_partkey", "left").withColumn("score", scalars.score(F.coalesce(F.col("q") * F.lit(10.0), "gain", five), F.coalesce(F.col("t") * F.lit(3.0), "cost", five), F.coalesce("stealth", five)))
    n = rel.best_per(s, ["p_brand"], [F.desc("score"), F.col("p_partkey")], 3, "rank")
    return n.select("p_brand", F.concat(F.lit("B"), "rank").alias("branch"), "p_partkey", "score", (F.col("rank") == 1).alias("winner"))


@query("""
WITH r AS (SELECT event_id, user_id % 10 AS idx, event_type AS comment, value FROM events WHERE event_type IN ('error', 'view') AND user_id % 10 < 8),
l AS (SELECT idx, max_by(comment, event_id) AS comment, max_by(value, event_id) AS value FROM r GROUP BY 1)
SELECT i AS idx, round(coalesce(l.value, 5.0), 3) AS gain, coalesce(l.comment, '') AS comment FROM range(10) t(i) LEFT JOIN l ON l.idx = i
""")
def q_review_join(spark: SparkSession, d: str) -> DataFrame:
    """Each candidate with its last review, defaults where there is none; reviews of unknown candidates fall away."""
    e = load(spark, d, "events").where("event_type IN ('error', 'view') AND user_id % 10 < 8")
    last = e.groupBy((F.col("user_id") % 10).alias("idx")).agg(F.max_by("event_type", "event_id").alias("comment"), F.max_by("value", "event_id").alias("value"))
    return spark.range(10).toDF("idx").join(last, "idx", "left").select("idx", F.round(F.coalesce("value", F.lit(5.0)), 3).alias("gain"), F.coalesce("comment", F.lit("")).alias("comment"))


@query("""
WITH j AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'sure: ```json ' || props || ' ```' WHEN event_id % 4 = 1 THEN 'no json' ELSE props END AS t FROM events),
o AS (SELECT event_id, nullif(regexp_extract(t, '(?s)(\\{.*\\})', 1), '') AS body FROM j)
SELECT event_id, body, coalesce(TRY_CAST(json_extract_string(body, '$.k') AS DOUBLE), 5.0) AS asr_gain, '候选方案 ' || (event_id + 1) AS name FROM o WHERE body IS NOT NULL
""")
def q_json_candidate(spark: SparkSession, d: str) -> DataFrame:
    """The first JSON object in a text, and a candidate's fields from it."""
    n = F.col("event_id") % 4
    t = F.when(n == 0, F.concat(F.lit("sure: ```json "), "props", F.lit(" ```"))).when(n == 1, "no json").otherwise(F.col("props"))
    rows = load(spark, d, "events").select("event_id", tx.first_json_object(t).alias("body")).where("body IS NOT NULL")
    c = scalars.candidate(F.regexp_replace("body", '"k"', '"asr_gain"'), F.col("event_id"))
    return rows.select("event_id", "body", c.alias("c")).select("event_id", "body", "c.asr_gain", "c.name")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"event\":\"' || event_type || '\",\"user\":' || user_id || '}' AS payload FROM events")
def q_json_round(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.to_json(F.struct(F.col("event_type").alias("event"), F.col("user_id").alias("user"))).alias("payload"))


@query(f"SELECT doc_id, CASE WHEN trim(coalesce(t, '')) = '' THEN t WHEN contains(lower(t), 'fail') THEN '[untranslated] ' || t ELSE t END AS translated FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'fail ' ELSE '' END || {q.collapse('text')} AS t FROM documents)")
def q_translate_once(spark: SparkSession, d: str) -> DataFrame:
    """Equal texts are translated once; failures keep the text behind a mark."""
    n = F.col("doc_id") % 5
    t = F.concat(F.when(n == 1, "fail ").otherwise(""), tx.collapse(F.col("text")))
    return rel.translate_once(load(spark, d, "documents").select("doc_id", t.alias("t")), "t", enc.plugged("translate"), "translated").select("doc_id", "translated")


@query("""
WITH e AS (SELECT user_id, event_id, event_type, event_type <> 'error' AS good FROM events)
SELECT user_id, min_by(event_type, event_id) FILTER (good) AS verdict, CAST(count(*) FILTER (NOT good) AS BIGINT) AS rejected FROM e GROUP BY 1
""")
def q_first_good(spark: SparkSession, d: str) -> DataFrame:
    """The first proposal that is no error, for each panel."""
    good = F.when(F.col("event_type") != "error", F.col("event_id"))
    return load(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", good).alias("verdict"), F.count_if(F.col("event_type") == "error").alias("rejected"))
