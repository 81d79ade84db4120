"""Queries of the retrieval plane."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import encode as enc
from granary.functions import scalars
from granary.functions import text as tx
from granary.operators import relational as rel
from granary.operators import retrieval as ret
from granary.operators import tiles, vector_index
from granary.session import ship
from granary.sources.tables import load
from granary.streaming import windows

from . import sql as q
from .registry import query
from .text_queries import chunk_rows, documents

KEY = ["doc_id", "chunk_index"]
_INDEX = f"""c AS ({q.CHUNKS}), ct AS (SELECT doc_id, chunk_index, unnest({q.tokens("chunk")}) AS w FROM c),
qt AS (SELECT item_id, len(ws) AS n, unnest(ws) AS w FROM (SELECT item_id, {q.tokens("question")} AS ws FROM questions)),
s AS (SELECT item_id, doc_id, chunk_index, round(count(*) / (any_value(n) + 1), 6) AS score FROM ct JOIN qt USING (w) GROUP BY 1, 2, 3),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, chunk_index) AS INTEGER) AS rank FROM s)"""


@query(f"WITH questions AS (SELECT item_id, text AS question FROM benchmark), {_INDEX} SELECT item_id, rank, doc_id, chunk_index, score FROM r WHERE rank <= 3")
def q_lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    """The three chunks that share most words with each question."""
    questions = load(spark, d, "benchmark").select("item_id", F.col("text").alias("question"))
    return ret.lexical_top_k(questions, chunk_rows(spark, d), "item_id", KEY, 3).select("item_id", "rank", *KEY, "score")


@query(f"""
WITH questions AS (SELECT item_id, CASE WHEN item_id % 4 = 0 THEN '什么' ELSE text END AS question FROM benchmark), {_INDEX},
f AS (SELECT doc_id, chunk_index, CAST(row_number() OVER (ORDER BY doc_id, chunk_index) AS INTEGER) AS rank FROM c)
SELECT item_id, rank, doc_id, chunk_index, score FROM r WHERE rank <= 3
UNION ALL SELECT item_id, rank, doc_id, chunk_index, 0.0 FROM questions, f WHERE rank <= 3 AND item_id NOT IN (SELECT item_id FROM s)
""")
def q_lexical_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Questions without a word that the index knows get the first chunks; every fourth is asked in Chinese."""
    questions = load(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 4 == 0, "什么").otherwise(F.col("text")).alias("question"))
    chunks = chunk_rows(spark, d)
    found = ret.lexical_top_k(questions, chunks, "item_id", KEY, 3)
    return rel.fallback(found, ret.first_chunks(questions, chunks, "item_id", KEY, 3), ["item_id"]).select("item_id", "rank", *KEY, "score")


_COS = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"


def _vectors(same: str, k: int, least: str = "") -> str:
    return f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COS} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0 {same}),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, id, similarity FROM r WHERE rank <= {k} {least}"""


@query(_vectors("", 3))
def q_vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return ret.cosine_top_k(load(spark, d, "embeddings"), F.col("vec_id") % 50 == 0, 3, "vec_id", "embedding").select("query_id", "rank", "id", "similarity")


@query(_vectors("AND a.label = b.label", 3))
def q_vector_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Within the query's own paper (label): an equi-join before any product."""
    return ret.cosine_top_k(load(spark, d, "embeddings"), F.col("vec_id") % 50 == 0, 3, "vec_id", "embedding", "label").select("query_id", "rank", "id", "similarity")


@query(_vectors("", 5, "AND similarity >= 0.4"))
def q_vector_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest, then only those near enough."""
    return ret.cosine_top_k(load(spark, d, "embeddings"), F.col("vec_id") % 50 == 0, 5, "vec_id", "embedding").where("similarity >= 0.4").select("query_id", "rank", "id", "similarity")


def vector_store(spark: SparkSession, d: str) -> str:
    """An index of all vectors, papers being labels: built without paper 9 and with stale vectors of paper 3, then both are put in."""
    path, e = windows.scratch(spark, "vectors"), load(spark, d, "embeddings")
    stale = F.when(F.col("label") == 3, F.reverse("embedding")).otherwise(F.col("embedding"))
    vector_index.build(e.where("label <> 9").withColumn("embedding", stale), path, "label", "vec_id", "embedding")
    vector_index.upsert(e.where("label IN (3, 9)"), path, "label", "vec_id", "embedding")
    return path


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("paper"), F.col("embedding").alias("v"))


@query()
def q_vector_index(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest by the index, which probes as many lists as it measured to hold them."""
    path = vector_store(spark, d)
    return windows.settled(vector_index.search(spark, path, _asked(spark, d), 3), path)


@query(_vectors("", 3))
def q_vector_index_exact(spark: SparkSession, d: str) -> DataFrame:
    """The same with all lists probed."""
    path = vector_store(spark, d)
    return windows.settled(vector_index.search(spark, path, _asked(spark, d), 3, vector_index.MOST), path)


@query(_vectors("AND a.label = b.label", 3))
def q_vector_index_paper(spark: SparkSession, d: str) -> DataFrame:
    """Within the query's own paper, with all lists probed."""
    path = vector_store(spark, d)
    return windows.settled(vector_index.search(spark, path, _asked(spark, d), 3, vector_index.MOST, same_paper=True), path)


@query("""
SELECT a.vec_id AS query_id, b.vec_id AS id, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2])))), 4) AS l2,
  round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS ip FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.vec_id % 50 = 0
""")
def q_vector_distances(spark: SparkSession, d: str) -> DataFrame:
    """The other two metrics, within the query's paper."""
    e = load(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    pairs = ret.vector_pairs(e, F.col("vec_id") % 50 == 0, "vec_id", "embedding", "label")
    return pairs.select("query_id", "id", F.round(scalars.l2(F.col("a"), F.col("b")), 4).alias("l2"), F.round(scalars.dot(F.col("a"), F.col("b")), 4).alias("ip"))


_RULE = " ".join(f"WHEN {' OR '.join(f'contains(t, {q.quoted(w)})' for w in words)} THEN '{tool}'" for words, tool in tx.TOOL_RULES)


@query(f"SELECT item_id, coalesce(CASE {_RULE} END, 'none') AS tool FROM (SELECT item_id, lower(CASE item_id % 5 WHEN 0 THEN 'What is the Weather? ' WHEN 1 THEN 'search paper on ' WHEN 2 THEN 'GitHub repo of ' ELSE '' END || text) AS t FROM benchmark)")
def q_tool_routing(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("item_id") % 5
    asked = F.concat(F.when(n == 0, "What is the Weather? ").when(n == 1, "search paper on ").when(n == 2, "GitHub repo of ").otherwise(""), "text")
    return load(spark, d, "benchmark").select("item_id", F.coalesce(tx.tool_by_keyword(asked), F.lit("none")).alias("tool"))


@query(f"""
WITH t AS (SELECT item_id, lower(CASE item_id % 5 WHEN 0 THEN 'What is the Weather? ' WHEN 1 THEN 'search paper on ' ELSE '' END || text) AS t FROM benchmark),
n AS (SELECT item_id, CASE {_RULE} END AS tool FROM t),
s AS (SELECT item_id, b.vec_id AS entry, 'tool_' || b.vec_id % 5 AS tool, {_COS} AS similarity FROM n JOIN embeddings a ON a.vec_id = item_id JOIN embeddings b ON b.vec_id < 12 WHERE n.tool IS NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, entry) AS place FROM s),
o AS (SELECT item_id, tool, min(place) AS place FROM p WHERE place <= 6 AND similarity >= 0.05 GROUP BY 1, 2)
SELECT item_id, 1 AS rank, tool FROM n JOIN embeddings ON vec_id = item_id WHERE tool IS NOT NULL UNION ALL SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY place) AS INTEGER), tool FROM o
""")
def q_tool_selection(spark: SparkSession, d: str) -> DataFrame:
    """Tools by a keyword, or by the six nearest of twelve entries of five tools, each tool once; vectors stand for the questions'."""
    n, e = F.col("item_id") % 5, load(spark, d, "embeddings")
    asked = F.concat(F.when(n == 0, "What is the Weather? ").when(n == 1, "search paper on ").otherwise(""), "text")
    questions = load(spark, d, "benchmark").join(e, F.col("vec_id") == F.col("item_id")).select(F.col("item_id").alias("question_id"), asked.alias("question"), F.col("embedding").alias("v"))
    tools = e.where("vec_id < 12").select(F.col("vec_id").alias("entry"), F.concat(F.lit("tool_"), (F.col("vec_id") % 5).cast("string")).alias("tool"), F.col("embedding").alias("v"))
    return ret.select_tools(questions, tools, 6, 0.05).withColumnRenamed("question_id", "item_id")


_MARKS = " OR ".join(f"contains(lower(chunk), '{m}')" for m in ret.FIGURE_MARKS)
_FIGS = f"f AS (SELECT doc_id, chunk_index, CASE WHEN doc_id % 1000 = 0 THEN 'Figure 1 shows backdoor ' WHEN doc_id % 50 = 1 THEN 'Table 2 lists ' ELSE '' END || chunk AS chunk FROM c)"


@query(f"""
WITH c AS ({q.CHUNKS}), {_FIGS},
a AS (SELECT 0 AS source, doc_id, chunk_index, substr(chunk, 1, 350) AS text FROM f WHERE contains(lower(chunk), 'backdoor') AND ({_MARKS}) ORDER BY doc_id, chunk_index LIMIT 8),
b AS (SELECT 1, doc_id, chunk_index, substr(chunk, 1, 350) FROM f WHERE ({_MARKS}) ORDER BY doc_id, chunk_index LIMIT 8)
SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY source, doc_id, chunk_index LIMIT 8
""")
def q_figure_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence on figures with the keyword, filled up with other hits that show a figure or table."""
    n = F.col("doc_id") % 50
    rows = chunk_rows(spark, d).withColumn("chunk", F.concat(F.when(F.col("doc_id") % 1000 == 0, "Figure 1 shows backdoor ").when(n == 1, "Table 2 lists ").otherwise(""), "chunk"))
    return ret.figure_evidence(rows, rows, "Backdoor", KEY, 8)


@query()
def q_hashed_search(spark: SparkSession, d: str) -> DataFrame:
    """Questions against all chunks through the built-in encoder, each within a paper (source).

    Few questions are held by every task, which cuts its texts and multiplies their vectors with those of their source; many are joined.
    """
    asked = load(spark, d, "benchmark").select("item_id", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source"), enc.hashed_vector(F.col("text")).alias("qv"))
    order = [F.desc("similarity"), F.col("doc_id"), F.col("chunk_index")]
    if asked.count() * (enc.DIM + 1) * 8 <= ret.FEW_VECTORS:
        ship(spark)
        held: dict[str, list] = {}
        for r in asked.where("item_id IS NOT NULL AND qv IS NOT NULL").collect():
            held.setdefault(r["source"], []).append((r["item_id"], r["qv"]))
        by_source = {s: (np.array([i for i, _ in own], np.int64), np.array([v for _, v in own], float)) for s, own in held.items()}
        texts = documents(spark, d, "source").where("doc_id IS NOT NULL AND source IS NOT NULL")
        parts = texts.select("doc_id", "source", F.posexplode_outer(tx.chunks(F.col("text"))).alias("chunk_index", "chunk")).where(F.col("chunk_index").isNotNull())
        slots = parts.select("source", F.col("doc_id").cast("long").alias("doc_id"), "chunk_index", enc.hashed_slots(F.col("chunk")).alias("slots"))
        near = slots.mapInArrow(tiles.best_within(by_source, 3, enc.DIM), "item_id long, doc_id long, chunk_index int, similarity double")
        return rel.best_per(near.withColumn("similarity", F.round("similarity", 6)), ["item_id"], order, 3, "rank")
    chunks = chunk_rows(spark, d).join(load(spark, d, "documents").select("doc_id", "source"), "doc_id")
    rows = chunks.select("doc_id", "chunk_index", "source", enc.hashed_vector(F.col("chunk")).alias("v"))
    largest = rows.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    blocks = -(-largest // ret.BLOCK) or 1
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "chunk_index"), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    scored = rows.join(asked, ["source", "block"]).select("item_id", "doc_id", "chunk_index", F.round(scalars.dot(F.col("v"), F.col("qv")), 6).alias("similarity"))
    return rel.best_per(scored, ["item_id"], order, 3, "rank")
