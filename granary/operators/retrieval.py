"""Lexical and vector retrieval: few questions are held by every task, many are joined by words; vectors are joined by blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions import scalars
from granary.functions import text as tx

from . import tiles
from .overlap import best_shared
from .relational import best_per


def lexical_scores(questions: DataFrame, chunks: DataFrame, question_id: str, chunk_key: list[str], q_text: str = "question", c_text: str = "chunk") -> DataFrame:
    """(question_id, chunk_key..., score) of every pair that shares a word, by joining words and not texts."""
    words = tx.tokens(F.col(q_text))
    index = chunks.select(*chunk_key, F.explode(tx.tokens(F.col(c_text))).alias("word"))
    asked = questions.select(question_id, words.alias("ws")).select(question_id, F.size("ws").alias("size"), F.explode("ws").alias("word"))
    hits = index.join(asked, "word").groupBy(question_id, *chunk_key).agg(F.count("*").alias("n"), F.first("size").alias("size"))
    return hits.select(question_id, *chunk_key, F.round(F.col("n") / (F.col("size") + 1), 6).alias("score"))


#: Words of all questions together, and their bytes, up to which every task holds them.
FEW_WORDS, FEW_BYTES = 200_000, 8 << 20


def lexical_top_k(questions: DataFrame, chunks: DataFrame, question_id: str, chunk_key: list[str], k: int, q_text: str = "question", c_text: str = "chunk", few: int = FEW_WORDS) -> DataFrame:
    """The k best chunks of each question, earlier chunks first among equals; ids of questions are unique.

    The words of all questions are counted first. Where they are few, every task counts what its chunks share with them and only
    the k best a task are shuffled; else words are joined. Both give the same rows. With ``few`` words a question that shares
    one word more scores more after rounding too, so counts rank as scores do.
    """
    asked = questions.select(question_id, tx.tokens(F.col(q_text)).alias("ws")).where(F.size("ws") > 0)
    many = asked.agg(F.sum(F.size("ws")).alias("words"), F.sum(F.length(F.array_join("ws", ""))).alias("bytes")).first()
    order = [F.desc("score"), *map(F.col, chunk_key)]
    if (many["words"] or 0) > min(few, FEW_WORDS) or (many["bytes"] or 0) > FEW_BYTES:
        return best_per(lexical_scores(questions, chunks, question_id, chunk_key, q_text, c_text), [question_id], order, k, "rank")
    held = asked.toArrow().combine_chunks()
    keys = chunks.select(*chunk_key)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*asked.select(question_id).schema, *keys.schema])
    if not len(held):
        found = questions.sparkSession.createDataFrame([], f"{types}, n long, size long")
    else:
        run = best_shared(held.column(0).chunk(0), held.column(1).chunk(0), question_id, chunk_key, k)
        found = chunks.select(*chunk_key, tx.tokens(F.col(c_text)).alias("words")).mapInArrow(run, f"{types}, n long, size long")
    return best_per(found.select(question_id, *chunk_key, F.round(F.col("n") / (F.col("size") + 1), 6).alias("score")), [question_id], order, k, "rank")


def first_chunks(questions: DataFrame, chunks: DataFrame, question_id: str, chunk_key: list[str], k: int) -> DataFrame:
    """The first k chunks for each question that is given: k rows are broadcast."""
    first = chunks.select(*chunk_key).orderBy(*chunk_key).limit(k)
    rows = questions.select(question_id).crossJoin(F.broadcast(first))
    return best_per(rows.withColumn("score", F.lit(0.0)), [question_id], list(map(F.col, chunk_key)), k, "rank")


#: Rows of one key, or of one block, that one task takes.
BLOCK = 50_000
#: Bytes of queries up to which every task holds them.
FEW_VECTORS = 64 << 20


def vector_pairs(vectors: DataFrame, queries: Column, id_col: str, vector: str, same: str | None = None) -> DataFrame:
    """(query_id, id, a, b) of each query and each other vector: joined on the column ``same``, or else block by block.

    Keys are split into blocks of about ``BLOCK`` rows by the count of the largest one, and a query is sent to each block of its
    key, so no key is one task; a vector is sent nowhere else, and neither side has to fit a broadcast.
    """
    key = F.col(same) if same else F.lit(0)
    largest = vectors.groupBy(key.alias("key")).count().agg(F.max("count")).first()[0] or 0
    blocks = -(-largest // BLOCK) or 1
    v = vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("b"), key.alias("key"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("block"))
    q = vectors.where(queries).select(F.col(id_col).alias("query_id"), F.col(vector).alias("a"), key.alias("key"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return v.join(q, ["key", "block"]).where("id <> query_id").drop("key", "block")


def cosine_top_k(vectors: DataFrame, queries: Column, k: int, id_col: str, vector: str, same: str | None = None, few: int = FEW_VECTORS) -> DataFrame:
    """(query_id, rank, id, similarity): the k nearest other vectors.

    Queries of up to ``few`` bytes are held by every task, which multiplies its vectors with them and shuffles the best ones; more
    queries, and those within a key, are joined. Vectors are made unit once, so a pair costs one inner product. Both give the same rows.
    """
    ids = F.col(id_col).cast("long")
    if not same:
        asked = vectors.where(queries & ids.isNotNull()).select(ids.alias("query_id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x))")
        if (asked.agg(F.sum(F.size("v") + 1)).first()[0] or 0) * 8 <= few:
            held = [(r["query_id"], r["v"]) for r in asked.distinct().collect()]
            rows = vectors.where(ids.isNotNull()).select(ids.alias("id"), F.col(vector).cast("array<double>").alias("v"))
            near = rows.mapInArrow(tiles.best_cosines(held, k), "query_id long, id long, cosine double")
            return best_per(near.select("query_id", "id", F.round("cosine", 6).alias("similarity")), ["query_id"], [F.desc("similarity"), F.col("id")], k, "rank")
    unit = vectors.withColumn(vector, scalars.unit(F.col(vector)))
    scored = vector_pairs(unit, queries, id_col, vector, same).select("query_id", "id", F.round(scalars.dot(F.col("a"), F.col("b")), 6).alias("similarity"))
    return best_per(scored, ["query_id"], [F.desc("similarity"), F.col("id")], k, "rank")


def select_tools(questions: DataFrame, tools: DataFrame, k: int = 3, least: float = 0.4) -> DataFrame:
    """(question_id, rank, tool) for ``questions`` (question_id, question, v) from ``tools`` (entry, tool, v).

    A keyword names its tool at once. Other questions get the tools of the k nearest entries, at ``least`` near, each tool once. The
    table of tools is small, and every task holds it.
    """
    ruled = questions.select("question_id", F.col("v").alias("a"), tx.tool_by_keyword(F.col("question")).alias("tool"))
    named = ruled.where("tool IS NOT NULL").select("question_id", F.lit(1).alias("rank"), "tool")
    entries = F.broadcast(tools.select("entry", "tool", F.col("v").alias("b")))
    a, b = F.col("a"), F.col("b")
    size = scalars.norm(a) * scalars.norm(b)
    near = F.coalesce(F.round(F.when(size > 0, scalars.dot(a, b) / size), 6), F.lit(0.0)).alias("similarity")
    scored = ruled.where("tool IS NULL").drop("tool").crossJoin(entries).select("question_id", "entry", "tool", near)
    first = best_per(scored, ["question_id"], [F.desc("similarity"), F.col("entry")], max(1, k), "place").where(F.col("similarity") >= least)
    once = first.groupBy("question_id", "tool").agg(F.min("place").alias("place"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("place")))
    return named.unionByName(ranked.select("question_id", "rank", "tool"))


# Words that mark figures and tables.
FIGURE_MARKS = ("figure", "fig.", "table", "图", "表")


def figure_evidence(chunks: DataFrame, hits: DataFrame, keyword: str, order: list[str], k: int, cap: int = 350) -> DataFrame:
    """Chunks with the keyword and a mark of a figure, in order; vector hits with a mark fill what is left of k."""
    low, n = F.lower("chunk"), max(1, min(k, 8))
    marked = tx.contains_any(low, FIGURE_MARKS)
    first = chunks.where(F.contains(low, F.lit(keyword.lower())) & marked).select(F.lit(0).alias("source"), *order, F.substring("chunk", 1, cap).alias("text"))
    second = hits.where(marked).select(F.lit(1).alias("source"), *order, F.substring("chunk", 1, cap).alias("text"))
    both = first.orderBy(*order).limit(n).unionByName(second.orderBy(*order).limit(n))
    return both.orderBy("source", *order).limit(n)
