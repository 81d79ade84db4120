"""Sinks: tables by key, state files, append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as tx
from granary.operators.render import result_name

from .files import write_files


#: Folders of a chunk table; a table keeps the number it was first written with.
BUCKETS = 256


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_chunks(chunks: DataFrame, path: str, key: str = "paper_id", buckets: int = BUCKETS) -> None:
    """Replace all chunks of the papers that are given, and of no other; blank chunks go, so an emptied paper has none.

    Papers lie in ``buckets`` folders by hash, in order of the key. Only folders that a given paper falls into are written again:
    what they hold of other papers, found by an anti-join, with the new chunks. Each folder has a row without a chunk, so that one
    which is left empty is overwritten too; ``read_chunks`` leaves it out. Adaptive execution splits a large folder, so several tasks
    write it.
    """
    spark = chunks.sparkSession
    full = chunks.withColumn("chunk", F.nullif(tx.strip(F.col("chunk")), F.lit(""))).withColumn("chunk_id", tx.chunk_id(F.col(key), F.col("chunk_index"))).withColumn("bucket", _bucket(F.col(key), buckets))
    papers = chunks.select(key).distinct().withColumn("bucket", _bucket(F.col(key), buckets))
    touched = [r["bucket"] for r in papers.select("bucket").distinct().collect()]  # at most as many as there are folders
    rows = full.where("chunk IS NOT NULL")
    if _there(spark, path):
        old = spark.read.schema(rows.schema).parquet(path).where(F.col("bucket").isin(touched) & F.col("chunk").isNotNull())
        rows = rows.unionByName(old.join(papers.select(key), key, "left_anti"))
    marks = papers.select("bucket").distinct()
    rows.unionByName(marks, allowMissingColumns=True).hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_chunks(spark: SparkSession, path: str, paper, key: str = "paper_id", buckets: int = BUCKETS) -> DataFrame:
    """Only the paper's folder is read, and of it the row groups that may hold the paper."""
    mine = F.col("bucket") == spark.range(1).select(_bucket(F.lit(paper), buckets)).first()[0]
    return spark.read.parquet(path).where(mine & (F.col(key) == paper) & F.col("chunk").isNotNull()).drop("bucket")


def write_results(results: DataFrame, folder: str, packed: bool = False) -> None:
    """(paper_id, kind, template, content): a file for each result, in its paper's folder, named by kind and template. Results of
    other papers and kinds stay; ``tables.results`` reads them. ``packed`` puts the files of many papers in archives."""
    name, paper = result_name(F.col("kind"), F.col("template")), F.col("paper_id").cast("string")
    write_files(results.select(F.concat_ws("/", paper, name).alias("path"), F.coalesce("content", F.lit("")).alias("content")), folder, packed)


def append_log(rows: DataFrame, path: str) -> None:
    """Token use, audits, messages: append only."""
    rows.write.mode("append").parquet(path)


def stream_log(rows: DataFrame, path: str, state: str):
    """The same for a stream: each micro-batch is appended once, as the batch's number is in the checkpoint."""
    return rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).option("path", path).trigger(availableNow=True).start()


def token_rows(calls: DataFrame) -> DataFrame:
    """Rows of the token log; the total is worked out here."""
    return calls.select("user_id", "model", "prompt_tokens", "completion_tokens", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), "action", "created_at")
