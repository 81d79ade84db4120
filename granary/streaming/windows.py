"""Event-time windows, joins of requests with decisions, and streams that run to the end of their files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.session import ship

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def timed(events: DataFrame) -> DataFrame:
    """Watermarks take no timestamps without a zone, so they are read as UTC."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _sums() -> list:
    return [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")]


def _start() -> F.Column:
    return F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start")


def tumbling(events: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) by window; with a slide, windows overlap. Works on streams and tables alike."""
    return events.groupBy(F.window("ts", length, slide), "event_type").agg(*_sums()).select(_start(), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """(user_id, start, n, total): a session ends when nothing comes for ``gap``."""
    return events.groupBy(F.session_window("ts", gap).alias("window"), "user_id").agg(*_sums()).select("user_id", _start(), "n", "total")


def trailing_count(calls: DataFrame, key: str, at: str, span) -> DataFrame:
    """``calls`` with ``trailing``: how many of the key came after ``at - span`` and up to ``at``, the call itself included.

    Time is cut into buckets of ``span``. A call counts from its time on in its own bucket and stops counting at its end, which
    lies in the next; so a bucket is decided by its own calls and the ends of the one before, and a busy key is many groups. Sums
    run once over a group, whatever the window holds. A null time counts itself alone.
    """
    end = F.col(at) + F.lit(span)
    bucket = lambda t: F.floor(t / F.lit(span)).cast("long")
    own = F.struct(bucket(F.col(at)).alias("_b"), F.col(at).alias("_t"), F.lit(1).alias("_d"), F.lit(0).alias("_before"))
    gone = F.struct(bucket(end).alias("_b"), end.alias("_t"), F.lit(-1).alias("_d"), (bucket(end) > bucket(F.col(at))).cast("int").alias("_before"))
    rows = calls.where(F.col(at).isNotNull()).select("*", F.explode(F.array(own, gone)).alias("_x")).select(*calls.columns, "_x.*")
    w = Window.partitionBy(key, "_b")
    n = F.sum("_before").over(w) + F.sum("_d").over(w.orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    counted = rows.withColumn("trailing", n.cast("long")).where("_d = 1").select(*calls.columns, "trailing")
    return counted.unionByName(calls.where(F.col(at).isNull()).withColumn("trailing", F.lit(1).cast("long")))


def decisions(requests: DataFrame, answers: DataFrame, seconds: int = 3600) -> DataFrame:
    """(request, decision): the first answer of the user within the time, or "timeout".

    The interval is cut into buckets as long as it is, so an answer meets the requests of its own bucket and the one before.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    span = seconds * 1_000_000
    bucket = F.floor(us / F.lit(span))
    r = requests.select(F.col("event_id").alias("request"), "user_id", us.alias("at"), bucket.alias("b"))
    a = answers.select(F.col("event_id").alias("answer"), "user_id", us.alias("t"), "event_type", F.explode(F.array(bucket, bucket - 1)).alias("b"))
    met = r.join(a, ["user_id", "b"]).where((F.col("t") >= F.col("at")) & (F.col("t") <= F.col("at") + span))
    first = met.groupBy("request").agg(F.min_by("event_type", "answer").alias("kind"))
    decision = F.when(F.col("kind") == "purchase", "approved").when(F.col("kind").isNotNull(), "rejected").otherwise("timeout")
    return r.select("request").join(first, "request", "left").select("request", decision.alias("decision"))


def decision_stream(requests: DataFrame, answers: DataFrame, seconds: int = 3600) -> DataFrame:
    """The same as a join of two streams: both are watermarked, so state is dropped once the time is over.

    State is kept by user and bucket of time, as long as the interval: a row is held against those of about its time and not
    against all of its user. A request waits in its own bucket and the next one, so it comes twice where neither has an answer,
    and with an answer of one bucket it may come without one from the other.
    """
    bucket = F.floor(F.unix_micros("ts") / F.lit(seconds * 1_000_000))
    r = requests.select(F.col("event_id").alias("request"), "user_id", F.col("value").alias("own"), F.col("ts").alias("asked"), F.explode(F.array(bucket, bucket + 1)).alias("b")).withWatermark("asked", "10 minutes")
    a = answers.select(F.col("event_id").alias("answer"), F.col("user_id").alias("answered_by"), F.col("ts").alias("answered"), "event_type", F.col("value").alias("other"), bucket.alias("c")).withWatermark("answered", "10 minutes")
    within = (F.col("user_id") == F.col("answered_by")) & (F.col("b") == F.col("c")) & (F.col("answered") >= F.col("asked")) & (F.col("answered") <= F.col("asked") + F.expr(f"INTERVAL {seconds} SECONDS"))
    return r.join(a, within, "left").drop("b", "c")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share; one of our own only where Spark is local and none is set."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="granary-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, what: str = "stream") -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/granary-{what}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def settled(rows: DataFrame, path: str, sharded: tuple[str, ...] = ()) -> DataFrame:
    """A checkpoint of what was read from a scratch folder, which is dropped then; the checkpoint goes with the last reference to
    it, as Spark's cleaner is told so on the running context. Folders of shards within it are emptied by tasks."""
    from granary.sources.files import clear

    spark = rows.sparkSession
    shared_dir(spark)
    spark.sparkContext._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    try:
        return rows.checkpoint(eager=True)
    finally:
        for own in sharded:
            clear(spark, f"{path}{own}")
        drop(spark, path)


def run_stream(spark: SparkSession, path: str, plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run an aggregate over a stream of event files until all are read, and return its last result."""
    folder = scratch(spark)
    events = timed(spark.readStream.schema(EVENTS).parquet(f"{path}*"))  # a pattern, as the table is a file or a folder of files
    write = lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out")
    q = plan(events).writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return settled(spark.read.parquet(f"{folder}/out"), folder)


def in_goes(spark: SparkSession, rows: list[DataFrame], plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All that a stream appends, which is stopped and started again between one lot of rows and the next; its state goes on.

    Each lot is written before its go, so it is one micro-batch; the state store is the one that ``transformWithState`` needs.
    """
    from .broker import start

    ship(spark)
    folder = scratch(spark)
    for lot in rows:
        lot.write.mode("append").parquet(f"{folder}/in")
        stream = plan(spark.readStream.schema(lot.schema).parquet(f"{folder}/in"))
        write = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True)
        start(spark, write.start).awaitTermination()
    return settled(spark.read.schema(stream.schema).parquet(f"{folder}/out"), folder)
