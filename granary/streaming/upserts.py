"""Rows by key that a stream upserts, each micro-batch once, whatever dies between.

A table is folders of Parquet by hash of the key (``BUCKETS``), and a ledger of versions. A micro-batch writes the buckets that it
touches into a new folder and then adds one small file to the ledger: where each bucket lies now, and the last batch of each
source. Readers go by the last version. A run that dies before that file is there has changed nothing; the batch comes again and
is written again. A batch that comes again after it is passed over. What died leaves a folder that no version names; ``vacuum``
drops those, and versions before the last.

Within a batch a key's rows count in the order of ``order``; the row of the largest one stays. With ``patch`` a null keeps what was
there, field by field, so a row may carry a status, tags or a state alone. A row whose ``gone`` column is true deletes its key, and
rows after it start anew. Rows with a null key are left out. One writer at a time may add versions.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[str]:
    system, ledger = _fs(spark, f"{path}/ledger")
    return sorted(n for s in system.listStatus(ledger) if (n := s.getPath().getName()).endswith(".json")) if system.exists(ledger) else []


def version(spark: SparkSession, path: str) -> dict:
    """What the last version says: {"buckets": {bucket: folder}, "applied": {source: batch}}."""
    names = versions(spark, path)
    if not names:
        return {"buckets": {}, "applied": {}}
    return json.loads(spark.read.text(f"{path}/ledger/{names[-1]}", wholetext=True).first()[0])


def _commit(spark: SparkSession, path: str, content: dict) -> None:
    names = versions(spark, path)
    name = f"{int(names[-1].removesuffix('.json')) + 1 if names else 0:012d}.json"
    system, part = _fs(spark, f"{path}/ledger/.{uuid.uuid4().hex}")
    out = system.create(part)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    _, done = _fs(spark, f"{path}/ledger/{name}")
    if system.exists(done) or not system.rename(part, done):
        raise RuntimeError(f"another writer has added version {name}")


def read(spark: SparkSession, path: str, schema, only: list[int] | None = None) -> DataFrame:
    """The table's rows as of the last version, or those of some buckets."""
    at = {int(b): f for b, f in version(spark, path)["buckets"].items() if only is None or int(b) in only}
    rows = spark.createDataFrame([], schema)
    for folder in sorted(set(at.values())):
        own = [f"{path}/data/{folder}/bucket={b}" for b, f in at.items() if f == folder]
        rows = rows.unionByName(spark.read.schema(schema).parquet(*own))
    return rows


def _folded(rows: DataFrame, key: str, order: str, gone: str | None, patch: bool) -> DataFrame:
    """One row for each key: its fields after all of its rows, and whether what was there before counts for nothing."""
    fields = [c for c in rows.columns if c not in (key, order, gone)]
    if gone:
        last_gone = rows.where(F.col(gone)).groupBy(key).agg(F.max(order).alias("_gone"))
        rows = rows.join(last_gone, key, "left")
        live = rows.where(~F.coalesce(F.col(gone), F.lit(False)) & (F.col("_gone").isNull() | (F.col(order) > F.col("_gone"))))
    else:
        live = rows
    named = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))) if patch else F.max_by(c, order)
    new = live.groupBy(key).agg(F.max(order).alias(order), *[named(c).alias(c) for c in fields])
    if not gone:
        return new.withColumn("_fresh", F.lit(not patch)).withColumn("_live", F.lit(True))
    both = last_gone.join(new, key, "full")
    return both.withColumn("_fresh", F.col("_gone").isNotNull() | F.lit(not patch)).withColumn("_live", F.col(order).isNotNull()).drop("_gone")


def apply(batch: DataFrame, number: int, path: str, key: str, order: str, source: str = "stream", gone: str | None = None, patch: bool = False, died: Callable | None = None) -> bool:
    """Put a micro-batch into the table; False if it is there already. ``died`` is called between writing and committing."""
    spark = batch.sparkSession
    now = version(spark, path)
    if now["applied"].get(source, -1) >= number:
        return False
    schema = batch.drop(*[gone] * bool(gone)).schema
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int")
    new = _folded(batch.where(F.col(key).isNotNull()), key, order, gone, patch)
    touched = sorted(r[0] for r in batch.where(F.col(key).isNotNull()).select(bucket).distinct().collect())  # at most BUCKETS
    folder = f"{number}-{uuid.uuid4().hex}"
    if touched:
        old, fields = read(spark, path, schema, touched), [c for c in schema.names if c != key]
        o, n = old.alias("o"), new.alias("n")
        met = o.join(n, key, "full").where(F.coalesce("n._live", F.lit(True)))
        pick = lambda c: F.when(F.col("n._live").isNull(), F.col(f"o.{c}")).when(F.col("n._fresh"), F.col(f"n.{c}")).otherwise(F.coalesce(f"n.{c}", f"o.{c}")).alias(c)
        rows = met.select(key, *map(pick, fields)).withColumn("bucket", bucket)
        # A file for each bucket, so that one which is left empty is there to be read.
        marks = spark.createDataFrame([(b,) for b in touched], "bucket int")
        whole = rows.unionByName(marks, allowMissingColumns=True)
        whole.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/data/{folder}")
    if died:
        died()
    _commit(spark, path, {"buckets": now["buckets"] | {str(b): folder for b in touched}, "applied": now["applied"] | {source: number}})
    return True


def table(spark: SparkSession, path: str, schema, key: str) -> DataFrame:
    return read(spark, path, schema).where(F.col(key).isNotNull())


def vacuum(spark: SparkSession, path: str) -> None:
    """Drop folders that the last version does not name, and all versions before it."""
    used = set(version(spark, path)["buckets"].values())
    system, data = _fs(spark, f"{path}/data")
    for s in system.listStatus(data) if system.exists(data) else []:
        if s.getPath().getName() not in used:
            system.delete(s.getPath(), True)
    for name in versions(spark, path)[:-1]:
        system.delete(_fs(spark, f"{path}/ledger/{name}")[1], False)


def stream(rows: DataFrame, path: str, state: str, key: str, order: str, **how):
    """Start a stream that upserts all that is there; its state tells it which batches it has begun, the ledger which have ended."""
    put = lambda batch, number: apply(batch, number, path, key, order, **how) and None
    return rows.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()
