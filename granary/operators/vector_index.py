"""An inverted file of vectors: lists around centroids, searched by probing the nearest lists, with exact similarities.

``build`` fits centroids by k-means on a bounded sample (``SAMPLE`` rows a list, those of the least hash of their id) and assigns
every row. How many lists a search probes is measured, not guessed: for ``ASKED`` rows the exact nearest are found among all rows,
and the least number of lists that holds ``recall`` of them is kept with the index. ``upsert`` replaces all rows of the papers that
are given: only the lists that hold or get such rows are written again. ``search`` reads the lists that its queries probe.

Layout of an index: ``lists`` (list, centroid) and ``meta`` (probes, salts), both small, and ``vectors`` in a folder for each list.
Centroids are at most ``MOST`` and held by every task. A list that holds a large share of all rows is split by ``salts`` when it is
searched, so no task takes a whole one; the number comes from the largest list at the time of building.

Vectors are made unit. One that is null, of another length than most at the time of building, zero, or with null or non-finite components has
no direction and is not in the index; nor is a row with a null id. A null paper is a paper like others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import scalars
from granary.session import ship
from granary.sources.tables import spread

from .relational import best_per
from .tiles import CLOSE

#: Lists at most, rows of the sample for each, rows asked for when recall is measured, rows of a list that one task takes.
MOST, SAMPLE, ASKED, BLOCK = 65_536, 64, 100, 50_000
#: Bytes of query vectors that every task holds, pairs of a row and a query of one task, and most tasks; rows of one product.
FEW, PAIRS, TASKS, TILE = 64 << 20, 1 << 28, 4096, 2048
ROWS = "paper string, id long, v array<double>, list int"


def _usable(vectors: DataFrame, paper: str, id_col: str, vector: str) -> DataFrame:
    """(paper, id, v): unit vectors with a direction."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(paper).cast("string").alias("paper"), F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", ok) & F.exists("v", lambda x: x != 0)).withColumn("v", scalars.unit(F.col("v")))


def _nearest(centroids: np.ndarray, n: int) -> Callable:
    """Each row with the ``n`` nearest lists, nearest first; rows of another length go."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            col = b.column(b.schema.get_field_index("v"))
            own = np.flatnonzero(np.diff(col.offsets.to_numpy()) == centroids.shape[1])
            if not len(own):
                continue
            b = b.take(pa.array(own))
            m = b.column(b.schema.get_field_index("v")).flatten().to_numpy().reshape(-1, centroids.shape[1])
            # Of equal centroids the first comes first, so all tasks agree.
            close = m @ centroids.T
            near = (close.argmax(1)[:, None] if n == 1 else np.argsort(-close, axis=1, kind="stable")[:, :n]).astype(np.int32)
            lists = pa.ListArray.from_arrays(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32), near.ravel())
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, "lists"])

    return run


def _with_lists(rows: DataFrame, centroids: np.ndarray, n: int) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_nearest(centroids, min(n, len(centroids))), f"{schema}, lists array<int>")


def _assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    return _with_lists(rows, centroids, 1).select("paper", "id", "v", F.get("lists", 0).alias("list"))


def _centroids(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([r["centroid"] for r in spark.read.parquet(f"{path}/lists").orderBy("list").collect()])  # at most MOST


def _fit(rows: DataFrame, lists: int) -> np.ndarray:
    """Centroids of length one; fewer where the sample has fewer vectors."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(lists * SAMPLE).select(array_to_vector("v").alias("features"))
    # A limit leaves all rows in one partition, and rounds of k-means would be one task each.
    sample = sample.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)
    found = KMeans(k=max(2, lists), seed=1, maxIter=20).fit(sample).clusterCenters() if lists > 1 else [np.array(r["v"]) for r in rows.orderBy(F.xxhash64("id"), "id").limit(1).collect()]
    m = np.array(found)
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return (m / np.where(size > 0, size, 1)).astype(float)


def _write(rows: DataFrame, path: str) -> None:
    rows.repartition("list", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("list", "paper").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("list").parquet(f"{path}/vectors")


def _probes(vectors: DataFrame, centroids: np.ndarray, k: int, recall: float) -> int:
    """The least number of lists that holds ``recall`` of the exact k nearest of some rows."""
    from .retrieval import cosine_top_k

    asked = [r["id"] for r in vectors.select("id").distinct().orderBy(F.xxhash64("id")).limit(ASKED).collect()]
    exact = cosine_top_k(vectors.select("id", "v"), F.col("id").isin(asked), k, "id", "v").select("query_id", "id")
    order = _with_lists(vectors.where(F.col("id").isin(asked)).select(F.col("id").alias("query_id"), "v"), centroids, len(centroids)).select("query_id", "lists")
    met = exact.join(vectors.select("id", "list"), "id").join(F.broadcast(order), "query_id")
    places = np.sort([r["p"] for r in met.select(F.array_position("lists", F.col("list")).alias("p")).collect()])  # ASKED * k rows
    return int(places[max(0, int(np.ceil(recall * len(places))) - 1)]) if len(places) else 1


def build(vectors: DataFrame, path: str, paper: str, id_col: str, vector: str, lists: int | None = None, k: int = 10, recall: float = 0.95) -> None:
    """Write an index of ``vectors`` to a new folder. ``lists`` are the square root of the number of rows, if not given."""
    spark = vectors.sparkSession
    ship(spark)
    rows = spread(_usable(vectors, paper, id_col, vector), "id")
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    n = common["count"] if common else 0
    rows = rows.where(F.size("v") == (common["d"] if common else 0))
    centroids = _fit(rows, min(MOST, lists or max(1, round(n**0.5)))) if n else np.zeros((1, 1))
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>").write.parquet(f"{path}/lists")
    _write(_assigned(rows, centroids), path) if n else spark.createDataFrame([], ROWS).write.parquet(f"{path}/vectors/list=-1")
    stored = spark.read.schema(ROWS).parquet(f"{path}/vectors")
    largest = stored.groupBy("list").count().agg(F.max("count")).first()[0] or 0
    probes = _probes(stored, centroids, k, recall)
    spark.createDataFrame([(probes, -(-largest // BLOCK) or 1)], "probes int, salts int").write.parquet(f"{path}/meta")


def upsert(vectors: DataFrame, path: str, paper: str, id_col: str, vector: str) -> None:
    """All rows of the given papers are replaced by the given ones; a paper whose vectors are all unusable has none then."""
    spark = vectors.sparkSession
    ship(spark)
    papers = vectors.select(F.col(paper).cast("string").alias("paper")).distinct()
    new = _assigned(_usable(vectors, paper, id_col, vector), _centroids(spark, path))
    old = spark.read.schema(ROWS).parquet(f"{path}/vectors").where("v IS NOT NULL")
    same = F.col("paper").eqNullSafe(F.col("p"))
    gone = papers.withColumnRenamed("paper", "p")
    touched = [r["list"] for r in old.select("paper", "list").join(gone, same, "left_semi").select("list").union(new.select("list")).distinct().collect()]  # at most MOST
    if not touched:
        return
    kept = old.where(F.col("list").isin(touched)).join(gone, same, "left_anti")
    # A row without a vector for each list, so that one which is left empty is overwritten too.
    marks = spark.createDataFrame([(None, None, None, x) for x in touched], ROWS)
    _write(kept.unionByName(new).unionByName(marks), path)


def _best(asked: list[tuple], k: int, same_paper: bool, lists: int) -> Callable:
    """From rows in order of their list and queries (paper, id, v, lists): (query_id, id, cosine) of the k best rows of a task for each
    query, and of those close to them. A cosine that is given is summed in order, as SQL does."""
    names: dict[str | None, int] = {}
    paper = np.array([names.setdefault(p, len(names)) for p, *_ in asked])
    qid, q = np.array([i for _, i, *_ in asked], np.int64), np.array([v for *_, v, _ in asked], float)
    probed = np.concatenate([np.asarray(own, np.int64) for *_, own in asked])
    who = np.repeat(np.arange(len(asked)), [len(own) for *_, own in asked])
    who = who[order := np.argsort(probed, kind="stable")]
    edge = np.searchsorted(probed[order], np.arange(lists + 1))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.full((len(qid), k), -np.inf)
        for b in it:
            col = lambda name, b=b: b.column(b.schema.get_field_index(name))
            ids, at = col("id").to_numpy(), col("list").to_numpy()
            m = col("v").flatten().to_numpy().reshape(len(ids), q.shape[1])
            papers = np.array([names.get(p, -1) for p in col("paper").to_pylist()]) if same_paper else None
            cuts = np.unique(np.concatenate([np.flatnonzero(np.diff(at)) + 1, np.arange(0, len(at), TILE), [len(at)]]))
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                w = who[edge[at[x]] : edge[at[x] + 1]]
                for w in np.array_split(w, -(-len(w) // TILE) or 1):
                    s = q[w] @ m[x:y].T
                    s[qid[w][:, None] == ids[x:y]] = -np.inf
                    if papers is not None:
                        s[paper[w][:, None] != papers[x:y]] = -np.inf
                    better = np.flatnonzero(s.max(1, initial=-np.inf) >= top[w, -1] - CLOSE)
                    s, w = s[better], w[better]
                    both = np.concatenate([top[w], np.partition(s, s.shape[1] - min(k, s.shape[1]), axis=1)[:, -k:]], 1)
                    top[w] = -np.sort(-both, axis=1)[:, :k]
                    r, c = np.nonzero((s >= top[w][:, -1:] - CLOSE) & (s > -np.inf))
                    if len(r):
                        cosine = (q[w[r]] * m[x + c]).cumsum(1)[:, -1]
                        yield pa.RecordBatch.from_arrays([pa.array(qid[w[r]]), pa.array(ids[x + c]), pa.array(cosine)], ["query_id", "id", "cosine"])

    return run


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = None, same_paper: bool = False) -> DataFrame:
    """(query_id, rank, id, similarity) for ``queries`` (query_id long, v array[, paper]): the k nearest other rows of the probed lists.

    Queries of up to ``FEW`` bytes are held by every task, which multiplies the rows of a list with the queries that probe it and
    gives those near the best; more are joined. Both give the same rows.

    ``probes`` is what was measured when the index was built, if not given; as many as there are lists makes the search exact.
    With ``same_paper`` only rows of the query's own paper count. Ties go to the smaller id; rows with the query's id are its own.
    """
    ship(spark)
    meta = spark.read.parquet(f"{path}/meta").first()
    centroids = _centroids(spark, path)
    paper = F.col("paper").cast("string") if "paper" in queries.columns else F.lit(None).cast("string")
    asked = _usable(queries.withColumn("paper", paper), "paper", "query_id", "v").withColumnRenamed("id", "query_id").withColumnRenamed("paper", "p")
    number, held = asked.agg(F.count("*"), F.sum(F.size("v"))).first()
    if number and held * 8 <= FEW and (own := _with_lists(asked, centroids, probes or meta["probes"]).collect()):
        stored = spark.read.schema(ROWS).parquet(f"{path}/vectors").where("v IS NOT NULL")
        # Work is pairs and not bytes, by which adaptive execution would make few tasks of it.
        tasks = min(TASKS, max(2 * spark.sparkContext.defaultParallelism, -(-stored.count() * number // PAIRS)))
        dealt = stored.repartition(tasks, "id").sortWithinPartitions("list")
        near = dealt.mapInArrow(_best([tuple(r) for r in own], k, same_paper, len(centroids)), "query_id long, id long, cosine double")
        return best_per(near.select("query_id", "id", F.round("cosine", 6).alias("similarity")), ["query_id"], [F.desc("similarity"), F.col("id")], k, "rank").select("query_id", "rank", "id", "similarity")
    salts = meta["salts"]
    probed = _with_lists(asked, centroids, probes or meta["probes"]).select("query_id", "p", F.col("v").alias("a"), F.explode("lists").alias("list"))
    q = probed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = spark.read.schema(ROWS).parquet(f"{path}/vectors").where("v IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    met: Column = F.col("id") != F.col("query_id")
    if same_paper:
        met &= F.col("paper").eqNullSafe(F.col("p"))
    scored = rows.join(q, ["list", "salt"]).where(met).select("query_id", "id", F.round(scalars.dot(F.col("a"), F.col("v")), 6).alias("similarity"))
    return best_per(scored, ["query_id"], [F.desc("similarity"), F.col("id")], k, "rank").select("query_id", "rank", "id", "similarity")
