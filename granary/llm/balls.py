"""Ball k-means: clusters as balls, of which only the neighbours within reach are compared, and only for the rows they can reach.

Vectors are written once, as blocks of whole numbers. A round is one pass over the blocks. In a block the members of a cluster are
a ball about its centroid, with the distance of the farthest member as its radius. Another centroid is a neighbour of the ball if
it lies within twice the radius; a member is nearer to its own centroid than to any that lies beyond twice its distance. Members
within half the distance to the nearest neighbour are the stable core and stay. Around the core lie annuli, bounded by half the
distances to the neighbours in order; members of an annulus are compared with the neighbours whose half distance they exceed,
exactly, and with no others. Bounds are whole numbers, and on the bound itself rows are compared, so ties go to the smaller number.

The clusters of a part's blocks lie in the shared folder by part, and the next round reads those of its own blocks there; vectors
are never shuffled. What is shuffled are sums by (cluster, place) of the vector, a row for each cluster that a block holds, summed
before the shuffle. The driver sees the centroids: k vectors. A round that moves no centroid is the last one needed.

Rows: a vector that is null, has another length, or holds null or non-finite components is left out. A null vec_id counts as an
empty text where starting centroids are chosen, and is clustered like others. Rows that repeat are each a vector. Of fewer vectors
than k each is a centroid; none give no rows. Sums beyond 2^95 and distances beyond a long are errors. Other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_scratch, kept, numbered, scratch, table

K, ROUNDS, DIM, SCALE, SEED = 8, 10, 64, 1024, "3"
#: Rows of a block, and bytes of its vectors as doubles.
BLOCK, BLOCK_BYTES = 4096, 4 << 20
#: Bytes of a row group of blocks, so that readers hold few at once.
ROW_GROUP = 16 << 20
#: Squared distances whose bound is below this are exact in doubles.
EXACT = 2.0**53
_LOW = (1 << 32) - 1
_whole = np.frompyfunc(int, 1, 1)


def _blocks(dim: int, scale: float) -> Callable:
    most = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, dim))))

    def pack(part: int, block: int, ids: list[pa.Array], ms: list[np.ndarray]) -> pa.RecordBatch:
        m = np.concatenate(ms)
        top = np.abs(m).max(initial=0)
        kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<f8"
        vectors = np.ascontiguousarray(m, kind).tobytes()
        of = pa.concat_arrays(ids)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(of)], pa.int32()), of), pa.array([kind]), pa.array([vectors], pa.binary())], ["part", "block", "ids", "kind", "vectors"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, ids, ms, n = TaskContext.get().partitionId(), 0, [], [], 0
        for b in it:
            at = 0
            while at < b.num_rows:
                own = b.slice(at, most - n)
                flat = own.column(1).flatten().to_numpy(zero_copy_only=False)
                ids.append(own.column(0))
                ms.append(np.floor(scale * flat).reshape(own.num_rows, dim))
                at, n = at + own.num_rows, n + own.num_rows
                if n == most:
                    yield pack(part, block, ids, ms)
                    block, ids, ms, n = block + 1, [], [], 0
        if n:
            yield pack(part, block, ids, ms)

    return run


def exact(m: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and centroids as doubles, or as Python's whole numbers where squared distances would not be exact in doubles."""
    top = max(np.abs(m).max(initial=0), max((abs(x) for x in c.ravel().tolist()), default=0))
    if (2.0 * float(top)) ** 2 * max(1, m.shape[1]) < EXACT:
        return m.astype(np.float64), c.astype(np.float64)
    return _whole(m), _whole(c)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one vector, as longs or Python's whole numbers."""
    e = x - c
    return np.einsum("ij,ij->i", e, e).astype(np.int64) if e.dtype == np.float64 else (e * e).sum(1)


def reassign(m: np.ndarray, before: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (ties: smaller number) and its squared distance, from the clusters of the last round; and how
    many distances between rows and centroids that took."""
    cluster, dist = before.astype(np.int64), np.zeros(len(m), object if m.dtype == object else np.int64)
    count = 0
    for i in np.unique(before).tolist():
        own = np.flatnonzero(before == i)
        x = m[own]
        d = squares(x, c[i])
        count += len(own)
        apart = squares(c, c[i])
        # 4 * d >= apart, with whole numbers that cannot overflow.
        reach = (apart + 3) // 4
        radius = d.max()
        best, least = np.full(len(own), i), d.copy()
        near = [j for j in np.argsort(apart, kind="stable").tolist() if j != i and reach[j] <= radius]
        ring = np.arange(len(own))
        for j in near:
            ring = ring[d[ring] >= reach[j]]  # the annuli from this neighbour on
            e = squares(x[ring], c[j])
            count += len(ring)
            nearer = (e < least[ring]) | ((e == least[ring]) & (j < best[ring]))
            best[ring[nearer]], least[ring[nearer]] = j, e[nearer]
        cluster[own], dist[own] = best, least
    return cluster, dist, count


def _last(folder: str | None) -> Callable[[int, int], bytes | None]:
    """The clusters that the last round gave a block; those of one part are held."""
    held: list = [None, {}]
    if folder is None:
        return lambda part, block: None
    system, base = fs.FileSystem.from_uri(folder)

    def of(part: int, block: int) -> bytes | None:
        if held[0] != part:
            found = {}
            for f in system.get_file_info(fs.FileSelector(f"{base}/part={part}")):
                if f.path.endswith(".parquet"):
                    t = pq.read_table(f.path, filesystem=system, columns=["block", "clusters"], partitioning=None)
                    found |= zip(t.column("block").to_pylist(), t.column("clusters").to_pylist(), strict=True)
            held[:] = part, found
        return held[1][block]

    return of


def _over(last: str | None, centroids: list[list[int]], give: Callable) -> Callable:
    """``give`` of each block, its matrix, clusters and distances under the centroids."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, c = _last(last), np.array(centroids, object)
        for b in it:
            for row in range(b.num_rows):
                part, block, ids, kind, vectors = (b.column(i)[row] for i in range(5))
                before = of(part.as_py(), block.as_py())
                raw = np.frombuffer(vectors.as_buffer(), kind.as_py()).reshape(len(ids), -1)
                m, own = exact(raw, c)
                cluster, dist, _ = reassign(m, np.zeros(len(m), np.int64) if before is None else np.frombuffer(before, "<i4"), own)
                yield give(part, block, ids, m, cluster, dist)

    return run


def _sums(part: pa.Scalar, block: pa.Scalar, ids: pa.Scalar, m: np.ndarray, cluster: np.ndarray, dist: np.ndarray) -> pa.RecordBatch:
    """The clusters of a block, and for each that it holds the number of rows and their sums, in two halves that stay exact."""
    found = []
    for i in np.unique(cluster).tolist():
        own = m[cluster == i]
        total = own.sum(0)
        total = total if total.dtype == object else total.astype(np.int64)
        found.append({"cluster": i, "sums": [len(own), *(total & _LOW).tolist(), *(total >> 32).tolist()]})
    return pa.RecordBatch.from_arrays(
        [pa.array([part.as_py()], pa.int32()), pa.array([block.as_py()], pa.int32()), pa.array([cluster.astype("<i4").tobytes()], pa.binary()), pa.array([found], pa.list_(pa.struct([("cluster", pa.int32()), ("sums", pa.list_(pa.int64()))])))], ["part", "block", "clusters", "found"]
    )


def _rows(part: pa.Scalar, block: pa.Scalar, ids: pa.Scalar, m: np.ndarray, cluster: np.ndarray, dist: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids.values, pa.array(cluster.astype(np.int32)), pa.array(dist.astype(np.int64))], ["vec_id", "cluster", "distance"])


def _moved(step: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The floor of the mean of each cluster; empty ones stay. At most k * (2 * dim + 1) rows reach the driver."""
    sums = step.select(F.explode("found").alias("f")).select("f.cluster", F.posexplode("f.sums").alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum("x").alias("x"))
    got = {(r.cluster, r.pos): r.x for r in sums.collect()}
    dim, out = len(centroids[0]), []
    for i, old in enumerate(centroids):
        n = got.get((i, 0), 0)
        out.append([(got[i, 1 + p] + (got[i, 1 + dim + p] << 32)) // n for p in range(dim)] if n else old)
    return out


def ball_k_means(
    vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: float = SCALE, seed: str = SEED, id_col: str = "vec_id", vector: str = "embedding"
) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) for each vector of ``dim`` components, taken as floor(scale * x), and the centroids.

    Centroids start as the k vectors of the smallest SHA-256 of ``seed:id`` and move to the floor of their members' mean ``rounds`` times.
    """
    spark = vectors.sparkSession
    own, (i, v) = numbered(vectors, id_col, vector)
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = own.select(F.col(i).cast("long").alias("vec_id"), F.col(v).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (F.size("v") == dim) & F.forall("v", ok))
    first = usable.select("v", F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h")).orderBy("h", "v").limit(k)  # k rows
    centroids = [[int(np.floor(scale * x)) for x in r.v] for r in first.collect()]
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    folder = scratch(spark, "balls")
    try:
        packed = usable.mapInArrow(_blocks(dim, scale), "part int, block int, ids array<long>, kind string, vectors binary")
        packed.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(f"{folder}/vectors")
        blocks = spark.read.schema(packed.schema).parquet(f"{folder}/vectors")
        last = None
        for n in range(rounds):
            step = f"{folder}/round-{n}"
            blocks.mapInArrow(_over(last, centroids, _sums), "part int, block int, clusters binary, found array<struct<cluster int, sums array<long>>>").write.partitionBy("part").parquet(step)
            moved = _moved(spark.read.parquet(step), centroids)
            if last:
                drop_scratch(spark, last)
            last, same, centroids = step, moved == centroids, moved
            if same:
                break
        return kept(blocks.mapInArrow(_over(last, centroids, _rows), "vec_id long, cluster int, distance long")), centroids
    finally:
        drop_scratch(spark, folder)


def op13_ball_k_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = ball_k_means(table(spark, sf_dir, "embeddings"))
    inertia = {r.cluster: r.d for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # at most k rows
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    about = [(i, inertia.get(i, 0), sum(inertia.values()), digest(c)) for i, c in enumerate(centroids)]
    return rows.join(F.broadcast(spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster")


def _sql() -> str:
    """Lloyd's rounds over all vectors and centroids, one after the other."""
    lines = [f"""WITH m AS MATERIALIZED (
  SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (SELECT rn, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM m),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cluster, v AS c
  FROM (SELECT v, sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM m ORDER BY h, v LIMIT {K})
)"""]
    for i in range(ROUNDS + 1):
        lines.append(f"""a{i} AS MATERIALIZED (
  SELECT rn, cluster, d FROM (SELECT rn, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM m, c{i})
  QUALIFY row_number() OVER (PARTITION BY rn ORDER BY d, cluster) = 1
)""")
        if i < ROUNDS:
            lines.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % k + k) % k)) // k AS BIGINT) ORDER BY pos) AS c
    FROM (SELECT cluster, pos, sum(x) AS s, count(*) AS k FROM a{i} JOIN x USING (rn) GROUP BY 1, 2) GROUP BY 1
  ) n USING (cluster)
)""")
    return ",\n".join(lines) + f"""
SELECT vec_id, cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN m USING (rn) JOIN c{ROUNDS} USING (cluster)
"""


OP13_SQL = _sql()
