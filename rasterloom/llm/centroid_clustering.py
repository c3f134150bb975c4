"""Operator 11, centroid clustering with block-norm screening.

Method: vectors and centroids are integers. Each is compressed once, by segments of SEGMENT components, to the sum of
a segment and the norm of what is left of it besides its mean (rounded up). By Cauchy-Schwarz these bound the inner
product from above and so the squared distance from below, in whole numbers. A vector takes the exact distance to the
centroid of least bound first; only centroids whose bound does not exceed it get an exact integer distance, so that
ties go to the smaller number as without screening.

Compressed vectors are written once in the shared folder and read by every round. A task sums its vectors by cluster
itself; K * 64 partial sums per task are shuffled, K * 64 sums come to the driver, and K centroids go out with the
next round. A cluster that holds most vectors is thus no hot key.

Defined results: vectors that are null, of another length than DIMS, or with a null or non-finite component take no
part and give no row; repeated rows count as often as they occur, and may start several centroids; a null vec_id is
hashed as the empty text and sorts by its vector among equal hashes; with fewer than K vectors there are fewer
centroids; an empty table gives an empty one; columns besides vec_id and embedding are ignored. An integer component
beyond 2**LIMIT_BITS is an error, as distances would not fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import bounded_batches, sha256_hex, slim, table, written

DIMS = 64
SEGMENT = 8
K = 16
ROUNDS = 3
SCALE = 64
LIMIT_BITS = 24


def finite(x: Column) -> Column:
    """All components are numbers: none null, infinite or not a number."""
    return F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def integers(column: pa.Array, scale: int, limit: int) -> np.ndarray:
    """floor(scale * x) of equally long lists of numbers, a row each."""
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(flat) and np.abs(flat).max() > limit:
        raise ValueError("components are too large for distances in a long")
    return flat.astype(np.int64).reshape(len(column), DIMS)


def compress(x: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment sums, segment norms without the mean (times the root of the length, rounded up), and squared norms."""
    parts = x.reshape(len(x), x.shape[1] // segment, segment)
    sums, squares = parts.sum(2), (parts * parts).sum(2)
    left = segment * squares - sums * sums
    norms = np.ceil(np.sqrt(left.astype(np.float64))).astype(np.int64)
    return sums, norms + (norms * norms < left), squares.sum(1)


class Screen:
    """Centroids with their compressed forms."""

    def __init__(self, centroids: np.ndarray, segment: int = SEGMENT) -> None:
        self.c, self.segment = centroids, segment
        self.sums, self.norms, self.square = compress(centroids, segment)

    def nearest(self, x: np.ndarray, sums: np.ndarray, norms: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid, its squared distance, and how many exact distances were taken."""
        n = np.arange(len(x))
        above = sums @ self.sums.T + norms @ self.norms.T  # no less than segment * <x, c>
        below = self.segment * (square[:, None] + self.square) - 2 * above  # no more than segment * distance
        first = below.argmin(1)
        d = np.full(below.shape, np.iinfo(np.int64).max)
        d[n, first] = ((x - self.c[first]) ** 2).sum(1)
        open_ = below <= self.segment * d[n, first][:, None]
        open_[n, first] = False
        i, j = open_.nonzero()
        d[i, j] = ((x[i] - self.c[j]) ** 2).sum(1)
        best = d.argmin(1)
        return best, d[n, best], len(n) + len(i)


def compressed(vectors: DataFrame) -> DataFrame:
    """The vectors that take part: vec_id, their integers (q) and compressed forms, as bytes, and squared norms."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    key = vectors.schema["vec_id"].dataType.simpleString()
    kept = vectors.select("vec_id", "embedding").filter((F.size("embedding") == DIMS) & finite(F.col("embedding")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = integers(b.column(1), SCALE, 1 << LIMIT_BITS)
            sums, norms, square = compress(x)
            raw = [pa.array([r.tobytes() for r in m.astype(kind)], pa.binary()) for m, kind in ((x, "<i4"), (sums, "<i8"), (norms, "<i8"))]
            yield pa.RecordBatch.from_arrays([b.column(0), *raw, pa.array(square)], ["vec_id", "q", "sums", "norms", "square"])

    return kept.mapInArrow(slim(run), f"vec_id {key}, q binary, sums binary, norms binary, square long")


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.int64).reshape(len(column), width)


def _assigned(b: pa.RecordBatch, screen: Screen) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = {name: k for k, name in enumerate(b.schema.names)}
    x = _matrix(b.column(at["q"]), "<i4", DIMS)
    best, d, _ = screen.nearest(x, _matrix(b.column(at["sums"]), "<i8", DIMS // SEGMENT), _matrix(b.column(at["norms"]), "<i8", DIMS // SEGMENT), b.column(at["square"]).to_numpy())
    return x, best, d


def starts(vectors: DataFrame, k: int = K) -> np.ndarray:
    """The integers of the k vectors with the smallest hashes, in that order."""
    named = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(named.alias("h"), "q").orderBy("h", "q").limit(k).collect()
    return np.array([np.frombuffer(r["q"], "<i4") for r in rows], np.int64).reshape(-1, DIMS)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the means of their vectors; an empty one stays."""
    screen = Screen(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for b in batches:
            x, best, _ = _assigned(b, screen)
            for k in np.unique(best):
                mine = best == k
                sums[k] += x[mine].sum(0)
                counts[k] += mine.sum()
        k = counts.nonzero()[0]
        at = np.tile(np.arange(centroids.shape[1]), len(k))
        columns = [np.repeat(k, centroids.shape[1]), at, sums[k].ravel(), np.repeat(counts[k], centroids.shape[1])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["k", "i", "s", "n"])

    parts = vectors.drop("vec_id").mapInArrow(slim(run), "k long, i long, s long, n long")
    out = centroids.copy()
    for r in parts.groupBy("k", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():  # K * 64 rows at most
        out[r["k"], r["i"]] = r["s"] // r["n"]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance of every vector."""
    screen = Screen(centroids)
    key = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, best, d = _assigned(b, screen)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best.astype(np.int32)), pa.array(d)], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(slim(run), f"vec_id {key}, cluster int, distance long")


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The final assignment (a written table) and the final centroids."""
    spark = vectors.sparkSession
    packed = written(spark, compressed(vectors), "clustering")
    centroids = starts(packed, k)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(packed, centroids)
    return written(spark, assigned(packed, centroids), "clusters"), centroids


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = clusters(table(spark, sf_dir, "embeddings"))
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(sums.values())
    facts = [(k, s, total, sha256_hex(",".join(map(str, centroids[k].tolist())).encode())) for k, s in sorted(sums.items())]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # K rows


def oracle_sql() -> str:
    """Every distance exactly, without screening; one pair of tables for each round."""
    near = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    rounds = ""
    for t in range(ROUNDS + 1):
        rounds += f""",
a{t} AS MATERIALIZED (SELECT rid, min({near}::HUGEINT * {K} + j) AS m FROM v, c{t} c GROUP BY rid)"""
        if t < ROUNDS:
            rounds += f""",
s{t} AS (
  SELECT j, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n
  FROM (SELECT (m % {K})::BIGINT AS j, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{t} JOIN v USING (rid)) GROUP BY j, i),
m{t} AS (SELECT j, list(((s - ((s % n) + n) % n) / n)::BIGINT ORDER BY i) AS q FROM s{t} GROUP BY j),
c{t + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.q, c.q) AS q FROM c{t} c LEFT JOIN m{t} m USING (j))"""
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR)) - 1 AS j, q FROM v QUALIFY j < {K}){rounds},
d AS (SELECT vec_id, (m % {K})::INTEGER AS cluster, (m // {K})::BIGINT AS distance FROM a{ROUNDS} JOIN v USING (rid))
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM d JOIN c{ROUNDS} c ON c.j = d.cluster
"""
