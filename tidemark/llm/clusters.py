"""Exact integer centroid clustering with a filter of rotated coordinates.

Vectors are whole numbers. A rotation onto the principal axes of the data (from sums of products over all vectors) puts most of a vector's length into its
leading coordinates, and each vector is stored with these and with the norm of the rest, once for all rounds. For a centroid
rotated alike, the squared distance of the leading coordinates plus the squared difference of the two norms is at most the true squared distance. So
a round computes this bound for every centroid, the true distance for the centroid of the least bound, and true distances again for those centroids
only whose bound is not above it (with room for rounding). True distances are in integers, so the result is that of comparing everything.

A round is one pass over the stored vectors; each task gives k sums, which are added by cluster and component, so k * dimensions numbers reach the
driver whatever the number of vectors. The k centroids go back with the next round's function.

Defined results: rows whose vector is null, of another length, or holds null or non-finite components are left out, and so are vectors with a component of
2**26 or more after scaling (their squared distances would not fit 64 bits); rows that repeat a vec_id are each a vector; null vec_ids are assigned like others
and start a centroid only where others are too few; with fewer vectors than centroids each vector starts one; an empty table
gives an empty result; other columns are not read; vec_id may be of any type that casts to string.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.tables import saved

#: Components are below this number, so that a squared distance of up to 256 of them fits a long.
MOST = 1 << 26
#: Leading rotated coordinates that are stored.
LEADING = 12


def _matrix(column: pa.Array, dims: int, kind: type) -> np.ndarray:
    return np.asarray(column.flatten(), kind).reshape(-1, dims)


def quantized(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id, q (array of int) of the vectors that count: floor(scale * component)."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.size("v") == dims)
    # NaN counts as the largest number here
    v = v.where(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < MOST / scale)))
    return v.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("q"))


def principal_axes(rows: DataFrame, dims: int, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean and the leading axes (columns) of q over all rows; dims**2 sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(dims), np.zeros((dims, dims))
        for b in batches:
            x = _matrix(b.column("q"), dims, np.float64)
            n, total, products = n + len(x), total + x.sum(axis=0), products + x.T @ x
        if n:
            values = np.concatenate([[n], total, products.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(values.size, dtype=np.int32)), pa.array(values)], ["at", "value"])

    sums = np.zeros(1 + dims + dims * dims)
    for at, value in rows.select("q").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value")).collect():
        sums[at] = value
    n, mean = max(1.0, sums[0]), sums[1 : 1 + dims] / max(1.0, sums[0])
    _, axes = np.linalg.eigh(sums[1 + dims :].reshape(dims, dims) / n - np.outer(mean, mean))
    return mean, axes[:, ::-1][:, :leading]


def _rotated(x: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates and norm of the rest."""
    x = x - mean
    y = x @ axes
    return y, np.sqrt(np.maximum((x * x).sum(axis=1) - (y * y).sum(axis=1), 0))


def stored(rows: DataFrame, dims: int, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """rows with lead (array of double) and rest (double)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, rest = _rotated(_matrix(b.column("q"), dims, np.float64), mean, axes)
            lead = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, axes.shape[1], dtype=np.int32)), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lead, pa.array(rest)], [*b.schema.names, "lead", "rest"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("lead", T.ArrayType(T.DoubleType())), T.StructField("rest", T.DoubleType())]))


def nearest(q: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row its nearest centroid (the smaller number of equals), the squared distance, and how many true distances it took in all."""
    c, far = _rotated(centroids.astype(np.float64), mean, axes)
    bound = ((lead * lead).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * lead @ c.T) + (rest[:, None] - far[None, :]) ** 2
    # what rounding can add to a bound: the norm of the rest is a root, so that 1e-14 of a squared length becomes 1e-7 of a length
    room = 1e-6 * ((lead * lead).sum(axis=1) + rest * rest + ((c * c).sum(axis=1) + far * far).max() + 1)
    rows, first = np.arange(len(q)), bound.argmin(axis=1)
    true = lambda r, k: ((q[r] - centroids[k]) ** 2).sum(axis=1)
    found = np.full(bound.shape, np.iinfo(np.int64).max)
    found[rows, first] = least = true(rows, first)
    r, k = np.nonzero(bound <= (least + room)[:, None])
    again = k != first[r]
    r, k = r[again], k[again]
    found[r, k] = true(r, k)
    cluster = found.argmin(axis=1)
    return cluster, found[rows, cluster], rows.size + r.size


def _arrays(b: pa.RecordBatch, dims: int, leading: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _matrix(b.column("q"), dims, np.int64), _matrix(b.column("lead"), leading, np.float64), np.asarray(b.column("rest"), np.float64)


def _moved(rows: DataFrame, centroids: np.ndarray, place: Callable, dims: int, leading: int) -> np.ndarray:
    """Each centroid at the floor of its vectors' mean; those without vectors stay."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)  # the last column counts
        for b in batches:
            q, lead, rest = _arrays(b, dims, leading)
            cluster = place(q, lead, rest, centroids)[0]
            order = np.argsort(cluster, kind="stable")
            some, began = np.unique(cluster[order], return_index=True)
            if some.size:
                total[some] += np.add.reduceat(np.column_stack([q, np.ones(len(q), np.int64)])[order], began, axis=0)
        c, at = np.divmod(np.arange(total.size), dims + 1)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total.ravel())], ["c", "at", "total"])

    out, sums = centroids.copy(), {}
    # decimals, so that no number of vectors overflows
    for c, at, total in rows.select("q", "lead", "rest").mapInArrow(run, "c int, at int, total bigint").groupBy("c", "at").agg(F.sum(F.col("total").cast("decimal(19,0)"))).collect():
        sums[c, at] = int(total)
    for c in range(k):
        if n := sums.get((c, dims)):
            out[c] = [sums[c, at] // n for at in range(dims)]
    return out


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, leading: int = LEADING) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (array of int) of each vector of vectors (vec_id, embedding, ...) that counts.

    The first centroids are the k vectors with the smallest SHA-256 of `<seed>:<vec_id>`, in that order; each round assigns and moves, and a last
    assignment follows. k is a parameter and bounds what the driver holds and what is broadcast.
    """
    if not 1 <= dims <= 256:
        raise ValueError("1 to 256 dimensions")
    leading = min(leading, dims)
    rows = saved(quantized(vectors, dims, scale), "vectors")
    mean, axes = principal_axes(rows, dims, leading)
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(mark.alias("mark"), "q").orderBy(F.col("mark").asc_nulls_last(), "q").limit(k).collect()
    centroids = np.array([r.q for r in first], np.int64).reshape(-1, dims)
    schema = "cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid array<int>"
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], T.StructType([vectors.schema["vec_id"], *T.StructType.fromDDL(schema).fields]))
    rows = saved(stored(rows, dims, mean, axes), "rotated")

    def place(q: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        return nearest(q, lead, rest, centroids, mean, axes)

    for _ in range(rounds):
        centroids = _moved(rows, centroids, place, dims, leading)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cluster, distance, _ = place(*_arrays(b, dims, leading), centroids)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    out = saved(rows.mapInArrow(run, T.StructType([vectors.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])), "assigned")
    of_cluster = {c: int(n) for c, n in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)"))).collect()}
    final = [(c, of_cluster.get(c, 0), sum(of_cluster.values()), x) for c, x in enumerate(centroids.tolist())]
    final = vectors.sparkSession.createDataFrame(final, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<int>")
    return out.join(F.broadcast(final), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # k rows


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


def _sql(k: int = 16, rounds: int = 3) -> str:
    """Assignments and moved centroids of each round, one after the other."""
    assign = """a{0} AS (
  SELECT id, arg_min(c, (d, c)) AS cluster, min(d) AS distance FROM (
    SELECT v.id, c.c, list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v CROSS JOIN c{0} c) GROUP BY id
)"""
    move = """s{1} AS (
  SELECT a.cluster, i, sum(v.q[i]) AS s, count(*) AS n FROM v JOIN a{0} a USING (id) CROSS JOIN range(1, 65) r(i) GROUP BY a.cluster, i
), c{1} AS (
  SELECT c.c, coalesce(m.q, c.q) AS q FROM c{0} c LEFT JOIN (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM s{1} GROUP BY cluster) m ON m.cluster = c.c
)"""
    steps = [step for i in range(rounds) for step in (assign.format(i), move.format(i, i + 1))] + [assign.format(rounds)]
    return f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, q FROM v QUALIFY c < {k}
), {", ".join(steps)}, t AS (SELECT cluster, sum(distance) AS inertia FROM a{rounds} GROUP BY cluster)
SELECT v.vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(a.distance AS BIGINT) AS distance, CAST(t.inertia AS BIGINT) AS cluster_inertia,
  CAST((SELECT sum(inertia) FROM t) AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM v JOIN a{rounds} a USING (id) JOIN t USING (cluster) JOIN c{rounds} c ON c.c = a.cluster
"""


OP13_SQL = _sql()
