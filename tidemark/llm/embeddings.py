"""Embedding near-duplicates: random-hyperplane sign hashes in several tables, exact cosines, connected components.

A vector's hash in one table is the signs of its products with `bits` random directions; near vectors share a hash in some of
the tables with the wanted probability, and all pairs in a bucket are compared exactly, in double precision. The
number of bits grows with the logarithm of the number of vectors, so that buckets of unrelated vectors stay small; the number of tables
follows from the wanted recall at the least cosine. A pair that meets in several tables counts in the first one only.

Equal vectors are one node with a multiplicity, so copies are never compared. A bucket above CELL vectors is cut into
cells: each pair of its blocks is compared by one task's matrix product. A cell returns, for each vector, its number of
links and the smallest id that its links in the cell reach, not the links themselves; so results stay linear in the
number of vectors however large a group is.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
lengths do not link; a null vec_id has null for component_id and links with nothing; rows that repeat a vec_id with equal
vectors are copies of each other under one id; an empty table gives an empty result; other columns are not read; vec_id may be of any type.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.components import connected_components
from tidemark.llm.tables import saved, small

CELL = 1024
RECALL = 0.99
#: Unrelated vectors that may be expected in a bucket.
BUCKET = 64


def shape(n: int, cosine: float, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """Bits and tables for n vectors: 2**bits buckets of about so many vectors, and enough tables for the recall at the least cosine."""
    bits = max(4, min(48, math.ceil(math.log2(max(1, n) / bucket))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def _hash(bits: int, tables: int, seed: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = (1 << np.arange(bits, dtype=np.int64))[None, :]
        for b in batches:
            dims = np.asarray(b.column("dim"))
            flat = np.asarray(b.column("v").flatten(), np.float64)
            at = np.concatenate([[0], np.cumsum(dims)])
            for d in np.unique(dims):
                p = planes.setdefault(int(d), np.random.default_rng([seed, int(d)]).standard_normal((int(d), bits * tables)))
                rows = np.flatnonzero(dims == d)
                x = flat[(at[rows][:, None] + np.arange(d)).ravel()].reshape(-1, d)
                h = np.stack([((x @ p[:, t * bits : (t + 1) * bits] > 0) * weights).sum(axis=1) for t in range(tables)], axis=1)
                ends = pa.array(np.arange(0, h.size + 1, tables, dtype=np.int32))
                own = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.ListArray.from_arrays(ends, pa.array(h.ravel()))], [*own.schema.names, "hashes"])

    return run


def _links(cosine: float):  # noqa: ANN202
    def run(cell: pa.Table) -> pa.Table:
        t = int(cell.column("t")[0].as_py())
        ids, many, side = (cell.column(c).to_numpy() for c in ("id", "copies", "side"))
        v = np.asarray(cell.column("v").combine_chunks().flatten(), np.float64).reshape(len(ids), -1)
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        h = np.asarray(cell.column("hashes").combine_chunks().flatten()).reshape(len(ids), -1)
        one = side == 0
        both = not (side == 1).any()
        x, y = (np.arange(len(ids)),) * 2 if both else (np.flatnonzero(one), np.flatnonzero(~one))
        a, b = np.nonzero(v[x] @ v[y].T >= cosine)
        a, b = x[a], y[b]
        if both:
            a, b = a[a < b], b[a < b]
        fresh = np.ones(a.size, bool)
        for k in range(t):
            fresh &= h[a, k] != h[b, k]
        a, b = a[fresh], b[fresh]
        count = np.zeros(len(ids), np.int64)
        np.add.at(count, a, many[b])
        np.add.at(count, b, many[a])
        least = ids.copy()
        while True:
            was = least.copy()
            np.minimum.at(least, a, was[b])
            np.minimum.at(least, b, was[a])
            if (least == was).all():
                break
        some = count > 0
        return pa.table({"id": ids[some], "links": count[some], "least": least[some]})

    return run


def embedding_groups(vectors: DataFrame, cosine: float = 0.95, recall: float = RECALL, seed: int = 1, cell: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding, ...)."""
    v = vectors.select("vec_id", F.col("embedding").alias("v"))
    number = isinstance(vectors.schema["vec_id"].dataType, T.IntegralType)
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(sound)
    nodes = good.groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")).withColumn("dim", F.size("v"))
    # ids that are no integers go by a hash until components are known
    nodes = saved(nodes.withColumn("id", F.col("first").cast("bigint") if number else F.xxhash64("first")), "vectors")
    bits, tables = shape(nodes.count(), cosine, recall)
    rows = saved(nodes.mapInArrow(_hash(bits, tables, seed), T.StructType([*nodes.schema.fields, T.StructField("hashes", T.ArrayType(T.LongType()))])), "hashes")
    places = rows.select("id", "dim", F.posexplode("hashes").alias("t", "h"))
    sizes = places.groupBy("t", "h", "dim").agg(F.count("*").alias("m")).where("m > 1")
    # only buckets of several vectors; those above a cell's size are cut into blocks and each pair of blocks is a cell
    sizes = small(saved(sizes.withColumn("blocks", F.ceil(F.col("m") / cell).cast("int")).drop("m"), "buckets"), 24)
    each = rows.select("id", "copies", "dim", "v", "hashes", F.posexplode("hashes").alias("t", "h")).join(sizes, ["t", "h", "dim"])
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    each = each.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.withColumn("c0", F.least("own", "other")).withColumn("c1", F.greatest("own", "other")).withColumn("side", (F.col("own") != F.col("c0")).cast("int"))
    found = each.select("t", "h", "dim", "c0", "c1", "side", "id", "copies", "v", "hashes").groupBy("t", "h", "dim", "c0", "c1").applyInArrow(_links(cosine), "id bigint, links bigint, least bigint")
    found = saved(found, "found")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("id != least").select(F.col("id").alias("u"), F.col("least").alias("v")))
    known = nodes.join(small(groups, 16), "id", "left").join(links, "id", "left").select("v", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    if not number:
        least = known.groupBy("component_id").agg(F.min("first").alias("least"))
        known = known.join(least, "component_id").drop("component_id").withColumnRenamed("least", "component_id")
    known = known.drop("first")
    out = v.join(known, v["v"] == known["v"], "left").select("vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("bigint").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op4_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP4_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (SELECT vec_id AS v, vec_id AS r FROM embeddings UNION SELECT reach.v, link.b FROM reach JOIN link ON reach.r = link.a),
comp AS (SELECT v, min(r) AS c FROM reach GROUP BY v), n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT x.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, CAST(comp.c AS BIGINT) AS component_id, x.vec_id = comp.c AS kept
FROM embeddings x JOIN comp ON comp.v = x.vec_id LEFT JOIN n ON n.a = x.vec_id
"""
