"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Tokens (runs of letters, digits and non-ASCII bytes; runs of other visible bytes), pairs of neighbouring tokens and the heads of words are hashed
into buckets, each into one of either half of a table, as into two models; of the two ratios the more cautious one counts, so that a chance meeting in one bucket is harmless.
A model says how probable it is that a document holds a bucket: the raw model by counts over the whole corpus, the target model by counts over documents
labelled good. The log ratio of the two, smoothed by one document, is shrunk by how surely the counts differ: by z**8 / (z**8 + SURE**8), where z is
their difference in standard deviations. So a ratio of rare words is small and never cut off, and it grows with the evidence at every size of the corpus.
A document's log weight sums the ratios of its distinct buckets' n-grams (repeats within a document would let one line outweigh the rest). Its key is
the log weight plus Gumbel noise (drawn from a hash of doc_id) of scale NOISE, and the k documents of largest key are chosen: a
sample without replacement in proportion to the weights, sharpened by the noise's scale.

k counts the documents whose log weight reaches a cut; the cut is the one that separates best among the labelled rows, each weighed by models from
which its own counts are taken away, since a row that a model was made of always looks like it. The labelled
rows are at most MOST_LABELLED (a sample by hash); everything else runs over all rows.

Defined results: a null or empty text has log weight 0; rows with the same doc_id draw the same noise; a document with
several labels is toxic if one says so and good only if all do; null labels count as missing; without good or bad
labels all ratios are 0 or all documents are kept; ties at the last place are all kept; other columns, whatever their names, are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.kernels import LOWER, WHITE, Spans, as_bytes, distinct, grams, mix
from tidemark.llm.tables import fresh, saved

BUCKETS = 1 << 18
MOST_LABELLED = 40_000
#: Standard deviations at which a ratio counts half, and how steeply its share rises.
SURE, STEEP = 3.0, 8
#: The scale of the Gumbel noise.
NOISE = 0.25
#: Bytes of the heads of words that are features of their own.
HEADS = (4, 5, 6)
#: Bytes of a text that are hashed at a time.
PIECE = 1 << 20

_KIND = np.full(256, 2, np.int8)
_KIND[WHITE] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def _features(a: np.ndarray, k: np.ndarray, edges: np.ndarray) -> np.ndarray:
    full = k[edges[:-1]] > 0
    starts, ends = edges[:-1][full], edges[1:][full]
    spans = Spans(a)
    h, word = spans.hashes(starts, ends), k[starts] == 1
    shares = [((h[2 * i :] == h[i:-i]) & (h[i:-i] == h[: -2 * i]) & word[2 * i :]).sum() / max(1, word.sum()) if h.size > 2 * i else 0 for i in (1, 2)]
    marks = [8 * i + int(8 * x) for i, x in enumerate(shares, 1) if x >= 1 / 8]
    long = np.flatnonzero(word & (ends - starts > HEADS[0]))
    first = [starts[long[ends[long] - starts[long] > n]] for n in HEADS]
    heads = spans.hashes(np.concatenate(first), np.concatenate([x + n for x, n in zip(first, HEADS)]))
    return np.concatenate([h, grams(h, 2), mix(np.array(marks, np.uint64)), mix(heads)])


def features(text: bytes) -> np.ndarray:
    """The hashes of a text's tokens (A-Z in lower case) and pairs of tokens, with repeats, and a mark of their repetition.

    Beside them, the heads of longer words. The marks stand for the
    share of words, in eighths, that come the third time in steps of one or of two tokens.
    """
    a = np.frombuffer(text.translate(LOWER), np.uint8)
    if not a.size:
        return np.empty(0, np.uint64)
    k = _KIND[a]
    edges = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [a.size]])
    if a.size <= PIECE:
        return _features(a, k, edges)
    # a very long text goes in pieces, cut between tokens
    cuts = np.unique(np.concatenate([edges[np.searchsorted(edges, np.arange(0, a.size, PIECE))], [a.size]]))
    parts = [(lo, hi, edges[(edges >= lo) & (edges <= hi)] - lo) for lo, hi in zip(cuts[:-1], cuts[1:])]
    return np.concatenate([_features(a[lo:hi], k[lo:hi], e) for lo, hi, e in parts])


def places(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of hashes in the first and in the second half of a table."""
    half = np.uint64(buckets // 2)
    return (h % half).astype(np.int64), ((h >> np.uint64(32)) % half + half).astype(np.int64)


def ratio(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """The log ratio of counts in target documents to those expected by the raw model, shrunk by how surely they differ."""
    z = (np.abs(seen - expected) / np.sqrt(expected + 1)) ** STEEP
    return np.log((seen + 1) / (expected + 1)) * z / (z + SURE**STEEP)


def _sum(h: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
    """The sum over distinct hashes of the weaker of two ratios; 0 where these differ in sign."""
    some = np.flatnonzero(x * y > 0)
    if not some.size:
        return 0.0
    _, first = np.unique(h[some], return_index=True)
    x, y = x[some[first]], y[some[first]]
    return float(np.where(np.abs(x) < np.abs(y), x, y).sum(dtype=np.float64))


def log_weight(text: bytes, ratios: np.ndarray) -> float:
    """The sum over a text's distinct features of the weaker of their two ratios."""
    h = features(text)
    return _sum(h, *(ratios[p] for p in places(h, len(ratios))))


def held_out_weight(text: bytes, good: bool, target: np.ndarray, raw: np.ndarray) -> float:
    """The log weight of a document by models from which its own counts are taken away."""
    h = distinct(features(text))
    share = (target[-1] - good) / max(1, raw[-1] - 1)
    # a document counts once for each of its hashes, also where two of them share a bucket
    at = [np.unique(p, return_inverse=True, return_counts=True) for p in places(h, len(raw) - 1)]
    own = [n[back] for _, back, n in at]
    return _sum(h, *(ratio(np.maximum(target[p] - good * n, 0), np.maximum(raw[p] - n, 0) * share) for p, n in zip(places(h, len(raw) - 1), own)))


def _counts(buckets: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros(buckets + 1, np.int64)
        for b in batches:
            for t in as_bytes(b.column("text")):
                for p in places(distinct(features(t or b"")), buckets):
                    np.add.at(c, p, 1)
                c[buckets] += 1
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(c[at])], ["bucket", "n"])

    return run


def document_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Documents that hold each bucket, and at the end the number of documents; summed by Spark from each task's counts."""
    rows = docs.select("text").mapInArrow(_counts(buckets), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    c = np.zeros(buckets + 1)
    c[rows["bucket"]] = rows["n"]
    return c


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """By bucket, the shrunk log ratio of its share in target documents to that in all."""
    if not target[-1] or not raw[-1]:
        return np.zeros(len(raw) - 1, np.float32)
    return ratio(target[:-1], raw[:-1] * target[-1] / raw[-1]).astype(np.float32)


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The cut with the best mean of the shares kept of good and dropped of bad; of equals, the lowest."""
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    lost, dropped = np.concatenate([[0], np.cumsum(g)]) / g.sum(), np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()
    at = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
    i = at[np.argmax(dropped[at] - lost[at])]
    return float(w[i] if not i else (w[i] + w[i - 1]) / 2)


def weighted(docs: DataFrame, ratios: np.ndarray, name: str = "_log_weight") -> DataFrame:
    """docs with their log weights as name; the ratios (1 MB, whatever the input) go with the function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = [log_weight(t, ratios) if t else 0.0 for t in as_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(w, pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def held_out(rows: DataFrame, target: np.ndarray, raw: np.ndarray) -> DataFrame:
    """log_weight, good of labelled rows (text, _good), each without its own counts; the counts (4 MB, whatever the input) go with the function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = b.column("_good").to_pylist()
            w = [held_out_weight(t, g, target, raw) if t and target[-1] > g else 0.0 for t, g in zip(as_bytes(b.column("text")), good)]
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.float64()), pa.array(good)], ["log_weight", "good"])

    return rows.select("text", "_good").mapInArrow(run, "log_weight double, good boolean")


def _key(seed: int, noise: float, name: str = "_log_weight") -> Column:
    """The log weight plus Gumbel noise."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.col(f"`{name}`") - noise * F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int, bins: int = 4096) -> float:
    """The k-th largest of the doubles in column key, exactly, by counts in ever finer ranges."""
    lo, hi, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k <= 0:
        return float("inf")
    if k >= n:
        return float("-inf")
    while True:
        inside = keys.where(F.col("key").between(lo, hi))
        step = (hi - lo) / bins
        if lo + step / 2 == lo or hi == lo:
            return hi
        count = inside.groupBy(F.least(F.lit(bins - 1), F.floor((F.col("key") - lo) / step)).cast("int").alias("b")).agg(F.count("*").alias("c"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy(F.desc("b")).collect()
        for r in count:
            if k <= r["c"]:
                break
            k -= r["c"]
        if r["c"] <= bins:
            return keys.where(F.col("key").between(r["lo"], r["hi"])).orderBy(F.desc("key")).limit(k).agg(F.min("key")).first()[0]
        lo, hi = r["lo"], r["hi"]


class Resampling:
    """The fitted models, the documents' weights (saved) and the least key that is chosen."""

    def __init__(self, docs: DataFrame, labels: DataFrame, seed: int = 1, noise: float = NOISE, most_labelled: int = MOST_LABELLED, buckets: int = BUCKETS) -> None:
        marks = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where("doc_id is not null and quality is not null and toxic is not null")
        marks = marks.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most_labelled)
        marks = F.broadcast(saved(marks.select(F.col("doc_id").alias("_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("_good")), "labelled"))
        near = saved(docs.select("doc_id", "text").join(marks, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_good"), "labelled-texts")
        target, raw = document_counts(near.where("_good"), buckets), document_counts(docs, buckets)
        self.ratios = log_ratios(target, raw)
        known = held_out(near, target, raw).toPandas()
        self.cut = best_cut(known["log_weight"].to_numpy(), known["good"].to_numpy(bool))
        self.seed, self.noise = seed, noise
        self.rows = saved(weighted(docs.select("doc_id", "text"), self.ratios).select("doc_id", F.col("_log_weight").alias("log_weight"), _key(seed, noise).alias("key")), "weights")
        self.k = self.rows.where(F.col("log_weight") >= self.cut).count()
        self.least = kth_largest(self.rows, self.k)


def quality_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """doc_id, log_weight, key, kept of each row of docs (doc_id, text, ...) by labels (doc_id, quality, toxic)."""
    r = Resampling(docs, labels, **options)
    return r.rows.withColumn("kept", F.col("key") >= r.least)


def resampled(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """The rows of docs that are chosen, with the columns of docs; texts are weighed again rather than joined."""
    r = Resampling(docs, labels, **options)
    name = fresh("_log_weight", docs)
    return weighted(docs, r.ratios, name).where(_key(r.seed, r.noise, name) >= r.least).drop(name)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
