"""Window functions and top-k: densities, runs, sentences, anchors, bounded histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import joins as J


def density(frames: DataFrame, voiced: float = 0.5, active: float = 0.5) -> DataFrame:
    """Frames with the share of voiced ones among five (missing ones at the ends count as unvoiced) and whether that makes them active."""
    w = W.partitionBy("recording_id").orderBy("frame_idx").rowsBetween(-2, 2)
    d = F.sum((F.col("prob") >= voiced).cast("int")).over(w) / 5
    return frames.withColumn("density", d).withColumn("active", F.col("density") >= active)


def runs(frames: DataFrame, least: int = 1, active: str = "active") -> DataFrame:
    """first and last frame and length of the runs of active frames, of at least so many."""
    w = W.partitionBy("recording_id").orderBy("frame_idx")
    on = frames.where(F.col(active)).withColumn("run", F.col("frame_idx") - F.row_number().over(w))
    r = on.groupBy("recording_id", "run").agg(F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), F.count("*").alias("frames"))
    return r.where(F.col("frames") >= least).drop("run")


def sentences(words: DataFrame, overlaps: DataFrame | None = None, gap: float = 1.5) -> DataFrame:
    """Words (t0, t1, word, speaker) as sentences: broken at a change of speaker, a gap above so many seconds, or after . ! ?; with overlaps (start_ms, end_ms), `overlap` says whether one meets the sentence."""
    w = W.partitionBy("recording_id").orderBy("t0", "word_idx")
    new = F.lag("speaker").over(w).isNull() | (F.lag("speaker").over(w) != F.col("speaker")) | (F.col("t0") - F.lag("t1").over(w) > gap) | F.lag("word").over(w).rlike("[.!?]$")
    s = words.withColumn("sent_idx", F.sum(new.cast("int")).over(w))
    order = F.struct("t0", "word_idx")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t0", "word_idx", "word"))), lambda x: x["word"]), " ")
    s = s.groupBy("recording_id", "sent_idx", "speaker").agg(F.min("t0").alias("t0"), F.max_by("t1", order).alias("t1"), F.count("*").alias("words"), text.alias("text"))
    if overlaps is None:
        return s
    spans = s.withColumns({"start_ms": F.round(F.col("t0") * 1000).cast("bigint"), "end_ms": F.round(F.col("t1") * 1000).cast("bigint")})
    return J.overlaps(spans, overlaps, "sent_idx").drop("start_ms", "end_ms").withColumnRenamed("has_overlap", "overlap")


def newest(df: DataFrame, keys: Sequence[str], order: str, tie: str, n: int) -> DataFrame:
    """The n newest rows of each key with their rank; the greater tie first."""
    w = W.partitionBy(*keys).orderBy(F.desc(order), F.desc(tie))
    return df.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n)


def top_history(history: DataFrame, limit: int = 25, most: int = 25) -> DataFrame:
    return history.orderBy(F.desc("recorded"), F.desc("history_id")).limit(min(limit, most))


def best_two(scores: DataFrame, keys: Sequence[str], score: str, target: str) -> DataFrame:
    """The best target of each key, its score, and the runner-up's (-1 without one); the smaller target on a tie."""
    w = W.partitionBy(*keys).orderBy(F.desc(score), target)
    d = scores.withColumn("_r", F.row_number().over(w)).withColumn("runner_up", F.coalesce(F.lead(score).over(w), F.lit(-1.0)))
    return d.where("_r = 1").select(*keys, target, score, "runner_up")


def round_robin(segments: DataFrame, most: int = 16, budget: float = 100.0) -> DataFrame:
    """One batch of each processing key: a segment of each job in each round, up to so many segments and seconds.

    Jobs are in order of batch_id. The first segment always fits; the batch ends at the first that would exceed the budget. Only the
    first rounds can be in a batch, so jobs and segments beyond the most are dropped before the order is made.
    """
    job = W.partitionBy("processing_key", "batch_id").orderBy("segment_idx", "seconds")
    d = segments.withColumn("round", F.row_number().over(job)).where(F.col("round") <= most)
    w = W.partitionBy("processing_key").orderBy("round", "batch_id")
    d = d.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    d = d.withColumn("seconds_so_far", F.sum("seconds").over(w))
    over = F.max(((F.col("place") > 1) & (F.col("seconds_so_far") > budget)).cast("int")).over(w)
    return d.withColumn("_over", over).where("_over = 0").drop("_over")
