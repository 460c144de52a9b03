"""Aggregates over histories, batches, language scores and vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def history_summary(history: DataFrame) -> DataFrame:
    """Entries and the mean duration of those that have one, to two places."""
    return history.agg(F.count("*").alias("entries"), F.count("duration_ms").alias("timed"), F.bround(F.avg("duration_ms"), 2).alias("avg_duration_ms"))


def rtf(audio_s: Column, wall_s: Column) -> Column:
    """Audio seconds for a second of work, to three places; null unless both are above 0."""
    return F.when((audio_s > 0) & (wall_s > 0), F.bround(audio_s / wall_s, 3))


def usage(history: DataFrame) -> DataFrame:
    """Seconds, requests and last use of each key."""
    return history.groupBy("key_id").agg(F.sum(F.coalesce("duration_ms", F.lit(0))).alias("total_ms"), F.count("*").alias("request_count"), F.max("recorded").alias("last_used_at"))


def load_round(requests: DataFrame, keys: Sequence[str], seconds: str = "seconds", ok: Column | None = None, audio: Column | None = None, wall: Column | None = None) -> DataFrame:
    """Requests, those that succeeded and failed; least, mean and greatest seconds of all; the mean of those that succeeded; audio seconds for a second of the round."""
    ok = F.lit(True) if ok is None else ok
    out = [F.count("*").alias("requests"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.min(seconds).alias("min_s"), F.bround(F.avg(seconds), 2).alias("avg_s"), F.max(seconds).alias("max_s"), F.bround(F.avg(F.when(ok, F.col(seconds))), 2).alias("avg_ok_s")]
    return requests.groupBy(*keys).agg(*out, *([rtf(audio, wall).alias("rtf")] if audio is not None and wall is not None else []))


def pooled_language(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scores (keys, seconds, code_idx, p): by code the seconds-weighted mean of log p, as shares that sum to 1; the best code.

    Rows without a score or of no weight are passed over; p is kept within 1e-12 and 1.
    """
    s = scores.where("p is not null and seconds > 0")
    mean = s.groupBy(*keys, "code_idx").agg((F.sum(F.col("seconds") * F.log(F.least(F.greatest("p", F.lit(1e-12)), F.lit(1.0)))) / F.sum("seconds")).alias("m"))
    w = W.partitionBy(*keys)
    share = mean.withColumn("e", F.exp(F.col("m") - F.max("m").over(w))).withColumn("p", F.col("e") / F.sum("e").over(w))
    return share.groupBy(*keys).agg(F.max_by("code_idx", F.struct("p", -F.col("code_idx"))).alias("code_idx"), F.max("p").alias("probability"))


def majority_language(items: DataFrame, keys: Sequence[str] = ("recording_id",)) -> DataFrame:
    """The code of most seconds of each key; the earlier code on a tie."""
    total = items.where("code_idx is not null").groupBy(*keys, "code_idx").agg(F.sum(F.greatest("seconds", F.lit(0.0))).alias("s"))
    return total.groupBy(*keys).agg(F.max_by("code_idx", F.struct("s", -F.col("code_idx"))).alias("code_idx"), F.max("s").alias("seconds"))


def weighted_mean_vector(samples: DataFrame, keys: Sequence[str], vector: str = "vector", weight: str = "weight") -> DataFrame:
    """The weighted mean of each key's vectors, scaled to length 1; null if it is zero. One row a component is aggregated."""
    parts = samples.select(*keys, F.col(weight).alias("w"), F.posexplode(vector).alias("i", "x")).groupBy(*keys, "i").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"))
    rows = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("v"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("n"))
    return rows.select(*keys, F.when(F.col("n") > 0, F.transform("v", lambda s: s["m"] / F.col("n"))).alias("prototype"))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def support(samples: DataFrame, profiles: DataFrame, least: float = 0.5) -> DataFrame:
    """For each speaker and profile of a recording: the share of the speaker's weight whose best cosine to the profile's vectors is at least so high."""
    best = samples.join(profiles, "recording_id").select("recording_id", "speaker_id", "sample_idx", "weight", "profile_id", dot(F.col("vector"), F.col("profile_vector")).alias("c"))
    best = best.groupBy("recording_id", "speaker_id", "sample_idx", "weight", "profile_id").agg(F.max("c").alias("c"))
    return best.groupBy("recording_id", "speaker_id", "profile_id").agg((F.sum(F.when(F.col("c") >= least, F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("support"), F.max("c").alias("best"))


def _between(lo: Column, hi: Column, share: Column) -> Column:
    """lo (1 - share) + hi share in double precision; as in DuckDB's quantile_cont the first product is added without being rounded (fused), which decides whether a value is on a threshold or just below."""
    fused = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), lo, 1 - share, hi * share).cast("double")
    return F.when(share == 0, lo).when(lo.isNotNull() & hi.isNotNull(), fused)


def dynamic_threshold(frames: DataFrame) -> DataFrame:
    """max(1e-4, p05 + 0.05 (p95 - p05)) of each recording's energies, exact percentiles, to the last bit those of SQL's quantile_cont."""
    w = W.partitionBy("recording_id")
    ranked = frames.select("recording_id", F.col("rms").cast("double").alias("rms"), (F.row_number().over(w.orderBy(F.asc_nulls_last("rms"))) - 1).alias("i"), (F.count("rms").over(w) - 1).alias("last"))
    places = {"p05": F.col("last") * 0.05, "p95": F.col("last") * 0.95}
    ends = [F.max(F.when(F.col("i") == end(at), F.col("rms"))).alias(p + side) for p, at in places.items() for side, end in (("_lo", F.floor), ("_hi", F.ceil))]
    p = ranked.groupBy("recording_id").agg(F.max("last").alias("last"), *ends)
    p = p.select("recording_id", *[_between(F.col(k + "_lo"), F.col(k + "_hi"), at - F.floor(at)).alias(k) for k, at in places.items()])
    return p.withColumn("threshold", F.greatest(F.lit(1e-4), F.col("p05") + 0.05 * (F.col("p95") - F.col("p05"))))


def transcript(words: DataFrame, keys: Sequence[str] = ("recording_id",), order: str = "word_idx", text: str = "word") -> DataFrame:
    """Texts of each key, trimmed, blank ones left out, joined by a blank in order."""
    t = words.select(*keys, order, F.trim(text).alias("t")).where("t <> ''")
    return t.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "t"))), lambda s: s["t"]), " ").alias("transcript"))


def gate_diagnostics(turns: DataFrame, gated: DataFrame) -> DataFrame:
    """By recording: turns in, dropped as ghosts, merged away, and out."""
    a = turns.groupBy("recording_id").agg(F.count("*").alias("input"), F.count_if(F.col("end_ms") - F.col("start_ms") < 150).alias("dropped"))
    b = gated.groupBy("recording_id").agg(F.count("*").alias("output"), F.sum(F.col("merged_from") - 1).alias("remerged"))
    return a.join(b, "recording_id", "left").fillna(0, ["output", "remerged"])


def queue(jobs: DataFrame) -> DataFrame:
    """Segments of active and of waiting jobs by processing key."""
    return jobs.groupBy("processing_key").agg(F.sum(F.when(F.col("active"), F.col("pending")).otherwise(0)).alias("active_pending"), F.sum(F.when(~F.col("active"), F.col("pending")).otherwise(0)).alias("waiting_pending"), F.count("*").alias("jobs"))
