"""Interval algebra on (keys, start, end): gaps and islands, difference, coverage and windows.

Each is a shuffle by the keys and window functions over it; what meets within a recording is dealt to time buckets first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ("recording_id",)


def islands(df: DataFrame, keys: Sequence[str] = KEYS, start: str = "start_ms", end: str = "end_ms", gap: float = 0, order: Sequence[str] = (), apart: Column | None = None) -> DataFrame:
    """df with `island`, the number of its merged interval within keys; empty intervals are dropped.

    An interval joins the island before it if it starts no later than its end so far plus gap, unless apart.
    """
    w = W.partitionBy(*keys).orderBy(start, end, *order)
    before = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    new = before.isNull() | (F.col(start) > before + gap)
    if apart is not None:
        new = new | apart
    return df.where(F.col(end) > F.col(start)).withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(w)).drop("_new")


def union(df: DataFrame, keys: Sequence[str] = KEYS, start: str = "start_ms", end: str = "end_ms", gap: float = 0) -> DataFrame:
    """The merged intervals of each key, with the number of intervals in each."""
    merged = islands(df, keys, start, end, gap).groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("merged_from"))
    return merged.drop("island")


def _dealt(start: str, end: str, bucket: int) -> Column:
    return F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor((F.col(end) - 1) / bucket)))


def meetings(df: DataFrame, other: DataFrame, keys: Sequence[str], within: Sequence[str], start: str, end: str, bucket: int) -> DataFrame:
    """keys, start and end of df beside _s and _e of each interval of other that shares more than an end with it and the columns `within`; each pair in its first bucket."""
    a = df.where(F.col(end) > F.col(start)).select(*dict.fromkeys([*keys, *within]), start, end).withColumn("_b", _dealt(start, end, bucket))
    b = other.where(F.col(end) > F.col(start)).select(*within, F.col(start).alias("_s"), F.col(end).alias("_e")).withColumn("_b", _dealt("_s", "_e", bucket))
    pairs = a.join(b, [*within, "_b"]).where((F.col("_e") > F.col(start)) & (F.col("_s") < F.col(end)))
    return pairs.where(F.col("_b") == F.floor(F.greatest(start, "_s") / bucket)).select(*dict.fromkeys([*keys, *within]), start, end, "_s", "_e")


def subtract(df: DataFrame, without: DataFrame, keys: Sequence[str], within: Sequence[str], start: str = "start_ms", end: str = "end_ms", bucket: int = 60_000) -> DataFrame:
    """What is left of each interval (named by keys) outside the intervals of `without` that share the columns `within`.

    An interval's cuts come to it as one sorted array, of the few that meet it; what is left lies between neighbouring cuts. One row each of df, so nothing is joined twice.
    """
    cuts = meetings(df, union(without, within, start, end), keys, within, start, end, bucket)
    cuts = cuts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_s", "_e"))).alias("_cuts"))
    edge = lambda x: F.array(F.col(x).cast("bigint"))
    some = F.coalesce("_cuts", F.array().cast("array<struct<_s:bigint,_e:bigint>>"))
    left = F.arrays_zip(F.concat(edge(start), some["_e"]).alias("a"), F.concat(some["_s"], edge(end)).alias("b"))
    rows = df.where(F.col(end) > F.col(start)).join(cuts, list(keys), "left").withColumn("_x", F.explode(left)).where("_x.b > _x.a")
    return rows.select(*[c for c in df.columns if c not in (start, end)], F.col("_x.a").alias(start), F.col("_x.b").alias(end))


def coverage(df: DataFrame, turns: DataFrame, keys: Sequence[str], within: Sequence[str] = KEYS, start: str = "start_ms", end: str = "end_ms", bucket: int = 60_000) -> DataFrame:
    """For each turn (named by keys), the length of it that the intervals of df with the same `within` cover."""
    clipped = meetings(turns, df, keys, within, start, end, bucket).select(*keys, F.greatest(start, "_s").alias("_s"), F.least(end, "_e").alias("_e"))
    covered = union(clipped, keys, "_s", "_e").groupBy(*keys).agg(F.sum(F.col("_e") - F.col("_s")).alias("covered"))
    return turns.join(covered, list(keys), "left").withColumn("covered", F.coalesce("covered", F.lit(0)))


def remerge(turns: DataFrame, gap: int = 400, least: int = 150) -> DataFrame:
    """Turns without ghosts (shorter than least), neighbours of one speaker merged if at most gap apart."""
    t = turns.where(F.col("end_ms") - F.col("start_ms") >= least)
    w = W.partitionBy("recording_id").orderBy("start_ms", "end_ms", "speaker_id", "turn_idx")
    change = F.lag("speaker_id").over(w)
    t = t.withColumn("_run", F.sum(F.when(change.isNull() | (change != F.col("speaker_id")), 1).otherwise(0)).over(w))
    r = W.partitionBy("recording_id", "_run").orderBy("start_ms", "end_ms", "turn_idx")
    reach = F.max("end_ms").over(r.rowsBetween(W.unboundedPreceding, -1))
    t = t.withColumn("_island", F.sum(F.when(reach.isNull() | (F.col("start_ms") > reach + gap), 1).otherwise(0)).over(r))
    return t.groupBy("recording_id", "speaker_id", "_run", "_island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("merged_from")).drop("_run", "_island")


def bridge(df: DataFrame, keys: Sequence[str] = KEYS, start: str = "start_s", end: str = "end_s", gap: float = 0.3, least: float = 0.2) -> DataFrame:
    """Merged intervals over gaps up to gap, those shorter than least dropped."""
    return union(df, keys, start, end, gap).where(F.col(end) - F.col(start) >= least)


def pad(df: DataFrame, by: int, length: Column | int, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Intervals widened on both sides, within 0 and length."""
    return df.withColumns({start: F.greatest(F.col(start) - by, F.lit(0)), end: F.least(F.col(end) + by, F.lit(length) if isinstance(length, int) else length)})


def pad_seams(df: DataFrame, by: int = 250, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Chunks widened by so much, or by half of the gap to the neighbour if that is less."""
    w = W.partitionBy("recording_id").orderBy(start, end)
    before, after = F.floor((F.col(start) - F.lag(end).over(w)) / 2), F.floor((F.lead(start).over(w) - F.col(end)) / 2)
    part = lambda half: F.when(half.isNull(), by).otherwise(F.least(F.lit(by), F.greatest(half, F.lit(0))))
    return df.withColumns({"pad_start": F.col(start) - part(before), "pad_end": F.col(end) + part(after)})


def seam_bounds(df: DataFrame, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """The moments that each chunk owns: between the middles of its gaps; null is without bound."""
    w = W.partitionBy("recording_id").orderBy(start, end)
    return df.withColumns({"lo": (F.lag(end).over(w) + F.col(start)) / 2, "hi": (F.col(end) + F.lead(start).over(w)) / 2})


def fixed(df: DataFrame, size: int, step: int | None = None, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Windows of a size (the last may be shorter) from each interval, every step; the windows end with the one that reaches the interval's end."""
    step = step or size
    length = F.col(end) - F.col(start)
    count = F.when(length <= size, 1).otherwise(F.ceil((length - size) / step) + 1)
    rows = df.where(length > 0).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)))
    a = F.col(start) + F.col("piece") * step
    return rows.withColumns({start: a, end: F.least(F.col(end), a + size)})


def equal(df: DataFrame, most: int, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Each interval cut into as few equal parts as keep each at most so long."""
    length = F.col(end) - F.col(start)
    n = F.greatest(F.lit(1), F.ceil(length / most)).cast("bigint")
    rows = df.where(length > 0).withColumn("_n", n).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    return rows.withColumns({start: F.col(start) + F.floor(length * F.col("piece") / F.col("_n")), end: F.col(start) + F.floor(length * (F.col("piece") + 1) / F.col("_n"))}).drop("_n")


def tumbling(df: DataFrame, size: int = 3000, least: int = 2000, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Windows of a size of intervals of at least `least`; a last shorter one stays if it is at least as long."""
    return fixed(df.where(F.col(end) - F.col(start) >= least), size, None, start, end).where(F.col(end) - F.col(start) >= least)


def seconds(df: DataFrame, keys: Sequence[str] = KEYS, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(F.col(end) - F.col(start)) / 1000).alias("seconds"))


def coverage_pairs(df: DataFrame, other: DataFrame, start: str = "start_ms", end: str = "end_ms", bucket: int = 60_000) -> DataFrame:
    """Each pair of an interval of df and one of other that share more than an end, with the length shared; dealt to time buckets, each pair in its first one."""
    deal = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bucket), F.floor((F.col(e) - 1) / bucket)))
    a = df.where(F.col(end) > F.col(start)).withColumn("_b", deal(start, end))
    b = other.where(F.col(end) > F.col(start)).select("recording_id", F.col(start).alias("_s"), F.col(end).alias("_e")).withColumn("_b", deal("_s", "_e"))
    pairs = a.join(b, ["recording_id", "_b"]).where((F.col("_e") > F.col(start)) & (F.col("_s") < F.col(end)))
    first = F.floor(F.greatest(start, "_s") / bucket)
    return pairs.where(F.col("_b") == first).withColumn("shared", F.least(end, "_e") - F.greatest(start, "_s")).drop("_b", "_s", "_e")
