"""Range, nearest and one-to-one joins within a recording. Each is an equi-join first; the range is a second predicate.

Where a moment lies in intervals of bounded length, both sides are first dealt to time buckets, so that a recording's
moments meet the intervals near them only; the nearest interval outside comes from the last one before and the first one after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nearest(points: DataFrame, at: str, point: str, spans: DataFrame, span: str, value: str, default: str | None = None, start: str = "start_ms", end: str = "end_ms", bucket: int = 60_000) -> DataFrame:
    """points with the value of the span that holds moment `at` (both ends included; the first by span), else of the nearest one (first on a tie), else default."""
    s = spans.select("recording_id", F.col(span).alias("_i"), F.col(value).alias(value), F.col(start).alias("_s"), F.col(end).alias("_e"))
    p = points.withColumn("_b", F.floor(F.col(at) / bucket))
    held = s.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_s") / bucket), F.floor(F.col("_e") / bucket))))
    inside = p.join(held, ["recording_id", "_b"]).where((F.col("_s") <= F.col(at)) & (F.col(at) <= F.col("_e")))
    inside = inside.groupBy("recording_id", point).agg(F.min(F.struct("_i", value)).alias("_in"))
    rest = points.join(inside, ["recording_id", point], "left").withColumnRenamed(value, f"_{value}") if value in points.columns else points.join(inside, ["recording_id", point], "left")
    # the span that ends last before and the one that starts first after, by one ordered pass over both tables
    none = F.lit(None)
    w = W.partitionBy("recording_id").orderBy("_t", "_kind")
    marks = s.select("recording_id", F.col("_e").alias("_t"), F.lit(0).alias("_kind"), F.struct(F.col("_e").alias("t"), (-F.col("_i")).alias("i"), value).alias("_x"), none.cast("string").alias("_p"))
    moments = rest.where("_in is null").select("recording_id", F.col(at).alias("_t"), F.lit(1).alias("_kind"), none.cast(marks.schema["_x"].dataType).alias("_x"), F.col(point).cast("string").alias("_p"))
    before = marks.unionByName(moments).withColumn("_x", F.max("_x").over(w)).where("_kind = 1").select("recording_id", "_p", F.col("_x").alias("_before"))
    marks = s.select("recording_id", (-F.col("_s")).alias("_t"), F.lit(0).alias("_kind"), F.struct(F.col("_s").alias("t"), F.col("_i").alias("i"), value).alias("_x"), none.cast("string").alias("_p"))
    moments = rest.where("_in is null").select("recording_id", (-F.col(at)).alias("_t"), F.lit(1).alias("_kind"), none.cast(marks.schema["_x"].dataType).alias("_x"), F.col(point).cast("string").alias("_p"))
    after = marks.unionByName(moments).withColumn("_x", F.min("_x").over(w)).where("_kind = 1").select("recording_id", "_p", F.col("_x").alias("_after"))
    rows = rest.withColumn("_p", F.col(point).cast("string")).join(before, ["recording_id", "_p"], "left").join(after, ["recording_id", "_p"], "left")
    back, ahead = F.col(at) - F.col("_before.t"), F.col("_after.t") - F.col(at)
    earlier = ahead.isNull() | (back < ahead) | ((back == ahead) & (-F.col("_before.i") < F.col("_after.i")))
    found = F.when(F.col("_in").isNotNull(), F.col(f"_in.{value}")).when(back.isNotNull() & earlier, F.col(f"_before.{value}")).otherwise(F.col(f"_after.{value}"))
    return rows.select(*points.columns, (F.coalesce(found, F.lit(default)) if default is not None else found).alias(value))


def _meets(df: DataFrame, other: DataFrame, start: str, end: str, bucket: int) -> tuple[DataFrame, DataFrame, Column]:
    # the last moment of an interval is not part of it
    deal = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bucket), F.floor((F.col(e) - 1) / bucket)))
    a = df.where(F.col(end) > F.col(start)).withColumn("_b", deal(start, end))
    b = other.where(F.col(end) > F.col(start)).select("recording_id", F.col(start).alias("_s"), F.col(end).alias("_e")).withColumn("_b", deal("_s", "_e"))
    return a, b, (F.col("_e") > F.col(start)) & (F.col("_s") < F.col(end))


def overlaps(df: DataFrame, other: DataFrame, key: str, start: str = "start_ms", end: str = "end_ms", bucket: int = 60_000) -> DataFrame:
    """df with has_overlap: whether an interval of the other table shares more than an end with it."""
    a, b, meet = _meets(df.select("recording_id", key, start, end), other, start, end, bucket)
    hit = a.join(b, ["recording_id", "_b"]).where(meet).select("recording_id", key).distinct().withColumn("has_overlap", F.lit(True))
    return df.join(hit, ["recording_id", key], "left").withColumn("has_overlap", F.coalesce("has_overlap", F.lit(False)))


def sole_container(windows: DataFrame, turns: DataFrame, window: str = "window_idx", bucket: int = 60_000) -> DataFrame:
    """windows with the turn of the same speaker that holds them whole, if there is exactly one."""
    t = turns.select("recording_id", "speaker_id", F.col("turn_idx"), F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"))
    t = t.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_s") / bucket), F.floor(F.col("_e") / bucket))))
    w = windows.withColumn("_b", F.floor(F.col("start_ms") / bucket))
    hit = w.join(t, ["recording_id", "speaker_id", "_b"]).where("_s <= start_ms and end_ms <= _e")
    sole = hit.groupBy("recording_id", window).agg(F.count("*").alias("n"), F.min("turn_idx").alias("turn_idx")).where("n = 1").drop("n")
    return windows.join(sole, ["recording_id", window], "left")


def owner(points: DataFrame, at: str, chunks: DataFrame, value: str) -> DataFrame:
    """points with the value of the chunk whose bounds lo < at <= hi hold them (null bounds are open); chunks follow each other, so that it is the last one with lo below.

    One ordered pass over both tables; no point meets more than one chunk.
    """
    kind, low = chunks.schema[value].dataType, F.coalesce(F.col("lo").cast("double"), F.lit(float("-inf")))
    mark = F.struct(F.col(value).alias("v"), F.col("hi").cast("double").alias("hi"), low.alias("lo"))
    marks = chunks.select("recording_id", low.alias("_t"), F.lit(1).alias("_kind"), mark.alias("_x"), F.lit(None).cast(points.select(F.struct("*").alias("p")).schema["p"].dataType).alias("_p"))
    moments = points.select("recording_id", F.col(at).cast("double").alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast(marks.schema["_x"].dataType).alias("_x"), F.struct("*").alias("_p"))
    w = W.partitionBy("recording_id").orderBy("_t", "_kind").rowsBetween(W.unboundedPreceding, 0)
    rows = marks.unionByName(moments).withColumn("_x", F.last("_x", ignorenulls=True).over(w)).where("_kind = 0 and _x is not null and (_x.hi is null or _t <= _x.hi)")
    return rows.select("_p.*", F.col("_x.v").cast(kind).alias(value))
