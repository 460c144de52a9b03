"""Running aggregates as Structured Streaming. Each function takes a batch or a stream and gives the same rows for the same input.

Watermarks bound the state; what comes later than that is left out of a stream, so batch results include it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def events(spark: SparkSession, path: str, schema: StructType, files_a_trigger: int = 16) -> DataFrame:
    """A stream over a folder of Parquet files, by an explicit schema."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def running_usage(requests: DataFrame, key: str = "key_id") -> DataFrame:
    """Seconds, requests and last use of each key so far; for update or complete mode."""
    return requests.groupBy(key).agg(F.sum("seconds").alias("total_seconds"), F.count("*").alias("request_count"), F.max("ts").alias("last_used_at"))


def activity_sessions(requests: DataFrame, gap: str = "5 seconds", late: str = "1 minute", key: str = "key_id") -> DataFrame:
    """Times of activity of each key: any request within the gap goes on with the session."""
    rows = requests.withWatermark("ts", late) if requests.isStreaming else requests
    s = rows.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("requests"))
    return s.select(key, F.col("w.start").alias("began"), F.col("w.end").alias("idle_at"), "requests")


def polled(requests: DataFrame, every: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Requests and seconds in windows of the dashboard's polls."""
    rows = requests.withWatermark("ts", late) if requests.isStreaming else requests
    s = rows.groupBy(F.window("ts", every).alias("w")).agg(F.count("*").alias("requests"), F.sum("seconds").alias("seconds"))
    return s.select(F.col("w.start").alias("at"), "requests", "seconds")


def first_of(history: DataFrame, key: str = "history_id", late: str = "1 hour") -> DataFrame:
    """Entries with a key seen before are dropped."""
    return history.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if history.isStreaming else history.dropDuplicates([key])
