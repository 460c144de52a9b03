"""The streaming aggregates as batch queries over `events`, with DuckDB SQL; tests hold the streams against them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.views import table
from tidemark.streaming import live


def requests(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("key_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("seconds"))


def st_usage(spark: SparkSession, d: str) -> DataFrame:
    u = live.running_usage(requests(table(spark, d, "events")))
    return u.select("key_id", F.bround("total_seconds", 3).alias("total_seconds"), "request_count", F.unix_micros("last_used_at").alias("last_used_us"))


def st_idle(spark: SparkSession, d: str) -> DataFrame:
    s = live.activity_sessions(requests(table(spark, d, "events")), "2 hours")
    return s.select("key_id", F.unix_micros("began").alias("began_us"), F.unix_micros("idle_at").alias("idle_us"), "requests")


def st_poll(spark: SparkSession, d: str) -> DataFrame:
    p = live.polled(requests(table(spark, d, "events")), "1 hour")
    return p.select(F.unix_micros("at").alias("at_us"), "requests", F.bround("seconds", 3).alias("seconds"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"st_usage": st_usage, "st_idle": st_idle, "st_poll": st_poll}
_GAP = 2 * 3600 * 1_000_000
ORACLE_SQL = {
    "st_usage": "SELECT user_id AS key_id, round_even(sum(value), 3) AS total_seconds, count(*) AS request_count, CAST(epoch_us(max(ts)) AS BIGINT) AS last_used_us FROM events GROUP BY ALL",
    "st_idle": f"WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), n AS (SELECT *, CASE WHEN t < lag(t) OVER (PARTITION BY user_id ORDER BY t) + {_GAP} THEN 0 ELSE 1 END AS new FROM e), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS i FROM n) SELECT user_id AS key_id, CAST(min(t) AS BIGINT) AS began_us, CAST(max(t) + {_GAP} AS BIGINT) AS idle_us, count(*) AS requests FROM s GROUP BY user_id, i",
    "st_poll": "SELECT CAST(epoch_us(date_trunc('hour', ts)) AS BIGINT) AS at_us, count(*) AS requests, round_even(sum(value), 3) AS seconds FROM events GROUP BY ALL",
}
