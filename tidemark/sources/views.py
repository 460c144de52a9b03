"""Domain tables derived from the driver's tables, in Spark; SQL holds the same derivations for DuckDB.

A recording is one calendar day of thirty users of `events`; turns, words and frames of it come from their events. So it is the number of recordings that
grows with the input, not their length; likewise for samples (250 consecutive vectors) and detected items (a source's share of 4,000 consecutive documents).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Language codes in the order that breaks ties (fixed values).
LANGUAGES = ("de", "en", "fr", "it", "es", "pt", "el", "nl", "pl", "ar", "vi", "zh", "ja", "ko")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    ms = F.unix_millis(ts) - F.unix_millis(F.date_trunc("day", ts))
    return table(spark, sf_dir, "events").select(F.concat(F.date_format(ts, "yyyy-MM-dd"), F.lit("-"), F.floor(F.col("user_id") / 30).cast("string")).alias("recording_id"), "event_id", ms.alias("ms"), "user_id", "event_type", "value")


def turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, turn_idx, start_ms, end_ms, speaker_id, kind."""
    return _events(spark, sf_dir).select(
        "recording_id", F.col("event_id").alias("turn_idx"), F.col("ms").alias("start_ms"), (F.col("ms") + F.floor(F.col("value") * 1000)).alias("end_ms"),
        F.concat(F.lit("SPEAKER_"), (F.col("user_id") % 5).cast("string")).alias("speaker_id"), F.col("event_type").alias("kind"),
    )


def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, start_ms, end_ms of what neighbouring turns of kind error share."""
    w = W.partitionBy("recording_id").orderBy("start_ms", "turn_idx")
    t = turn(spark, sf_dir).where("kind = 'error'").withColumns({"s": F.lead("start_ms").over(w), "e": F.lead("end_ms").over(w)})
    return t.select("recording_id", F.greatest("start_ms", "s").alias("start_ms"), F.least("end_ms", "e").alias("end_ms")).where("s is not null and end_ms > start_ms")


def word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, word_idx, t0, t1 (seconds), word; from the events that are clicks or views."""
    e = _events(spark, sf_dir).where("event_type in ('click', 'view')")
    text = F.concat(F.col("event_type"), F.when(F.col("user_id") % 3 == 0, ".").otherwise(""))
    return e.select("recording_id", F.col("event_id").alias("word_idx"), (F.col("ms") / 1000).alias("t0"), ((F.col("ms") + 400) / 1000).alias("t1"), text.alias("word"))


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, frame_idx (from 0), prob, rms."""
    w = W.partitionBy("recording_id").orderBy("ms", "event_id")
    return _events(spark, sf_dir).select("recording_id", (F.row_number().over(w) - 1).cast("bigint").alias("frame_idx"), (F.col("user_id") % 100 / 100.0).alias("prob"), (F.col("value") / 5000).alias("rms"))


def lid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, item_idx, seconds, language (null for some), probability, code_idx."""
    d = table(spark, sf_dir, "documents")
    known = F.when(F.col("doc_id") % 9 != 0, F.col("lang"))
    code = F.array_position(F.array(*map(F.lit, LANGUAGES)), known)
    return d.select(F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 4000).cast("string")).alias("recording_id"), F.col("doc_id").alias("item_idx"), (0.5 + F.col("doc_id") % 40 * 0.25).alias("seconds"), known.alias("language"), F.when(known.isNotNull(), 0.3 + F.col("doc_id") % 70 / 100.0).alias("probability"), code.cast("bigint").alias("code_idx"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """history_id, recorded, mode, key_id, duration_ms (null for status P), retry_of."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("history_id"), F.col("o_orderdate").cast("timestamp").alias("recorded"), F.when(F.col("o_orderkey") % 3 == 0, "diarization").otherwise("transcript").alias("mode"), F.col("o_custkey").alias("key_id"),
        F.when(F.col("o_orderstatus") != "P", F.floor(F.col("o_totalprice")).cast("bigint")).alias("duration_ms"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") - 4).alias("retry_of"),
    )


def segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batch_id, segment_idx, seconds, processing_key of each audio segment."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").cast("bigint").alias("segment_idx"), F.col("l_quantity").alias("seconds"), F.col("l_returnflag").alias("processing_key"))


def _samples(e: DataFrame, voice: Column, speaker: Column, *more: str) -> DataFrame:
    boosted = F.transform("embedding", lambda x, i: x.cast("double") + F.when(i == voice, 1.5).otherwise(0.0))
    norm = F.sqrt(F.aggregate("b", F.lit(0.0), lambda a, x: a + x * x))
    quality = 0.4 + 0.6 * (F.col("vec_id") % 10) / 10
    rows = e.withColumn("b", boosted).withColumn("n", norm).withColumn("quality", quality)
    return rows.select(
        F.concat(F.lit("rec-"), F.floor(F.col("vec_id") / 250).cast("string")).alias("recording_id"), F.concat(F.lit("SPEAKER_"), speaker.cast("string")).alias("speaker_id"), F.col("vec_id").alias("sample_idx"), (F.col("vec_id") * 3000).alias("start_ms"), (F.col("vec_id") * 3000 + 3000).alias("end_ms"),
        F.lit(3.0).alias("seconds"), "quality", F.greatest(F.col("quality") * 3.0, F.lit(1e-6)).alias("weight"), F.zip_with("b", F.array_repeat("n", F.size("b")), lambda x, n: x / n).alias("vector"), *more,
    )


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, speaker_id, sample_idx, start_ms, end_ms, seconds, quality, weight, vector (unit, double)."""
    return _samples(table(spark, sf_dir, "embeddings"), F.col("label"), F.col("label"))


def voice_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with turn_idx and stitched: two in a row are one turn in the voice of the first one's label; one turn in twenty is heard as the speaker of the second one's."""
    e = table(spark, sf_dir, "embeddings").withColumn("turn_idx", F.floor(F.col("vec_id") / 2)).withColumn("stitched", F.col("vec_id") % 16 == 5)
    w = W.partitionBy("turn_idx")
    e = e.withColumns({"voice": F.min_by("label", "vec_id").over(w), "other": F.max_by("label", "vec_id").over(w)})
    return _samples(e, F.col("voice"), F.when(F.col("turn_idx") % 20 == 7, F.col("other")).otherwise(F.col("voice")), "turn_idx", "stitched")


def turns_of(samples: DataFrame) -> DataFrame:
    """recording_id, turn_idx, start_ms, end_ms, speaker_id of the turns of voice_sample."""
    return samples.groupBy("recording_id", "turn_idx").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min("speaker_id").alias("speaker_id"))


def overlaps_of(samples: DataFrame) -> DataFrame:
    """recording_id, start_ms, end_ms: half a second of each sample of the least quality."""
    return samples.where("quality < 0.45").select("recording_id", "start_ms", (F.col("start_ms") + 500).alias("end_ms"))


_EV = "ev AS (SELECT strftime(ts, '%Y-%m-%d') || '-' || CAST(user_id // 30 AS VARCHAR) AS recording_id, event_id, CAST(epoch_us(ts) // 1000 - epoch_us(date_trunc('day', ts)) // 1000 AS BIGINT) AS ms, user_id, event_type, value FROM events)"
_TURN = f"{_EV}, turn AS (SELECT recording_id, event_id AS turn_idx, ms AS start_ms, ms + CAST(floor(value * 1000) AS BIGINT) AS end_ms, 'SPEAKER_' || CAST(user_id % 5 AS VARCHAR) AS speaker_id, event_type AS kind FROM ev)"
_CODES = "[" + ", ".join(f"'{c}'" for c in LANGUAGES) + "]"

#: The same tables as common table expressions, to follow WITH.
SQL = {
    "turn": _TURN,
    "overlap": _TURN + ", ov AS (SELECT *, lead(start_ms) OVER w AS s, lead(end_ms) OVER w AS e FROM turn WHERE kind = 'error' WINDOW w AS (PARTITION BY recording_id ORDER BY start_ms, turn_idx)), overlap AS (SELECT recording_id, greatest(start_ms, s) AS start_ms, least(end_ms, e) AS end_ms FROM ov WHERE s IS NOT NULL AND least(end_ms, e) > greatest(start_ms, s))",
    "word": _TURN + ", word AS (SELECT recording_id, event_id AS word_idx, ms / 1000 AS t0, (ms + 400) / 1000 AS t1, event_type || CASE WHEN user_id % 3 = 0 THEN '.' ELSE '' END AS word FROM ev WHERE event_type IN ('click', 'view'))",
    "frame": f"{_EV}, frame AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY ms, event_id) - 1 AS frame_idx, (user_id % 100) / 100.0 AS prob, value / 5000 AS rms FROM ev)",
    "lid": f"lid0 AS (SELECT *, CASE WHEN doc_id % 9 <> 0 THEN lang END AS language FROM documents), lid AS (SELECT source || '-' || CAST(doc_id // 4000 AS VARCHAR) AS recording_id, doc_id AS item_idx, 0.5::DOUBLE + (doc_id % 40) * 0.25::DOUBLE AS seconds, language, CASE WHEN language IS NOT NULL THEN 0.3::DOUBLE + (doc_id % 70) / 100.0::DOUBLE END AS probability, CAST(list_position({_CODES}, language) AS BIGINT) AS code_idx FROM lid0)",
    "history": "history AS (SELECT o_orderkey AS history_id, o_orderdate AS recorded, CASE WHEN o_orderkey % 3 = 0 THEN 'diarization' ELSE 'transcript' END AS mode, o_custkey AS key_id, CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice) AS BIGINT) END AS duration_ms, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey - 4 END AS retry_of FROM orders)",
    "segment": "segment AS (SELECT l_orderkey AS batch_id, CAST(l_linenumber AS BIGINT) AS segment_idx, l_quantity AS seconds, l_returnflag AS processing_key FROM lineitem)",
    "sample": "s0 AS (SELECT *, list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) + CASE WHEN i - 1 = label THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END) AS b, 0.4::DOUBLE + 0.6::DOUBLE * (vec_id % 10) / 10 AS quality FROM embeddings), sample AS (SELECT 'rec-' || CAST(vec_id // 250 AS VARCHAR) AS recording_id, 'SPEAKER_' || CAST(label AS VARCHAR) AS speaker_id, vec_id AS sample_idx, vec_id * 3000 AS start_ms, vec_id * 3000 + 3000 AS end_ms, 3.0::DOUBLE AS seconds, quality, greatest(quality * 3.0::DOUBLE, 1e-6::DOUBLE) AS weight, list_transform(b, lambda x: x / sqrt(list_sum(list_transform(b, lambda y: y * y)))) AS vector FROM s0)",
    "voice": "v0 AS (SELECT *, vec_id // 2 AS turn_idx, vec_id % 16 = 5 AS stitched, first_value(label) OVER w AS voice, last_value(label) OVER w AS other FROM embeddings WINDOW w AS (PARTITION BY vec_id // 2 ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), s0 AS (SELECT *, CASE WHEN turn_idx % 20 = 7 THEN other ELSE voice END AS heard, list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) + CASE WHEN i - 1 = voice THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END) AS b, 0.4::DOUBLE + 0.6::DOUBLE * (vec_id % 10) / 10 AS quality FROM v0), sample AS (SELECT 'rec-' || CAST(vec_id // 250 AS VARCHAR) AS recording_id, turn_idx, stitched, 'SPEAKER_' || CAST(heard AS VARCHAR) AS speaker_id, vec_id AS sample_idx, vec_id * 3000 AS start_ms, vec_id * 3000 + 3000 AS end_ms, 3.0::DOUBLE AS seconds, quality, greatest(quality * 3.0::DOUBLE, 1e-6::DOUBLE) AS weight, list_transform(b, lambda x: x / sqrt(list_sum(list_transform(b, lambda y: y * y)))) AS vector FROM s0), voice_turn AS (SELECT recording_id, turn_idx, min(start_ms) AS start_ms, max(end_ms) AS end_ms, min(speaker_id) AS speaker_id FROM sample GROUP BY ALL), voice_overlap AS (SELECT recording_id, start_ms, start_ms + 500 AS end_ms FROM sample WHERE quality < 0.45)",
}
