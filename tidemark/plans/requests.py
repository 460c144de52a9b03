"""Registered queries on requests, settings, plans and the checks of a refinement; with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import folds as D
from tidemark.operators import requests as R
from tidemark.sources import views as V
from tidemark.sources.views import SQL as S
from tidemark.streaming import blobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):  # noqa: ANN201
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return register


@query("ivl_concat_vad", f"WITH {S['turn']}, p AS (SELECT *, sum(end_ms - start_ms) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms, turn_idx ROWS UNBOUNDED PRECEDING) AS b FROM turn WHERE end_ms > start_ms), w AS (SELECT *, unnest(range(CAST((b - (end_ms - start_ms)) // 3000 AS BIGINT), CAST((b - 1) // 3000 AS BIGINT) + 1)) AS win FROM p) SELECT recording_id, win AS \"window\", CAST(sum(least(b, (win + 1) * 3000) - greatest(b - (end_ms - start_ms), win * 3000)) AS BIGINT) AS length, count(*) AS sources FROM w GROUP BY ALL HAVING sum(least(b, (win + 1) * 3000) - greatest(b - (end_ms - start_ms), win * 3000)) >= 500")
def ivl_concat_vad(spark: SparkSession, d: str) -> DataFrame:
    return D.stitch(V.turn(spark, d), ["recording_id"], 3000, 500, ties=["turn_idx"])


@query("ivl_speech_concat", f"WITH {S['turn']} SELECT recording_id, turn_idx, CAST(sum(end_ms - start_ms) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms, turn_idx ROWS UNBOUNDED PRECEDING) - (end_ms - start_ms) AS BIGINT) AS \"offset\" FROM turn WHERE end_ms > start_ms")
def ivl_speech_concat(spark: SparkSession, d: str) -> DataFrame:
    return R.concatenated(V.turn(spark, d), ["recording_id"], order=["turn_idx"]).select("recording_id", "turn_idx", "offset")


@query("jn_owner", f"WITH {S['sample']} SELECT s.recording_id, s.speaker_id, count(*) AS windows, count(e.vec_id) = count(*) AS complete FROM sample s LEFT JOIN embeddings e ON e.vec_id = s.sample_idx GROUP BY ALL")
def jn_owner(spark: SparkSession, d: str) -> DataFrame:
    """Windows with their results by number, and whether a speaker has them all."""
    e = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_idx"), F.lit(True).alias("has"))
    return V.sample(spark, d).join(e, "sample_idx", "left").groupBy("recording_id", "speaker_id").agg(F.count("*").alias("windows"), (F.count("has") == F.count("*")).alias("complete"))


@query("jn_scatter", f"WITH {S['lid']}, k AS (SELECT *, row_number() OVER (PARTITION BY recording_id, coalesce(code_idx, 0) ORDER BY item_idx) - 1 AS k FROM lid) SELECT recording_id, item_idx, coalesce(code_idx, 0) AS code_idx, k // 16 AS batch, k % 16 AS place FROM k")
def jn_scatter(spark: SparkSession, d: str) -> DataFrame:
    """Items dealt to batches of one language."""
    items = V.lid(spark, d).withColumn("code_idx", F.coalesce("code_idx", F.lit(0)))
    return R.batches(items, ["recording_id", "code_idx"], "item_idx", 16).select("recording_id", "item_idx", "code_idx", "batch", F.col("place").cast("bigint").alias("place"))


@query("top_changes", f"WITH {S['turn']}, c AS (SELECT recording_id, turn_idx, row_number() OVER (PARTITION BY recording_id ORDER BY turn_idx) AS k, count(*) OVER (PARTITION BY recording_id) AS n FROM turn) SELECT recording_id, turn_idx, n > 20 AS truncated FROM c WHERE k <= 20")
def top_changes(spark: SparkSession, d: str) -> DataFrame:
    return R.first_changes(V.turn(spark, d).select("recording_id", "turn_idx"), ["recording_id"], "turn_idx", 20)


@query("top_load_cycle", "WITH f AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM documents), r AS (SELECT unnest(range(0, 2 * n + 7)) AS request FROM (SELECT count(*) AS n FROM documents)) SELECT requests, count(*) AS files FROM (SELECT f.doc_id, count(*) AS requests FROM r JOIN f ON r.request % f.n = f.k GROUP BY ALL) GROUP BY ALL")
def top_load_cycle(spark: SparkSession, d: str) -> DataFrame:
    """How often a plan of two rounds and seven requests takes each file."""
    files = V.table(spark, d, "documents").select("doc_id")
    plan = R.cycle(files, "doc_id", 2 * files.count() + 7)
    return plan.groupBy("doc_id").agg(F.count("*").alias("requests")).groupBy("requests").agg(F.count("*").alias("files"))


@query(
    "jn_history_blob",
    f"WITH {S['history']}, c AS (SELECT history_id, duration_ms <= 250000 AS ok FROM history WHERE retry_of IS NULL AND duration_ms IS NOT NULL), s AS (SELECT history_id, CASE WHEN ok THEN 'available' ELSE 'file_too_large' END AS status FROM c UNION ALL SELECT h.history_id, 'available' FROM history h JOIN c ON c.history_id = h.retry_of AND c.ok) "
    "SELECT CAST(h.history_id AS VARCHAR) AS history_id, h.mode, coalesce(s.status = 'available', false) AS has_blob, CASE WHEN s.status = 'available' THEN '/history/' || CAST(h.history_id AS VARCHAR) || '/audio' END AS url, s.status AS blob_status FROM history h LEFT JOIN s ON s.history_id = h.history_id",
)
def jn_history_blob(spark: SparkSession, d: str) -> DataFrame:
    """Entries with the place of their recording in the blob store; retries share the blob of the entry that they repeat."""
    h = V.history(spark, d).withColumn("history_id", F.col("history_id").cast("string"))
    retry = F.col("retry_of").isNotNull()
    events = h.where(retry | F.col("duration_ms").isNotNull()).select(F.col("history_id").cast("bigint").alias("seq"), F.when(retry, "retry").otherwise("capture").alias("kind"), "history_id", F.col("retry_of").cast("string").alias("of"), F.when(~retry, F.col("duration_ms")).alias("size_bytes"), F.lit("audio").alias("filename"))
    state = blobs.after(blobs.entries(spark, "", -1), events, 250_000, 1 << 60)
    return blobs.public(h.select("history_id", "mode"), state)


_HEADER = "CASE conv_id % 5 WHEN 0 THEN ' OFF ' WHEN 1 THEN '0' WHEN 2 THEN 'false' WHEN 3 THEN NULL ELSE 'on' END"


@query("flt_repfilter_switch", f"SELECT conv_id, turn, h IS NULL OR lower(trim(h)) <> 'off' AS filters, h IS NULL OR lower(trim(h)) NOT IN ('off', '0', 'false', 'no') AS gates FROM (SELECT conv_id, turn, {_HEADER} AS h FROM conversations)")
def flt_repfilter_switch(spark: SparkSession, d: str) -> DataFrame:
    c = V.table(spark, d, "conversations").withColumn("h", F.expr(_HEADER))
    return c.select("conv_id", "turn", R.filter_enabled(F.col("h")).alias("filters"), R.gate_enabled(F.col("h")).alias("gates"))


@query("flt_lang_applies", "SELECT doc_id, doc_id % 3 <> 0 AND CASE WHEN doc_id % 2 = 0 THEN 'cohere' ELSE 'other' END = 'cohere' AND lower(trim(coalesce(CASE WHEN lang = 'en' THEN ' Auto' WHEN lang = 'de' THEN NULL ELSE lang END, ''))) IN ('', 'auto') AS applies FROM documents")
def flt_lang_applies(spark: SparkSession, d: str) -> DataFrame:
    asked = F.when(F.col("lang") == "en", " Auto").when(F.col("lang") == "de", None).otherwise(F.col("lang"))
    backend = F.when(F.col("doc_id") % 2 == 0, "cohere").otherwise("other")
    return V.table(spark, d, "documents").select("doc_id", R.detection_applies(backend, asked, F.col("doc_id") % 3 != 0).alias("applies"))


@query("flt_session", "SELECT o_orderkey AS session_id FROM orders WHERE o_orderkey % 7 = 0 OR CAST(o_orderdate AS TIMESTAMP) >= TIMESTAMP '1996-01-01 00:00:00'")
def flt_session(spark: SparkSession, d: str) -> DataFrame:
    """Orders as sessions that expire on their date; every seventh has no readable one."""
    o = V.table(spark, d, "orders")
    at = F.when(F.col("o_orderkey") % 7 == 0, "soon").otherwise(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"))
    return R.live_sessions(o.select(F.col("o_orderkey").alias("session_id"), at.alias("expires_at")), F.lit("1996-01-01 00:00:00").cast("timestamp")).select("session_id")


@query("prj_card", "SELECT p_partkey, CASE WHEN abs(p_size * 1000 - 24000) <= 2048 THEN 'large' WHEN abs(p_size * 1000 - 22500) <= 2048 THEN 'middle' WHEN abs(p_size * 1000 - 8000) <= 2048 THEN 'small' END AS card FROM part")
def prj_card(spark: SparkSession, d: str) -> DataFrame:
    cards = spark.createDataFrame([(0, "large", 24_000), (1, "middle", 22_500), (2, "small", 8_000)], "card_idx int, card string, target_mib int")
    return R.matched_cards(V.table(spark, d, "part").select("p_partkey", (F.col("p_size") * 1000).alias("total_mib")), cards).select("p_partkey", "card")


@query("prj_form_merge", "SELECT CAST(coalesce(c_custkey, s_suppkey) AS VARCHAR) AS name, CASE WHEN c_custkey IS NOT NULL AND c_custkey % 3 = 0 THEN 'typed' WHEN s_suppkey IS NOT NULL THEN 'service' ELSE 'base' END AS value FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
def prj_form_merge(spark: SparkSession, d: str) -> DataFrame:
    """Customers' settings, of which a third was typed anew, and the service's after its model changed."""
    c, s = V.table(spark, d, "customer"), V.table(spark, d, "supplier")
    name = F.col("c_custkey").cast("string").alias("name")
    typed = c.select(name, F.when(F.col("c_custkey") % 3 == 0, "typed").otherwise("base").alias("value"))
    return R.merged_forms(typed, c.select(name, F.lit("base").alias("value")), s.select(F.col("s_suppkey").cast("string").alias("name"), F.lit("service").alias("value")), F.lit(True))


@query("snk_formats", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '{\"text\":\"' || CAST(conv_id AS VARCHAR) || '\"}' WHEN 1 THEN CAST(conv_id AS VARCHAR) ELSE '{\"duration\":' || CAST(CAST(turn * 500 AS DOUBLE) / 1000 AS VARCHAR) || ',\"text\":\"' || CAST(conv_id AS VARCHAR) || '\"}' END AS body FROM conversations")
def snk_formats(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("turn") % 3 == 0, "json").when(F.col("turn") % 3 == 1, "text").otherwise("verbose_json")
    return V.table(spark, d, "conversations").select("conv_id", "turn", R.response(F.col("conv_id").cast("string"), F.col("turn") * 500, kind).alias("body"))
