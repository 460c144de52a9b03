"""Registered queries on snapshots of models and diagnostics of chunks, with their DuckDB SQL.

A supplier is a model, its line items are the files of nine snapshots, and flag, status and line number are a file's path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import intervals as I
from tidemark.operators import snapshots as K
from tidemark.sources import views as V
from tidemark.sources.views import SQL as S

ALL_OF, ANY_OF = ("A-F-1", "N-O-2"), (("R-F-1", "R-F-2"), ("N-F-3", "N-O-4", "A-F-5"))


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    names = lambda x: F.array(*map(F.lit, x))
    required = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("model_id"), names(ALL_OF).alias("all_of"), F.array(*map(names, ANY_OF)).alias("any_of"))
    files = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("model_id"), (F.col("l_orderkey") % 9).cast("string").alias("revision"), F.concat_ws("-", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("path"), (F.col("l_quantity") * 1_000_000).cast("bigint").alias("bytes"))
    return required, files


_SNAP = "f AS (SELECT l_suppkey AS model_id, CAST(l_orderkey % 9 AS VARCHAR) AS revision, l_returnflag || '-' || l_linestatus || '-' || l_linenumber AS path, CAST(l_quantity * 1000000 AS BIGINT) AS bytes FROM lineitem), sn AS (SELECT model_id, revision, CAST(sum(bytes) AS BIGINT) AS bytes, bool_or(path = 'A-F-1') AND bool_or(path = 'N-O-2') AND bool_or(path IN ('R-F-1', 'R-F-2')) AND bool_or(path IN ('N-F-3', 'N-O-4', 'A-F-5')) AS complete FROM f SEMI JOIN supplier ON s_suppkey = f.model_id GROUP BY ALL)"


def src_snapshot(spark: SparkSession, d: str) -> DataFrame:
    required, files = _tables(spark, d)
    return K.complete_snapshots(files, required)


def src_model_cache(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' nations say what their jobs do; the main revision is 4."""
    required, files = _tables(spark, d)
    job = F.when(F.col("s_nationkey") % 6 == 0, "downloading").when(F.col("s_nationkey") % 6 == 1, "error")
    jobs = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("model_id"), job.alias("job"), F.lit("no access").alias("error"))
    files = files.where("model_id % 7 != 3 or path not like 'A-%'").where("model_id % 11 != 5")  # some models lack files, some have none
    return K.model_statuses(required, files, required.select("model_id", F.lit("4").alias("main")), jobs)


def agg_chunk_diag(spark: SparkSession, d: str) -> DataFrame:
    """Turns merged over pauses of a minute are regions, turns are chunks whose kind stands for the language."""
    t = V.turn(spark, d)
    k = K.chunk_diagnostics(I.union(t, gap=60_000), t.select("recording_id", F.col("kind").alias("language")), V.word(spark, d))
    return k.withColumn("superchunk_languages", F.array_join(F.transform("superchunk_languages", lambda x: F.concat(x["language"], F.lit("="), x["n"].cast("string"))), ","))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (src_snapshot, src_model_cache, agg_chunk_diag)}
_UNION = "i AS (SELECT *, CASE WHEN start_ms > max(end_ms) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 60000 THEN 1 ELSE 0 END AS new FROM turn WHERE end_ms > start_ms), j AS (SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM i), r AS (SELECT recording_id, max(end_ms) - min(start_ms) AS len FROM j GROUP BY recording_id, island)"
ORACLE_SQL: dict[str, str] = {
    "src_snapshot": f"WITH {_SNAP} SELECT * FROM sn",
    "src_model_cache": f"WITH {_SNAP.replace('FROM lineitem)', "FROM lineitem WHERE (l_suppkey % 7 <> 3 OR l_returnflag <> 'A') AND l_suppkey % 11 <> 5)")}, b AS (SELECT model_id, sum(bytes) AS total, arg_min({{'revision': revision, 'bytes': bytes}}, CASE WHEN revision = '4' THEN '0' ELSE '1' END || revision) FILTER (complete) AS best FROM sn GROUP BY ALL) "
    "SELECT s_suppkey AS model_id, CASE WHEN s_nationkey % 6 = 0 THEN 'downloading' WHEN b.best IS NOT NULL THEN 'ready' WHEN s_nationkey % 6 = 1 THEN 'error' WHEN b.total IS NOT NULL THEN 'partial' ELSE 'missing' END AS status, b.best.revision AS revision, round_even(CAST(coalesce(b.best.bytes, b.total) AS DOUBLE) / 1073741824, 2) AS gb, CASE WHEN s_nationkey % 6 = 1 THEN 'no access' END AS error FROM supplier LEFT JOIN b ON b.model_id = s_suppkey",
    "agg_chunk_diag": f"WITH {S['word']}, {_UNION}, a AS (SELECT recording_id, count(*) AS speech_regions, round_even(sum(len) / 1000, 1) AS speech_seconds FROM r GROUP BY ALL), k AS (SELECT recording_id, kind, count(*) AS n FROM turn GROUP BY ALL), b AS (SELECT recording_id, CAST(sum(n) AS BIGINT) AS superchunks, string_agg(kind || '=' || n, ',' ORDER BY kind) AS superchunk_languages FROM k GROUP BY ALL), c AS (SELECT recording_id, count(*) AS words_aligned FROM word GROUP BY ALL) "
    "SELECT a.recording_id, speech_regions, speech_seconds, superchunks, superchunk_languages, coalesce(words_aligned, 0) AS words_aligned FROM a JOIN b USING (recording_id) LEFT JOIN c USING (recording_id)",
}
