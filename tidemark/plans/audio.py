"""Registered queries on pieces of speech and listening samples, with their DuckDB SQL.

Regions are a recording's turns merged over pauses of ten minutes; a frame is a minute, its energy the least of its events. The PCM of a recording of vectors is its vectors, each
three seconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import audio as U
from tidemark.operators import intervals as I
from tidemark.operators import listening as Q
from tidemark.plans.assembly import _windows
from tidemark.sources import views as V
from tidemark.sources.views import SQL as S

MOST, SEARCH, FRAME = 3600.0, 600.0, 60.0


def _minutes(spark: SparkSession, d: str) -> DataFrame:
    t = V.turn(spark, d)
    return t.groupBy("recording_id", F.floor(F.col("start_ms") / 60_000).alias("frame_idx")).agg(F.min(F.col("end_ms") - F.col("start_ms")).cast("double").alias("energy"))


def _regions(spark: SparkSession, d: str) -> DataFrame:
    r = I.union(V.turn(spark, d), gap=600_000)
    return r.select("recording_id", F.col("start_ms").alias("region_ms"), (F.col("start_ms") / 1000).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"))


def ivl_region_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Regions in parts of at most an hour, cut at the quietest minute within ten of each even place."""
    p = U.quiet_pieces(_regions(spark, d), _minutes(spark, d), "region_ms", MOST, SEARCH, FRAME)
    return p.select("recording_id", "region_ms", "piece", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


def rp_assets(spark: SparkSession, d: str) -> DataFrame:
    """Each speaker's listening sample of its windows, or of its turns, cut out of the recording's PCM."""
    w = _windows(spark, d)
    pieces = Q.snippets(w).withColumn("tier", F.lit("clean"))
    weak = w.join(pieces.select(*Q.WHO).distinct(), Q.WHO, "left_anti").withColumn("turn_idx", F.col("start_ms"))
    pieces = pieces.unionByName(Q.longest_turns(weak).select(*Q.WHO, "start_ms", "end_ms").withColumns({"tier": F.lit("turns_fallback"), "centrality": F.lit(0.0)}))
    start = F.min("start_ms").over(U.W.partitionBy("recording_id"))
    own = V.sample(spark, d).withColumn("_at", start)
    # places within the recording, which begins with its first vector
    pieces = pieces.join(own.select("recording_id", "_at").distinct(), "recording_id").withColumns({"start_ms": F.col("start_ms") - F.col("_at"), "end_ms": F.col("end_ms") - F.col("_at")}).drop("_at")
    chunks = U.chunked_by_rows(own.select("recording_id", "sample_idx", F.transform("vector", lambda x: x.cast("float")).alias("vector")), "sample_idx", "vector", 64)
    return U.listening_assets(pieces, chunks, 64, 64 / 3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"ivl_region_pieces": ivl_region_pieces, "rp_assets": rp_assets}
ORACLE_SQL: dict[str, str] = {
    "ivl_region_pieces": f"""WITH {S['turn']}, i AS (SELECT *, CASE WHEN start_ms > max(end_ms) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 600000 THEN 1 ELSE 0 END AS new FROM turn WHERE end_ms > start_ms),
j AS (SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM i),
r AS (SELECT recording_id, min(start_ms) AS region_ms, min(start_ms) / 1000 AS a, max(end_ms) / 1000 AS b FROM j GROUP BY recording_id, island),
f AS (SELECT recording_id, start_ms // 60000 AS k, min(end_ms - start_ms) AS energy FROM turn GROUP BY ALL),
n AS (SELECT *, CASE WHEN b - a <= {MOST} THEN 1 ELSE greatest(1, CAST(ceil((b - a) / {MOST - 2 * SEARCH} - 1e-9) AS BIGINT)) END AS n FROM r),
c AS (SELECT recording_id, region_ms, p, a + p * (b - a) / n AS even FROM n, range(1, n.n) s(p)),
q AS (SELECT c.*, (f.k + 0.5) * {FRAME} AS moment FROM c LEFT JOIN f ON f.recording_id = c.recording_id AND f.k * {FRAME} >= c.even - {SEARCH} - 1e-7 AND (f.k + 1) * {FRAME} <= c.even + {SEARCH} + 1e-7
  QUALIFY row_number() OVER (PARTITION BY c.recording_id, c.region_ms, c.p ORDER BY f.energy NULLS LAST, round(abs((f.k + 0.5) * {FRAME} - c.even), 6), f.k) = 1),
e AS (SELECT recording_id, region_ms, p, coalesce(moment, even) AS t FROM q UNION ALL SELECT recording_id, region_ms, 0, a FROM n UNION ALL SELECT recording_id, region_ms, n, b FROM n)
SELECT recording_id, region_ms, p AS piece, round(t, 6) AS start_s, round(lead(t) OVER w, 6) AS end_s FROM e WINDOW w AS (PARTITION BY recording_id, region_ms ORDER BY p) QUALIFY lead(t) OVER w IS NOT NULL"""
}
