"""Registered queries: folds, window gates, evidence votes, kinds and counts; with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import folds as D
from tidemark.operators import intervals as I
from tidemark.operators import joins as J
from tidemark.sources import views as V
from tidemark.sources.views import SQL as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


@query(
    "hist_quota",
    f"WITH RECURSIVE {S['history']}, r AS (SELECT key_id, history_id, duration_ms, row_number() OVER (PARTITION BY key_id ORDER BY history_id) AS k FROM history WHERE duration_ms IS NOT NULL), "
    "f AS (SELECT key_id, k, history_id, CASE WHEN duration_ms <= 400000 AND duration_ms <= 900000 THEN duration_ms ELSE 0 END AS used, duration_ms <= 400000 AND duration_ms <= 900000 AS admitted FROM r WHERE k = 1 UNION ALL "
    "SELECT r.key_id, r.k, r.history_id, f.used + CASE WHEN r.duration_ms <= 400000 AND f.used + r.duration_ms <= 900000 THEN r.duration_ms ELSE 0 END, r.duration_ms <= 400000 AND f.used + r.duration_ms <= 900000 FROM f JOIN r ON r.key_id = f.key_id AND r.k = f.k + 1) SELECT key_id, history_id, admitted FROM f",
)
def hist_quota(spark: SparkSession, d: str) -> DataFrame:
    return D.quota(V.history(spark, d).where("duration_ms is not null"), ["key_id"], "history_id", "duration_ms", 400_000, 900_000)


@query(
    "win_detect_units",
    f"WITH RECURSIVE {S['turn']}, r AS (SELECT recording_id, turn_idx, start_ms, least(end_ms, start_ms + turn_idx % 4 * 900 + 100) AS end_ms, row_number() OVER (PARTITION BY recording_id ORDER BY start_ms, least(end_ms, start_ms + turn_idx % 4 * 900 + 100), turn_idx) AS k FROM turn), "
    "f AS (SELECT recording_id, k, turn_idx, CAST(0 AS BIGINT) AS unit, end_ms - start_ms < 1500 AS open, end_ms - start_ms AS speech, start_ms AS began FROM r WHERE k = 1 UNION ALL "
    "SELECT r.recording_id, r.k, r.turn_idx, CASE WHEN j THEN f.unit ELSE f.unit + 1 END, r.end_ms - r.start_ms < 1500, CASE WHEN j THEN f.speech ELSE 0 END + r.end_ms - r.start_ms, CASE WHEN j THEN f.began ELSE r.start_ms END FROM f JOIN r ON r.recording_id = f.recording_id AND r.k = f.k + 1, LATERAL (SELECT r.end_ms - r.start_ms < 1500 AND f.open AND f.speech < 8000 AND r.end_ms - f.began <= 900000 AS j)) SELECT recording_id, turn_idx AS piece_idx, unit FROM f",
)
def win_detect_units(spark: SparkSession, d: str) -> DataFrame:
    t = V.turn(spark, d).select("recording_id", F.col("turn_idx").alias("piece_idx"), "start_ms", F.least("end_ms", F.col("start_ms") + F.col("turn_idx") % 4 * 900 + 100).alias("end_ms"))
    return D.detection_units(t, span=900_000)


@query("ivl_lid_budget", f"WITH {S['turn']}, r AS (SELECT *, coalesce(sum(end_ms - start_ms) OVER (PARTITION BY recording_id, speaker_id ORDER BY end_ms - start_ms DESC, turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM turn) SELECT recording_id, speaker_id, turn_idx, start_ms, CAST(least(end_ms, start_ms + 600000 - used) AS BIGINT) AS end_ms FROM r WHERE used < 600000")
def ivl_lid_budget(spark: SparkSession, d: str) -> DataFrame:
    """Longest turns of each speaker up to ten minutes."""
    t = V.turn(spark, d).withColumn("rank", F.struct((F.col("start_ms") - F.col("end_ms")).alias("l"), F.col("turn_idx").alias("i")))
    return D.budget(t, ["recording_id", "speaker_id"], "rank", 600_000).select("recording_id", "speaker_id", "turn_idx", "start_ms", "end_ms")


@query("ivl_stitch", f"WITH {S['turn']}, p AS (SELECT *, sum(end_ms - start_ms) OVER (PARTITION BY recording_id, speaker_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS b FROM turn WHERE end_ms > start_ms), w AS (SELECT *, unnest(range(CAST((b - (end_ms - start_ms)) // 3000 AS BIGINT), CAST((b - 1) // 3000 AS BIGINT) + 1)) AS win FROM p) SELECT recording_id, speaker_id, win AS \"window\", CAST(sum(least(b, (win + 1) * 3000) - greatest(b - (end_ms - start_ms), win * 3000)) AS BIGINT) AS length, count(*) AS sources FROM w GROUP BY ALL HAVING sum(least(b, (win + 1) * 3000) - greatest(b - (end_ms - start_ms), win * 3000)) >= 2000")
def ivl_stitch(spark: SparkSession, d: str) -> DataFrame:
    return D.stitch(V.turn(spark, d), ["recording_id", "speaker_id"])


@query("flt_quality", f"WITH {S['frame']} SELECT recording_id, frame_idx, rms > pow(10, -2.5) AS loud, round(least(greatest(rms / 0.08, 0.4), 1.0) * CASE WHEN frame_idx % 3 = 0 THEN 0.6 ELSE 1.0 END, 9) AS quality FROM frame")
def flt_quality(spark: SparkSession, d: str) -> DataFrame:
    """Windows louder than -50 dBFS, and their quality; every third counts as stitched."""
    q = F.least(F.greatest(F.col("rms") / 0.08, F.lit(0.4)), F.lit(1.0)) * F.when(F.col("frame_idx") % 3 == 0, 0.6).otherwise(1.0)
    return V.frame(spark, d).select("recording_id", "frame_idx", (F.col("rms") > 10**-2.5).alias("loud"), F.round(q, 9).alias("quality"))


@query(
    "flt_eligible",
    f"WITH {S['overlap']}, w AS (SELECT recording_id, turn_idx AS window_idx, speaker_id, start_ms + 100 AS start_ms, end_ms - 100 AS end_ms FROM turn WHERE end_ms - start_ms - 200 >= 2000), h AS (SELECT w.recording_id, w.window_idx, count(*) AS n FROM w JOIN turn t ON t.recording_id = w.recording_id AND t.speaker_id = w.speaker_id AND t.start_ms <= w.start_ms AND w.end_ms <= t.end_ms GROUP BY ALL) "
    "SELECT w.recording_id, w.window_idx FROM w JOIN h USING (recording_id, window_idx) WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM overlap o WHERE o.recording_id = w.recording_id AND o.end_ms > w.start_ms AND o.start_ms < w.end_ms)",
)
def flt_eligible(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 2 s or more in exactly one turn of their speaker and in no overlap."""
    t = V.turn(spark, d)
    w = t.select("recording_id", F.col("turn_idx").alias("window_idx"), "speaker_id", (F.col("start_ms") + 100).alias("start_ms"), (F.col("end_ms") - 100).alias("end_ms")).where("end_ms - start_ms >= 2000")
    sole = J.sole_container(w, t).where("turn_idx is not null")
    return J.overlaps(sole, V.overlap(spark, d), "window_idx").where("not has_overlap").select("recording_id", "window_idx")


@query("vf_plan", f"WITH {S['turn']} SELECT recording_id, turn_idx, start_ms + t AS start_ms, end_ms - t AS end_ms FROM (SELECT *, CASE WHEN end_ms - start_ms >= 1200 THEN 250 ELSE 0 END AS t FROM turn) WHERE end_ms - start_ms - 2 * t >= 150")
def vf_plan(spark: SparkSession, d: str) -> DataFrame:
    """Sentences trimmed at both ends where they are long enough; very short ones dropped."""
    trim = F.when(F.col("end_ms") - F.col("start_ms") >= 1200, 250).otherwise(0)
    return V.turn(spark, d).select("recording_id", "turn_idx", (F.col("start_ms") + trim).alias("start_ms"), (F.col("end_ms") - trim).alias("end_ms")).where("end_ms - start_ms >= 150")


@query(
    "jn_lang_at",
    f"WITH {S['word']}, sp AS (SELECT recording_id, turn_idx, start_ms, end_ms, CASE WHEN turn_idx % 2 = 0 THEN 'de' ELSE 'en' END AS language FROM turn WHERE kind = 'error'), m AS (SELECT w.recording_id, w.word_idx, sp.language, sp.turn_idx, CAST(round(w.t0 * 1000) AS BIGINT) AS moment, sp.start_ms AS s, sp.end_ms AS e FROM word w LEFT JOIN sp ON sp.recording_id = w.recording_id) SELECT recording_id, word_idx, language FROM m QUALIFY row_number() OVER (PARTITION BY recording_id, word_idx ORDER BY CASE WHEN s <= moment AND moment <= e THEN 0 ELSE 1 END, CASE WHEN moment < s THEN s - moment ELSE greatest(0, moment - e) END, turn_idx) = 1",
)
def jn_lang_at(spark: SparkSession, d: str) -> DataFrame:
    language = F.when(F.col("turn_idx") % 2 == 0, "de").otherwise("en")
    w = V.word(spark, d).withColumn("at", F.round(F.col("t0") * 1000).cast("bigint"))
    return J.nearest(w, "at", "word_idx", V.turn(spark, d).where("kind = 'error'").withColumn("language", language), "turn_idx", "language").select("recording_id", "word_idx", "language")


@query("agg_span_score", f"WITH {S['overlap']}, m AS (SELECT t.recording_id, t.turn_idx, least(t.end_ms, o.end_ms) - greatest(t.start_ms, o.start_ms) AS ov, (t.turn_idx % 10) / 10.0::DOUBLE AS q FROM turn t JOIN overlap o ON o.recording_id = t.recording_id AND o.end_ms > t.start_ms AND o.start_ms < t.end_ms AND t.end_ms > t.start_ms) SELECT recording_id, round(sum(q * ov) / sum(ov), 6) AS quality, CAST(sum(ov) AS BIGINT) AS overlap_ms FROM m GROUP BY ALL")
def agg_span_score(spark: SparkSession, d: str) -> DataFrame:
    """The mean quality of a recording's turns, weighted by how long they lie in overlaps."""
    t = I.coverage_pairs(V.turn(spark, d), V.overlap(spark, d)).withColumn("q", F.col("turn_idx") % 10 / 10.0)
    return t.groupBy("recording_id").agg(F.round(F.sum(F.col("q") * F.col("shared")) / F.sum("shared"), 6).alias("quality"), F.sum("shared").alias("overlap_ms"))


_CENTRAL = f"{S['sample']}, pt AS (SELECT recording_id, speaker_id, weight, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM sample), mn AS (SELECT recording_id, speaker_id, i, sum(weight * x) / sum(weight) AS m FROM pt GROUP BY ALL), pv AS (SELECT recording_id, speaker_id, list(m ORDER BY i) AS v FROM mn GROUP BY ALL)"


@query("flt_listen", f"WITH {_CENTRAL}, c AS (SELECT s.recording_id, s.speaker_id, s.sample_idx, s.quality, list_cosine_similarity(s.vector, p.v) AS c FROM sample s JOIN pv p ON p.recording_id = s.recording_id AND p.speaker_id = s.speaker_id WHERE s.quality >= 0.6) SELECT recording_id, speaker_id, sample_idx, round(c, 6) AS centrality FROM c QUALIFY row_number() OVER (PARTITION BY recording_id, speaker_id ORDER BY c DESC, quality DESC, sample_idx) <= 3")
def flt_listen(spark: SparkSession, d: str) -> DataFrame:
    """The three windows of each speaker nearest to its prototype, among those of good quality."""
    from pyspark.sql import Window as W

    from tidemark.operators import aggregates as A

    s = V.sample(spark, d)
    p = A.weighted_mean_vector(s, ["recording_id", "speaker_id"])
    c = s.where("quality >= 0.6").join(p, ["recording_id", "speaker_id"]).withColumn("c", A.dot(F.col("vector"), F.col("prototype")))
    w = W.partitionBy("recording_id", "speaker_id").orderBy(F.desc("c"), F.desc("quality"), "sample_idx")
    return c.withColumn("r", F.row_number().over(w)).where("r <= 3").select("recording_id", "speaker_id", "sample_idx", F.round("c", 6).alias("centrality"))


@query("agg_core_matrix", f"WITH {_CENTRAL} SELECT a.recording_id, a.speaker_id AS one, b.speaker_id AS other, round(list_cosine_similarity(a.v, b.v), 3) + 0.0 AS cosine FROM pv a JOIN pv b ON a.recording_id = b.recording_id AND a.speaker_id < b.speaker_id")
def agg_core_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Cosines of the speakers' prototypes within a recording: pairs of speakers, of which a recording has few."""
    from tidemark.operators import aggregates as A

    p = A.weighted_mean_vector(V.sample(spark, d), ["recording_id", "speaker_id"])
    a, b = p.select("recording_id", F.col("speaker_id").alias("one"), F.col("prototype").alias("x")), p.select("recording_id", F.col("speaker_id").alias("other"), F.col("prototype").alias("y"))
    return a.join(b, "recording_id").where("one < other").select("recording_id", "one", "other", (F.round(A.dot(F.col("x"), F.col("y")), 3) + 0.0).alias("cosine"))


@query("set_equal_speakers", f"WITH {S['turn']}, a AS (SELECT recording_id, list_sort(list(DISTINCT speaker_id)) AS s FROM turn GROUP BY ALL), b AS (SELECT recording_id, list_sort(list(DISTINCT speaker_id)) AS s FROM turn WHERE end_ms - start_ms >= 150 GROUP BY ALL) SELECT a.recording_id, coalesce(a.s = b.s, false) AS same FROM a LEFT JOIN b USING (recording_id)")
def set_equal_speakers(spark: SparkSession, d: str) -> DataFrame:
    """Whether a recording has the same speakers after ghosts are gone."""
    t = V.turn(spark, d).groupBy("recording_id").agg(F.array_sort(F.collect_set("speaker_id")).alias("a"), F.array_sort(F.collect_set(F.when(F.col("end_ms") - F.col("start_ms") >= 150, F.col("speaker_id")))).alias("b"))
    return t.select("recording_id", (F.col("a") == F.col("b")).alias("same"))
