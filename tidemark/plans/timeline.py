"""Registered queries on turns, words and frames: intervals, joins, window functions; with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import aggregates as A
from tidemark.operators import folds as D
from tidemark.operators import intervals as I
from tidemark.operators import joins as J
from tidemark.operators import ranking as R
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


def _island_sql(source: str, keys: str = "recording_id", start: str = "start_ms", end: str = "end_ms", gap: str = "0") -> str:
    return (
        f"i1 AS (SELECT *, CASE WHEN {start} <= max({end}) OVER (PARTITION BY {keys} ORDER BY {start}, {end} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS new FROM {source} WHERE {end} > {start}), "
        f"i2 AS (SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY {start}, {end} ROWS UNBOUNDED PRECEDING) AS island FROM i1), "
        f"isl AS (SELECT {keys}, min({start}) AS {start}, max({end}) AS {end}, count(*) AS merged_from FROM i2 GROUP BY {keys}, island)"
    )


@query("flt_ghost", f"WITH {S['turn']} SELECT recording_id, turn_idx, start_ms, end_ms, speaker_id FROM turn WHERE end_ms - start_ms >= 150")
def flt_ghost(spark: SparkSession, d: str) -> DataFrame:
    return V.turn(spark, d).where("end_ms - start_ms >= 150").drop("kind")


@query("flt_margin", f"WITH {S['turn']} SELECT recording_id, turn_idx, start_ms + 200 AS start_ms, end_ms - 200 AS end_ms FROM turn WHERE end_ms - 200 > start_ms + 200")
def flt_margin(spark: SparkSession, d: str) -> DataFrame:
    return V.turn(spark, d).select("recording_id", "turn_idx", (F.col("start_ms") + 200).alias("start_ms"), (F.col("end_ms") - 200).alias("end_ms")).where("end_ms > start_ms")


@query("src_dia_normalize", f"WITH {S['turn']} SELECT recording_id, turn_idx, greatest(start_ms, 0) AS start_ms, least(end_ms, 86000000) AS end_ms, speaker_id FROM turn WHERE speaker_id <> '' AND least(end_ms, 86000000) > greatest(start_ms, 0)")
def src_dia_normalize(spark: SparkSession, d: str) -> DataFrame:
    t = V.turn(spark, d).withColumns({"start_ms": F.greatest("start_ms", F.lit(0)), "end_ms": F.least("end_ms", F.lit(86_000_000))})
    return t.where("speaker_id <> '' and end_ms > start_ms").drop("kind")


@query("ivl_union", f"WITH {S['turn']}, {_island_sql('turn', 'recording_id, speaker_id')} SELECT * FROM isl")
def ivl_union(spark: SparkSession, d: str) -> DataFrame:
    return I.union(V.turn(spark, d), ["recording_id", "speaker_id"])


@query("ivl_union_gap", f"WITH {S['turn']}, {_island_sql('turn', gap='300')} SELECT * FROM isl")
def ivl_union_gap(spark: SparkSession, d: str) -> DataFrame:
    return I.union(V.turn(spark, d), gap=300)


@query(
    "ivl_subtract",
    f"WITH {S['overlap']}, {_island_sql('overlap')}, c AS (SELECT t.recording_id, t.turn_idx, t.start_ms AS a, t.end_ms AS b, i.start_ms AS s, i.end_ms AS e FROM turn t LEFT JOIN isl i ON i.recording_id = t.recording_id AND i.end_ms > t.start_ms AND i.start_ms < t.end_ms), "
    "g AS (SELECT recording_id, turn_idx, coalesce(lag(e) OVER (PARTITION BY recording_id, turn_idx ORDER BY s), a) AS start_ms, coalesce(s, b) AS end_ms FROM c UNION ALL SELECT recording_id, turn_idx, max(e), any_value(b) FROM c WHERE e IS NOT NULL GROUP BY ALL) SELECT * FROM g WHERE end_ms > start_ms",
)
def ivl_subtract(spark: SparkSession, d: str) -> DataFrame:
    t = V.turn(spark, d).select("recording_id", "turn_idx", "start_ms", "end_ms")
    return I.subtract(t, V.overlap(spark, d), ["recording_id", "turn_idx"], ["recording_id"])


@query("ivl_pad", f"WITH {S['turn']} SELECT recording_id, turn_idx, greatest(start_ms - 250, 0) AS start_ms, least(end_ms + 250, 86400000) AS end_ms FROM turn")
def ivl_pad(spark: SparkSession, d: str) -> DataFrame:
    return I.pad(V.turn(spark, d).select("recording_id", "turn_idx", "start_ms", "end_ms"), 250, 86_400_000)


@query("ivl_seconds", f"WITH {S['turn']} SELECT recording_id, speaker_id, sum(end_ms - start_ms) / 1000 AS seconds FROM turn GROUP BY ALL")
def ivl_seconds(spark: SparkSession, d: str) -> DataFrame:
    return I.seconds(V.turn(spark, d), ["recording_id", "speaker_id"])


_COVER = f"{S['overlap']}, cl AS (SELECT t.recording_id, t.turn_idx, greatest(t.start_ms, o.start_ms) AS start_ms, least(t.end_ms, o.end_ms) AS end_ms FROM turn t JOIN overlap o ON o.recording_id = t.recording_id), {_island_sql('cl', 'recording_id, turn_idx')}, cv AS (SELECT recording_id, turn_idx, CAST(sum(end_ms - start_ms) AS BIGINT) AS covered FROM isl GROUP BY ALL)"


@query("ivl_coverage", f"WITH {_COVER} SELECT t.recording_id, t.turn_idx, coalesce(covered, 0) AS covered FROM turn t LEFT JOIN cv USING (recording_id, turn_idx)")
def ivl_coverage(spark: SparkSession, d: str) -> DataFrame:
    return I.coverage(V.overlap(spark, d), V.turn(spark, d), ["recording_id", "turn_idx"]).select("recording_id", "turn_idx", "covered")


@query("ivl_full_cover", f"WITH {_COVER} SELECT t.recording_id, t.turn_idx, t.end_ms > t.start_ms AND coalesce(covered, 0) >= t.end_ms - t.start_ms AS fully_covered FROM turn t LEFT JOIN cv USING (recording_id, turn_idx)")
def ivl_full_cover(spark: SparkSession, d: str) -> DataFrame:
    t = I.coverage(V.overlap(spark, d), V.turn(spark, d), ["recording_id", "turn_idx"])
    return t.select("recording_id", "turn_idx", ((F.col("end_ms") > F.col("start_ms")) & (F.col("covered") >= F.col("end_ms") - F.col("start_ms"))).alias("fully_covered"))


def _remerge_sql(gap: int, least: int) -> str:
    return (
        f"{S['turn']}, t1 AS (SELECT *, CASE WHEN lag(speaker_id) OVER w = speaker_id THEN 0 ELSE 1 END AS change FROM turn WHERE end_ms - start_ms >= {least} WINDOW w AS (PARTITION BY recording_id ORDER BY start_ms, end_ms, speaker_id, turn_idx)), "
        "t2 AS (SELECT *, sum(change) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms, speaker_id, turn_idx ROWS UNBOUNDED PRECEDING) AS run FROM t1), "
        f"t3 AS (SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY recording_id, run ORDER BY start_ms, end_ms, turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS new FROM t2), "
        "t4 AS (SELECT *, sum(new) OVER (PARTITION BY recording_id, run ORDER BY start_ms, end_ms, turn_idx ROWS UNBOUNDED PRECEDING) AS island FROM t3), "
        "gated AS (SELECT recording_id, speaker_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS merged_from FROM t4 GROUP BY recording_id, speaker_id, run, island)"
    )


@query("ivl_remerge", f"WITH {_remerge_sql(400, 150)} SELECT * FROM gated")
def ivl_remerge(spark: SparkSession, d: str) -> DataFrame:
    return I.remerge(V.turn(spark, d))


@query("ivl_merge_turns", f"WITH {_remerge_sql(250, 0)} SELECT * FROM gated")
def ivl_merge_turns(spark: SparkSession, d: str) -> DataFrame:
    return I.remerge(V.turn(spark, d), 250, 0)


@query("speaker_time", f"WITH {_remerge_sql(400, 150)} SELECT recording_id, speaker_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS speech_ms, count(*) AS turns, CAST(sum(merged_from) AS BIGINT) AS source_turns FROM gated GROUP BY ALL")
def speaker_time(spark: SparkSession, d: str) -> DataFrame:
    """Who spoke, for how long, after gating."""
    gated = I.remerge(V.turn(spark, d))
    return gated.groupBy("recording_id", "speaker_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"), F.count("*").alias("turns"), F.sum("merged_from").alias("source_turns"))


@query("agg_gate_diag", f"WITH {_remerge_sql(400, 150)}, a AS (SELECT recording_id, count(*) AS input, count(*) FILTER (end_ms - start_ms < 150) AS dropped FROM turn GROUP BY ALL), b AS (SELECT recording_id, count(*) AS output, CAST(sum(merged_from - 1) AS BIGINT) AS remerged FROM gated GROUP BY ALL) SELECT a.*, coalesce(output, 0) AS output, coalesce(remerged, 0) AS remerged FROM a LEFT JOIN b USING (recording_id)")
def agg_gate_diag(spark: SparkSession, d: str) -> DataFrame:
    t = V.turn(spark, d)
    return A.gate_diagnostics(t, I.remerge(t))


@query(
    "ivl_superchunk",
    f"WITH RECURSIVE {S['turn']}, r AS (SELECT recording_id, start_ms, end_ms, row_number() OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms) AS k FROM turn), "
    "f AS (SELECT recording_id, k, start_ms AS s, end_ms AS e, 0 AS chunk_idx FROM r WHERE k = 1 UNION ALL SELECT r.recording_id, r.k, CASE WHEN r.end_ms - f.s <= 600000 THEN f.s ELSE r.start_ms END, r.end_ms, f.chunk_idx + CASE WHEN r.end_ms - f.s <= 600000 THEN 0 ELSE 1 END FROM f JOIN r ON r.recording_id = f.recording_id AND r.k = f.k + 1) "
    "SELECT recording_id, CAST(chunk_idx AS BIGINT) AS chunk_idx, min(s) AS start_ms, max_by(e, k) AS end_ms, count(*) AS regions FROM f GROUP BY recording_id, chunk_idx",
)
def ivl_superchunk(spark: SparkSession, d: str) -> DataFrame:
    return D.superchunks(V.turn(spark, d), 600_000)


@query("ivl_fixed", f"WITH {S['turn']} SELECT recording_id, turn_idx, p AS piece, start_ms + p * 30000 AS start_ms, least(end_ms, start_ms + p * 30000 + 30000) AS end_ms FROM (SELECT *, unnest(range(0, CAST(ceil((end_ms - start_ms) / 30000) AS BIGINT))) AS p FROM turn WHERE end_ms > start_ms)")
def ivl_fixed(spark: SparkSession, d: str) -> DataFrame:
    return I.fixed(V.turn(spark, d), 30_000).select("recording_id", "turn_idx", "piece", "start_ms", "end_ms")


@query("ivl_whisper", f"WITH {S['turn']} SELECT recording_id, turn_idx, p AS piece, start_ms + p * 29750 AS start_ms, least(end_ms, start_ms + p * 29750 + 30000) AS end_ms FROM (SELECT *, unnest(range(0, CASE WHEN end_ms - start_ms <= 30000 THEN 1 ELSE CAST(ceil((end_ms - start_ms - 30000) / 29750) AS BIGINT) + 1 END)) AS p FROM turn WHERE end_ms > start_ms)")
def ivl_whisper(spark: SparkSession, d: str) -> DataFrame:
    return I.fixed(V.turn(spark, d), 30_000, 29_750).select("recording_id", "turn_idx", "piece", "start_ms", "end_ms")


@query("ivl_equal_windows", f"WITH {S['turn']} SELECT recording_id, turn_idx, p AS piece, start_ms + CAST(floor((end_ms - start_ms) * p / n) AS BIGINT) AS start_ms, start_ms + CAST(floor((end_ms - start_ms) * (p + 1) / n) AS BIGINT) AS end_ms FROM (SELECT *, unnest(range(0, n)) AS p FROM (SELECT *, CAST(greatest(1, ceil((end_ms - start_ms) / 30000)) AS BIGINT) AS n FROM turn WHERE end_ms > start_ms))")
def ivl_equal_windows(spark: SparkSession, d: str) -> DataFrame:
    return I.equal(V.turn(spark, d), 30_000).select("recording_id", "turn_idx", "piece", "start_ms", "end_ms")


@query("ivl_voice3s", f"WITH {S['turn']}, p AS (SELECT recording_id, turn_idx, p AS piece, start_ms + p * 3000 AS start_ms, least(end_ms, start_ms + p * 3000 + 3000) AS end_ms FROM (SELECT *, unnest(range(0, CAST(ceil((end_ms - start_ms) / 3000) AS BIGINT))) AS p FROM turn WHERE end_ms - start_ms >= 2000)) SELECT * FROM p WHERE end_ms - start_ms >= 2000")
def ivl_voice3s(spark: SparkSession, d: str) -> DataFrame:
    return I.tumbling(V.turn(spark, d)).select("recording_id", "turn_idx", "piece", "start_ms", "end_ms")


@query(
    "ivl_plan_windows",
    f"WITH {S['overlap']}, sh AS (SELECT recording_id, speaker_id, turn_idx, start_ms + 200 AS start_ms, end_ms - 200 AS end_ms FROM turn WHERE end_ms - 200 > start_ms + 200), {_island_sql('overlap')}, c AS (SELECT t.recording_id, t.turn_idx, t.speaker_id, t.start_ms AS a, t.end_ms AS b, i.start_ms AS s, i.end_ms AS e FROM sh t LEFT JOIN isl i ON i.recording_id = t.recording_id AND i.end_ms > t.start_ms AND i.start_ms < t.end_ms), "
    "g AS (SELECT recording_id, turn_idx, speaker_id, coalesce(lag(e) OVER (PARTITION BY recording_id, turn_idx ORDER BY s), a) AS start_ms, coalesce(s, b) AS end_ms FROM c UNION ALL SELECT recording_id, turn_idx, speaker_id, max(e), any_value(b) FROM c WHERE e IS NOT NULL GROUP BY ALL), "
    "p AS (SELECT recording_id, turn_idx, speaker_id, start_ms + p * 3000 AS start_ms, least(end_ms, start_ms + p * 3000 + 3000) AS end_ms FROM (SELECT *, unnest(range(0, CAST(ceil((end_ms - start_ms) / 3000) AS BIGINT))) AS p FROM g WHERE end_ms - start_ms >= 2000)) SELECT * FROM p WHERE end_ms - start_ms >= 2000",
)
def ivl_plan_windows(spark: SparkSession, d: str) -> DataFrame:
    """Enrollment windows: turns shrunk at both ends, without what overlaps, in windows of 3 s."""
    t = V.turn(spark, d).select("recording_id", "speaker_id", "turn_idx", (F.col("start_ms") + 200).alias("start_ms"), (F.col("end_ms") - 200).alias("end_ms")).where("end_ms > start_ms")
    return I.tumbling(I.subtract(t, V.overlap(spark, d), ["recording_id", "turn_idx"], ["recording_id"])).drop("piece")


_CHUNKS = f"{S['turn']}, {_island_sql('turn', gap='5000')}"


@query("ivl_pad_seams", f"WITH {_CHUNKS} SELECT recording_id, start_ms, end_ms, start_ms - least(250, coalesce(CAST(floor((start_ms - lag(end_ms) OVER w) / 2) AS BIGINT), 250)) AS pad_start, end_ms + least(250, coalesce(CAST(floor((lead(start_ms) OVER w - end_ms) / 2) AS BIGINT), 250)) AS pad_end FROM isl WINDOW w AS (PARTITION BY recording_id ORDER BY start_ms)")
def ivl_pad_seams(spark: SparkSession, d: str) -> DataFrame:
    return I.pad_seams(I.union(V.turn(spark, d), gap=5000).drop("merged_from"))


@query("ivl_bounds", f"WITH {_CHUNKS} SELECT recording_id, start_ms, end_ms, (lag(end_ms) OVER w + start_ms) / 2 AS lo, (end_ms + lead(start_ms) OVER w) / 2 AS hi FROM isl WINDOW w AS (PARTITION BY recording_id ORDER BY start_ms)")
def ivl_bounds(spark: SparkSession, d: str) -> DataFrame:
    return I.seam_bounds(I.union(V.turn(spark, d), gap=5000).drop("merged_from"))


_TALK = "talk AS (SELECT * FROM turn WHERE kind IN ('signup', 'purchase'))"
_NEAR = f"{S['word']}, {_TALK}, m AS (SELECT w.recording_id, w.word_idx, CAST(round((w.t0 + w.t1) * 500) AS BIGINT) AS at, t.turn_idx, t.speaker_id, CASE WHEN t.start_ms <= CAST(round((w.t0 + w.t1) * 500) AS BIGINT) AND CAST(round((w.t0 + w.t1) * 500) AS BIGINT) <= t.end_ms THEN 0 ELSE 1 END AS outside, CASE WHEN CAST(round((w.t0 + w.t1) * 500) AS BIGINT) < t.start_ms THEN t.start_ms - CAST(round((w.t0 + w.t1) * 500) AS BIGINT) ELSE greatest(0, CAST(round((w.t0 + w.t1) * 500) AS BIGINT) - t.end_ms) END AS dist FROM word w LEFT JOIN talk t ON t.recording_id = w.recording_id), nearest AS (SELECT recording_id, word_idx, speaker_id FROM m QUALIFY row_number() OVER (PARTITION BY recording_id, word_idx ORDER BY outside, dist, turn_idx) = 1)"


_OVERLAP = S["overlap"].removeprefix(S["turn"] + ", ")


def _spoken(spark: SparkSession, d: str) -> DataFrame:
    w = V.word(spark, d).withColumn("at", F.round((F.col("t0") + F.col("t1")) * 500).cast("bigint"))
    return J.nearest(w, "at", "word_idx", V.turn(spark, d).where("kind in ('signup', 'purchase')"), "turn_idx", "speaker_id", "UNKNOWN")


@query("jn_word_turn", f"WITH {_NEAR} SELECT recording_id, word_idx, coalesce(speaker_id, 'UNKNOWN') AS speaker_id FROM nearest")
def jn_word_turn(spark: SparkSession, d: str) -> DataFrame:
    return _spoken(spark, d).select("recording_id", "word_idx", "speaker_id")


@query(
    "win_sentences",
    f"WITH {_NEAR}, {_OVERLAP}, sp AS (SELECT w.*, coalesce(n.speaker_id, 'UNKNOWN') AS speaker FROM word w JOIN nearest n USING (recording_id, word_idx)), b AS (SELECT *, CASE WHEN lag(speaker) OVER v IS NULL OR lag(speaker) OVER v <> speaker OR t0 - lag(t1) OVER v > 1.5 OR regexp_matches(lag(word) OVER v, '[.!?]$') THEN 1 ELSE 0 END AS new FROM sp WINDOW v AS (PARTITION BY recording_id ORDER BY t0, word_idx)), s AS (SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY t0, word_idx ROWS UNBOUNDED PRECEDING) AS i FROM b), se AS (SELECT recording_id, CAST(i AS BIGINT) AS sent_idx, speaker, min(t0) AS t0, max(t1) AS t1, count(*) AS words, string_agg(word, ' ' ORDER BY t0, word_idx) AS text FROM s GROUP BY ALL) SELECT *, EXISTS (SELECT 1 FROM overlap o WHERE o.recording_id = se.recording_id AND o.start_ms < round(se.t1 * 1000) AND o.end_ms > round(se.t0 * 1000)) AS overlap FROM se",
)
def win_sentences(spark: SparkSession, d: str) -> DataFrame:
    return R.sentences(_spoken(spark, d).withColumnRenamed("speaker_id", "speaker"), V.overlap(spark, d))


@query("agg_transcript", f"WITH {S['word']} SELECT recording_id, string_agg(trim(word), ' ' ORDER BY word_idx) AS transcript FROM word GROUP BY ALL")
def agg_transcript(spark: SparkSession, d: str) -> DataFrame:
    return A.transcript(V.word(spark, d))


@query("flt_overlap", f"WITH {S['overlap']} SELECT recording_id, turn_idx, EXISTS (SELECT 1 FROM overlap o WHERE o.recording_id = turn.recording_id AND o.end_ms > turn.start_ms AND o.start_ms < turn.end_ms AND turn.end_ms > turn.start_ms) AS has_overlap FROM turn")
def flt_overlap(spark: SparkSession, d: str) -> DataFrame:
    return J.overlaps(V.turn(spark, d), V.overlap(spark, d), "turn_idx").select("recording_id", "turn_idx", "has_overlap")


@query("jn_overlap_semi", f"WITH {S['overlap']} SELECT recording_id, turn_idx FROM turn WHERE EXISTS (SELECT 1 FROM overlap o WHERE o.recording_id = turn.recording_id AND o.end_ms > turn.start_ms AND o.start_ms < turn.end_ms AND turn.end_ms > turn.start_ms)")
def jn_overlap_semi(spark: SparkSession, d: str) -> DataFrame:
    return flt_overlap(spark, d).where("has_overlap").drop("has_overlap")


@query("jn_target_anti", f"WITH {S['overlap']} SELECT recording_id, turn_idx FROM turn WHERE NOT EXISTS (SELECT 1 FROM overlap o WHERE o.recording_id = turn.recording_id AND o.end_ms > turn.start_ms AND o.start_ms < turn.end_ms AND turn.end_ms > turn.start_ms)")
def jn_target_anti(spark: SparkSession, d: str) -> DataFrame:
    return flt_overlap(spark, d).where("not has_overlap").drop("has_overlap")


@query(
    "jn_window_turn",
    f"WITH {S['turn']}, w AS (SELECT recording_id, turn_idx AS window_idx, start_ms + 500 AS start_ms, start_ms + 3500 AS end_ms, speaker_id FROM turn WHERE end_ms - start_ms >= 4000), h AS (SELECT w.recording_id, w.window_idx, count(*) AS n, min(t.turn_idx) AS turn_idx FROM w JOIN turn t ON t.recording_id = w.recording_id AND t.speaker_id = w.speaker_id AND t.start_ms <= w.start_ms AND w.end_ms <= t.end_ms GROUP BY ALL) SELECT w.recording_id, w.window_idx, CASE WHEN n = 1 THEN turn_idx END AS turn_idx FROM w LEFT JOIN h USING (recording_id, window_idx)",
)
def jn_window_turn(spark: SparkSession, d: str) -> DataFrame:
    t = V.turn(spark, d)
    w = t.where("end_ms - start_ms >= 4000").select("recording_id", F.col("turn_idx").alias("window_idx"), (F.col("start_ms") + 500).alias("start_ms"), (F.col("start_ms") + 3500).alias("end_ms"), "speaker_id")
    return J.sole_container(w, t).select("recording_id", "window_idx", "turn_idx")


@query("jn_chunk_at", f"WITH {_CHUNKS}, b AS (SELECT recording_id, start_ms AS chunk_start, (lag(end_ms) OVER w + start_ms) / 2 AS lo, (end_ms + lead(start_ms) OVER w) / 2 AS hi FROM isl WINDOW w AS (PARTITION BY recording_id ORDER BY start_ms)) SELECT t.recording_id, t.turn_idx, b.chunk_start FROM turn t JOIN b ON b.recording_id = t.recording_id AND (lo IS NULL OR lo < t.start_ms) AND (hi IS NULL OR t.start_ms <= hi)")
def jn_chunk_at(spark: SparkSession, d: str) -> DataFrame:
    t = V.turn(spark, d)
    chunks = I.seam_bounds(I.union(t, gap=5000)).withColumnRenamed("start_ms", "chunk_start")
    return J.owner(t.select("recording_id", "turn_idx", "start_ms"), "start_ms", chunks, "chunk_start").select("recording_id", "turn_idx", "chunk_start")


_DENSITY = f"{S['frame']}, dn AS (SELECT *, sum(CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS density FROM frame)"


@query("win_density", f"WITH {_DENSITY} SELECT recording_id, frame_idx, density, density >= 0.5 AS active FROM dn")
def win_density(spark: SparkSession, d: str) -> DataFrame:
    return R.density(V.frame(spark, d)).select("recording_id", "frame_idx", "density", "active")


_RUNS = "rn AS (SELECT recording_id, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, count(*) AS frames FROM (SELECT recording_id, frame_idx, frame_idx - row_number() OVER (PARTITION BY recording_id ORDER BY frame_idx) AS run FROM {src} WHERE {on}) GROUP BY recording_id, run)"


@query("win_vad_runs", f"WITH {_DENSITY}, {_RUNS.format(src='dn', on='density >= 0.5')} SELECT * FROM rn")
def win_vad_runs(spark: SparkSession, d: str) -> DataFrame:
    return R.runs(R.density(V.frame(spark, d)))


@query("ivl_bridge", f"WITH {_DENSITY}, {_RUNS.format(src='dn', on='density >= 0.5')}, rg AS (SELECT recording_id, first_frame * 0.032::DOUBLE AS start_s, (last_frame + 1) * 0.032::DOUBLE AS end_s FROM rn), {_island_sql('rg', start='start_s', end='end_s', gap='0.05::DOUBLE')} SELECT * FROM isl WHERE end_s - start_s >= 0.2")
def ivl_bridge(spark: SparkSession, d: str) -> DataFrame:
    r = R.runs(R.density(V.frame(spark, d))).select("recording_id", (F.col("first_frame") * 0.032).alias("start_s"), ((F.col("last_frame") + 1) * 0.032).alias("end_s"))
    return I.bridge(r, gap=0.05)


_THRESHOLD = f"{S['frame']}, th AS (SELECT recording_id, quantile_cont(rms, 0.05) AS p05, quantile_cont(rms, 0.95) AS p95 FROM frame GROUP BY ALL)"


@query("agg_energy_stats", f"WITH {_THRESHOLD} SELECT recording_id, round(p05, 9) AS p05, round(p95, 9) AS p95, round(greatest(1e-4, p05 + 0.05 * (p95 - p05)), 9) AS threshold FROM th")
def agg_energy_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.dynamic_threshold(V.frame(spark, d)).select("recording_id", *[F.round(c, 9).alias(c) for c in ("p05", "p95", "threshold")])


@query("win_energy_runs", f"WITH {_THRESHOLD}, lv AS (SELECT f.* FROM frame f JOIN th USING (recording_id) WHERE rms >= greatest(1e-4, p05 + 0.05 * (p95 - p05))), {_RUNS.format(src='lv', on='true')} SELECT * FROM rn WHERE frames >= 5")
def win_energy_runs(spark: SparkSession, d: str) -> DataFrame:
    f = V.frame(spark, d)
    return R.runs(f.join(A.dynamic_threshold(f), "recording_id").withColumn("active", F.col("rms") >= F.col("threshold")), 5)


@query("prj_timecode", f"WITH {S['turn']} SELECT recording_id, turn_idx, lpad(CAST(start_ms // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(start_ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(start_ms // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(start_ms % 1000 AS VARCHAR), 3, '0') AS timecode FROM turn")
def prj_timecode(spark: SparkSession, d: str) -> DataFrame:
    return V.turn(spark, d).select("recording_id", "turn_idx", X.timecode(F.col("start_ms")).alias("timecode"))


@query("ivl_runs", f"WITH {S['turn']}, {_island_sql('turn', 'recording_id, speaker_id', gap='1')} SELECT * FROM isl WHERE end_ms - start_ms >= 700")
def ivl_runs(spark: SparkSession, d: str) -> DataFrame:
    return I.union(V.turn(spark, d), ["recording_id", "speaker_id"], gap=1).where("end_ms - start_ms >= 700")
