"""Registered queries on payload checks, public names, verification, listening samples and chunks of one language; with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.operators import assembly as Y
from tidemark.operators import intervals as I
from tidemark.operators import listening as Q
from tidemark.operators import verification as K
from tidemark.plans.summaries import ORACLE_SQL as SUMMARIES_SQL
from tidemark.plans.summaries import win_loo
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


@query("src_dia_overlaps", f"WITH {S['turn']} SELECT recording_id, turn_idx, greatest(start_ms - 600000, 0) AS start_ms, least(end_ms - 600000, 80000000) AS end_ms FROM turn WHERE end_ms > start_ms")
def src_dia_overlaps(spark: SparkSession, d: str) -> DataFrame:
    t = V.turn(spark, d).select("recording_id", "turn_idx", (F.col("start_ms") - 600_000).alias("start_ms"), (F.col("end_ms") - 600_000).alias("end_ms"))
    return Y.clamped_overlaps(t, F.lit(80_000_000))


@query(
    "src_dia_validate",
    f"""WITH {S['turn']}, p AS (SELECT recording_id, start_ms, end_ms, CASE WHEN turn_idx % 40 = 0 THEN ' ' ELSE speaker_id END AS speaker_id FROM turn),
o AS (SELECT *, lead(start_ms) OVER w AS s, lead(end_ms) OVER w AS e, lead(speaker_id) OVER w AS other FROM turn WINDOW w AS (PARTITION BY recording_id ORDER BY start_ms, turn_idx)),
b AS (SELECT recording_id, 1 AS turn, start_ms < 0 OR end_ms <= start_ms OR trim(speaker_id) = '' AS bad FROM p UNION ALL SELECT recording_id, 0, s >= least(end_ms, e) OR other = speaker_id FROM o WHERE s < end_ms)
SELECT recording_id, CAST(sum(turn) AS BIGINT) AS turns, count(*) FILTER (bad) AS violations, count(*) FILTER (bad) = 0 AS valid FROM b GROUP BY ALL""",
)
def src_dia_validate(spark: SparkSession, d: str) -> DataFrame:
    """Recordings as payloads; every fortieth turn names no speaker, and where a turn meets the next one they overlap, some by one speaker."""
    t = V.turn(spark, d)
    w = Window.partitionBy("recording_id").orderBy("start_ms", "turn_idx")
    o = t.withColumns({"s": F.lead("start_ms").over(w), "e": F.lead("end_ms").over(w), "other": F.lead("speaker_id").over(w)}).where("s < end_ms")
    o = o.select("recording_id", F.col("s").alias("start_ms"), F.least("end_ms", "e").alias("end_ms"), F.array("speaker_id", "other").alias("speaker_ids"))
    return Y.valid_payloads(t.withColumn("speaker_id", F.when(F.col("turn_idx") % 40 == 0, " ").otherwise(F.col("speaker_id"))), o)


@query(
    "mt_validate",
    "WITH p AS (SELECT vec_id, trim(CASE WHEN vec_id % 10 = 0 THEN ' ' WHEN vec_id % 10 < 3 THEN 'twin-' || CAST(vec_id // 10 AS VARCHAR) ELSE 'p-' || CAST(vec_id AS VARCHAR) END) AS id, vec_id % 4 AS k FROM embeddings), c AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM p) "
    "SELECT vec_id, array_to_string(list_filter([CASE WHEN id = '' THEN 'id' END, CASE WHEN n > 1 THEN 'duplicate' END, CASE WHEN k = 0 THEN 'no vector' END, CASE WHEN k = 1 THEN 'vector' END], lambda x: x IS NOT NULL), ',') AS violations FROM c",
)
def mt_validate(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as profiles, some without id or vector, with a zero vector or an id given twice."""
    e, v = V.table(spark, d, "embeddings"), F.col("vec_id")
    name = F.when(v % 10 == 0, " ").when(v % 10 < 3, F.concat(F.lit("twin-"), F.floor(v / 10).cast("string"))).otherwise(F.concat(F.lit("p-"), v.cast("string")))
    one = F.when(v % 4 == 1, F.transform("embedding", lambda x: F.lit(0.0))).otherwise(F.transform("embedding", lambda x: x.cast("double")))
    p = e.select("vec_id", name.alias("profile_id"), F.when(v % 4 == 0, F.array().cast("array<array<double>>")).otherwise(F.array(one)).alias("vectors"))
    dimension = e.select(F.max(F.size("embedding"))).first()[0] or 0
    return Y.profile_violations(p, dimension).select("vec_id", F.array_join("violations", ",").alias("violations"))


@query("prj_public_id", f"WITH {S['turn']} SELECT DISTINCT recording_id, speaker_id, CASE speaker_id WHEN 'SPEAKER_0' THEN 'unknown-SPEAKER_0' WHEN 'SPEAKER_1' THEN 'unknown-SPEAKER_1-1' ELSE speaker_id END AS public_id FROM turn")
def prj_public_id(spark: SparkSession, d: str) -> DataFrame:
    """Known ids that speakers' labels, and one of their other names, run into."""
    t = V.turn(spark, d).select("recording_id", "speaker_id").distinct()
    known = t.select("recording_id").distinct().select("recording_id", F.explode(F.array(*map(F.lit, ("SPEAKER_0", "SPEAKER_1", "unknown-SPEAKER_1")))).alias("known_id"))
    return Y.public_ids(t, known)


@query("jn_assign_out", f"WITH {S['turn']} SELECT recording_id, turn_idx, CASE speaker_id WHEN 'SPEAKER_0' THEN 'SPEAKER_2' WHEN 'SPEAKER_2' THEN 'unknown-SPEAKER_2' ELSE speaker_id END AS public_id, CASE speaker_id WHEN 'SPEAKER_0' THEN 'known' WHEN 'SPEAKER_4' THEN 'unresolved' ELSE 'unknown' END AS kind FROM turn")
def jn_assign_out(spark: SparkSession, d: str) -> DataFrame:
    """Speaker 0 is the known SPEAKER_2, whose name the label of another speaker then cannot take; speaker 4 is unresolved."""
    t = V.turn(spark, d)
    labels = t.select("recording_id", "speaker_id").distinct()
    assigned = labels.where("speaker_id = 'SPEAKER_0'").withColumn("profile_id", F.lit("SPEAKER_2"))
    known = labels.select("recording_id").distinct().withColumn("known_id", F.lit("SPEAKER_2"))
    public = Y.public_ids(labels.where("speaker_id != 'SPEAKER_0'"), known)
    return Y.named(t, assigned, labels.where("speaker_id = 'SPEAKER_4'"), public).select("recording_id", "turn_idx", "public_id", "kind")


@query("jn_sentence_vec", f"WITH {S['turn']}, v AS (SELECT recording_id, start_ms // 60000 AS at, max(turn_idx) AS vec FROM turn WHERE turn_idx % 3 <> 0 GROUP BY ALL) SELECT t.recording_id, t.turn_idx, v.vec FROM turn t LEFT JOIN v ON v.recording_id = t.recording_id AND v.at = t.start_ms // 60000")
def jn_sentence_vec(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with the vector of their start (here the minute); of several the last one counts, and some have none."""
    t = V.turn(spark, d).withColumn("at", F.floor(F.col("start_ms") / 60_000))
    v = t.where("turn_idx % 3 != 0").groupBy("recording_id", "at").agg(F.max_by("turn_idx", "turn_idx").alias("vec"))
    return t.join(v, ["recording_id", "at"], "left").select("recording_id", "turn_idx", "vec")


@query("win_core_keep", f"WITH q AS ({SUMMARIES_SQL['win_loo']}), r AS (SELECT *, count(*) OVER (PARTITION BY recording_id, speaker_id) AS n, row_number() OVER (PARTITION BY recording_id, speaker_id ORDER BY loo DESC NULLS LAST, sample_idx) AS k FROM q) SELECT recording_id, speaker_id, sample_idx FROM r WHERE n >= 3 AND k <= greatest(3, CAST(floor(n * 0.6::DOUBLE) AS BIGINT))")
def win_core_keep(spark: SparkSession, d: str) -> DataFrame:
    return K.core_kept(win_loo(spark, d), "loo", ["recording_id", "speaker_id"]).select("recording_id", "speaker_id", "sample_idx")


@query("top_turn_fallback", f"WITH {S['turn']}, r AS (SELECT *, 15000 - coalesce(sum(end_ms - start_ms) OVER (PARTITION BY recording_id, speaker_id ORDER BY end_ms - start_ms DESC, start_ms, turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM turn WHERE end_ms - start_ms >= 700) SELECT recording_id, speaker_id, turn_idx, start_ms, CAST(least(end_ms, start_ms + room) AS BIGINT) AS end_ms FROM r WHERE room >= 700")
def top_turn_fallback(spark: SparkSession, d: str) -> DataFrame:
    return Q.longest_turns(V.turn(spark, d))


def _windows(spark: SparkSession, d: str) -> DataFrame:
    """Samples as windows (of two neighbours each, so that some make runs) with their cosine to the speaker's prototype."""
    s = V.sample(spark, d)
    p = A.weighted_mean_vector(s, Q.WHO)
    w = s.join(p, Q.WHO).withColumn("centrality", A.dot(F.col("vector"), F.col("prototype")))
    return w.select(*Q.WHO, "start_ms", (F.col("start_ms") + F.when(F.col("sample_idx") % 4 == 0, 1500).otherwise(8000)).alias("end_ms"), "centrality", "quality")


@query("top_snippets")
def top_snippets(spark: SparkSession, d: str) -> DataFrame:
    return Q.snippets(_windows(spark, d)).withColumn("centrality", F.round("centrality", 6))


@query("top_tiers")
def top_tiers(spark: SparkSession, d: str) -> DataFrame:
    w = _windows(spark, d).withColumn("quality", F.when(F.col("speaker_id").isin("SPEAKER_1", "SPEAKER_2"), F.col("quality") * 0.4).when(F.col("speaker_id") == "SPEAKER_3", 0.0).otherwise(F.col("quality")))
    return Q.samples(w, w.withColumn("turn_idx", F.col("start_ms")))


@query("vf_verify")
def vf_verify(spark: SparkSession, d: str) -> DataFrame:
    """Samples as sentences, of which every eleventh names another speaker and every thirteenth overlaps."""
    s, i = V.sample(spark, d), F.col("sample_idx")
    other = F.concat(F.lit("SPEAKER_"), ((F.substring("speaker_id", 9, 9).cast("int") + 1) % 10).cast("string"))
    rows = s.select("recording_id", i.alias("sent_idx"), F.when(i % 11 == 0, other).otherwise(F.col("speaker_id")).alias("speaker"), (F.col("start_ms") / 1000).alias("t0"), (F.col("end_ms") / 1000).alias("t1"), (i % 13 == 0).alias("overlap"), "vector")
    return K.verify(rows)


@query("ivl_lang_superchunk")
def ivl_lang_superchunk(spark: SparkSession, d: str) -> DataFrame:
    """Speech of a recording in chunks of one language, by the languages of its turns."""
    t = V.turn(spark, d).where("end_ms > start_ms")
    seconds = lambda df: df.withColumns({"start_s": F.col("start_ms") / 1000, "end_s": F.col("end_ms") / 1000})
    spans = seconds(t).withColumn("language", F.when(F.col("turn_idx") % 3 == 0, "de").otherwise("en"))
    return Y.language_superchunks(seconds(I.union(t)), spans, 600.0)
