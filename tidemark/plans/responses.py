"""Registered queries on languages, segments and documents of whole responses; with their DuckDB SQL.

A request is a recording of `views.voice_sample`; its known speakers are the speakers of the recording before; the text of a turn, and what was detected in it, is the document of
its number. One cloud a speaker has one component, which SQL can build.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import clouds as C
from tidemark.operators import languages as L
from tidemark.operators import responses as B
from tidemark.plans.refinement import _clouds
from tidemark.plans.summaries import _majority_sql
from tidemark.plans.voices import _clean_sql
from tidemark.sources import views as V
from tidemark.sources.steps import kept
from tidemark.sources.views import SQL as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
EXPECTED = 10


def query(name: str, sql: str):  # noqa: ANN201
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return register


_ITEMS = f"""{S["lid"]}, win AS (SELECT recording_id, item_idx // 80 AS item_idx, seconds, code_idx, probability FROM lid),
sc AS (SELECT recording_id, item_idx, seconds, c AS code_idx, CASE WHEN c = code_idx THEN probability ELSE (1 - probability) / 13 END AS p FROM (SELECT *, unnest(range(1, 15)) AS c FROM win)),
m AS (SELECT recording_id, item_idx, code_idx, sum(seconds * ln(least(greatest(p, 1e-12), 1.0))) / sum(seconds) AS m FROM sc WHERE p IS NOT NULL AND seconds > 0 GROUP BY ALL),
e AS (SELECT *, exp(m - max(m) OVER (PARTITION BY recording_id, item_idx)) AS e FROM m),
pool AS (SELECT recording_id, item_idx, code_idx, e / sum(e) OVER (PARTITION BY recording_id, item_idx) AS probability FROM e QUALIFY row_number() OVER (PARTITION BY recording_id, item_idx ORDER BY e DESC, code_idx) = 1)"""
_ITEMS_LID = _majority_sql("mj", 1.0).replace("FROM lid", "FROM item")


@query(
    "rp_items",
    f"WITH {_ITEMS}, item AS (SELECT i.*, p.code_idx, p.probability FROM (SELECT recording_id, item_idx, sum(seconds) AS seconds FROM win GROUP BY ALL) i LEFT JOIN pool p USING (recording_id, item_idx)), {_ITEMS_LID} "
    "SELECT l.recording_id, l.item_idx, l.seconds, round(l.probability, 6) AS probability, CASE WHEN l.seconds >= 1.0 AND l.probability >= 0.5 THEN l.code_idx ELSE coalesce(m.code_idx, 1) END AS smoothed FROM item l LEFT JOIN mj m ON m.recording_id = l.recording_id",
)
def rp_items(spark: SparkSession, d: str) -> DataFrame:
    """Documents as windows; those of one source among eighty are an item."""
    w = V.lid(spark, d).withColumn("item_idx", F.floor(F.col("item_idx") / 80))
    s = w.withColumn("c", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(14).cast("bigint"))))
    s = s.select("recording_id", "item_idx", "seconds", F.col("c").alias("code_idx"), F.when(F.col("c") == F.col("code_idx"), F.col("probability")).otherwise((1 - F.col("probability")) / 13).alias("p"))
    items = w.groupBy("recording_id", "item_idx").agg(F.sum("seconds").alias("seconds"))
    return B.item_languages(items, s).select("recording_id", "item_idx", "seconds", F.round("probability", 6).alias("probability"), "smoothed")


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return kept(V.voice_sample(spark, d), "samples")


def _turns(spark: SparkSession, d: str, samples: DataFrame) -> DataFrame:
    """Turns with what was detected in them and their text."""
    found = V.lid(spark, d).select(F.col("item_idx").alias("turn_idx"), "code_idx", "probability")
    text = V.table(spark, d, "documents").select(F.col("doc_id").alias("turn_idx"), F.array("text").alias("chunks"))
    t = V.turns_of(samples).withColumn("seconds", (F.col("end_ms") - F.col("start_ms")) / 1000)
    return kept(t.join(found, "turn_idx", "left").join(text, "turn_idx", "left"), "turns")


def _speakers(turns: DataFrame) -> DataFrame:
    """Each speaker's language: that of most of its seconds, as sure as their share."""
    who = C.WHO
    by = turns.groupBy(*who, "code_idx").agg(F.sum("seconds").alias("s"))
    known = F.when(F.col("code_idx").isNotNull(), F.col("s"))
    s = by.groupBy(*who).agg(F.sum("s").alias("seconds"), F.max_by("code_idx", F.when(known.isNotNull(), F.struct(known.alias("s"), (-F.col("code_idx")).alias("c")))).alias("code_idx"), (F.max(known) / F.sum(known)).alias("probability"))
    return L.speaker_languages(s).withColumn("speech_s", F.col("seconds"))


_LANG = f"""{S["voice"]}, {S["lid"]}, td AS (SELECT t.*, (end_ms - start_ms) / 1000 AS seconds, l.code_idx, l.probability FROM voice_turn t LEFT JOIN lid l ON l.item_idx = t.turn_idx),
sb AS (SELECT recording_id, speaker_id, code_idx, sum(seconds) AS s FROM td GROUP BY ALL),
sl AS (SELECT recording_id, speaker_id, sum(s) AS seconds, arg_max(code_idx, s * 1000 - code_idx) FILTER (code_idx IS NOT NULL) AS code_idx, max(s) FILTER (code_idx IS NOT NULL) / sum(s) FILTER (code_idx IS NOT NULL) AS probability FROM sb GROUP BY ALL),
{_majority_sql("mj", 1.0, False).replace("FROM lid", "FROM sl")},
sp AS (SELECT sl.recording_id, sl.speaker_id, sl.seconds AS speech_s, CASE WHEN sl.code_idx IS NOT NULL AND sl.seconds >= 1.0 AND sl.probability >= 0.5 THEN sl.code_idx ELSE coalesce(m.code_idx, 1) END AS code,
  CASE WHEN sl.code_idx IS NOT NULL AND sl.seconds >= 1.0 AND sl.probability >= 0.5 THEN 'detected' WHEN m.code_idx IS NOT NULL THEN 'majority' ELSE 'fallback' END AS source FROM sl LEFT JOIN mj m ON m.recording_id = sl.recording_id),
tl AS (SELECT td.*, sp.code AS prior, CASE WHEN td.seconds >= 1.5 AND td.probability >= 0.85 AND td.code_idx <> sp.code THEN td.code_idx ELSE sp.code END AS code FROM td JOIN sp USING (recording_id, speaker_id)),
ds AS (SELECT recording_id, code, greatest(sum(s), 0) AS s FROM (SELECT recording_id, code, speech_s AS s FROM sp UNION ALL SELECT recording_id, code, seconds FROM tl WHERE code <> prior UNION ALL SELECT recording_id, prior, -seconds FROM tl WHERE code <> prior) GROUP BY ALL),
dl AS (SELECT recording_id, code, s, row_number() OVER (PARTITION BY recording_id ORDER BY s DESC, code) = 1 AS chosen FROM ds WHERE s > 0)"""


@query("rp_detect", f"WITH {_LANG} SELECT recording_id, code, round(s, 1) AS seconds, chosen FROM dl")
def rp_detect(spark: SparkSession, d: str) -> DataFrame:
    """Seconds of each language of a request, and which is the request's."""
    t = _turns(spark, d, V.voice_sample(spark, d)).drop("chunks")
    found = B.language_decision(t, _speakers(t))
    return found.select("recording_id", F.col("code").alias("_chosen"), F.explode("seconds").alias("x")).select("recording_id", "x.code", "x.seconds", (F.col("x.code") == F.col("_chosen")).alias("chosen"))


_TEXT = _clean_sql().replace("conv_id, turn, ", "doc_id, ").replace("FROM conversations", "FROM documents")
_SEGMENTS = f"""tx AS ({_TEXT}), sg AS (
  SELECT t.*, CASE WHEN regexp_matches(x.cleaned, '[\\p{{L}}\\p{{N}}_]') THEN x.cleaned ELSE trim(coalesce(o.text, '')) END AS text, NOT regexp_matches(x.cleaned, '[\\p{{L}}\\p{{N}}_]') AS asr_failure,
    EXISTS (SELECT 1 FROM voice_overlap v WHERE v.recording_id = t.recording_id AND v.end_ms > t.start_ms AND v.start_ms < t.end_ms) AS overlap
  FROM voice_turn t JOIN tx x ON x.doc_id = t.turn_idx JOIN documents o ON o.doc_id = t.turn_idx WHERE regexp_matches(x.cleaned, '[\\p{{L}}\\p{{N}}_]') OR trim(coalesce(o.text, '')) <> ''
)"""


def _segments(turns: DataFrame, samples: DataFrame) -> DataFrame:
    return B.transcript_segments(turns.withColumn("original_speaker_id", F.lit(None).cast("string")), V.overlaps_of(samples), filtered=False)


@query("rp_transcript", f"WITH {S['voice']}, {_SEGMENTS} SELECT recording_id, turn_idx AS index, start_ms, end_ms, speaker_id AS diarization_speaker_id, sha256(text) AS text_sha256, overlap, asr_failure FROM sg")
def rp_transcript(spark: SparkSession, d: str) -> DataFrame:
    """Segments of requests; repeated patterns are left to txt_repetition, which SQL cannot fold."""
    samples = _samples(spark, d)
    s = _segments(_turns(spark, d, samples), samples)
    return s.select("recording_id", "index", "start_ms", "end_ms", "diarization_speaker_id", F.sha2("text", 256).alias("text_sha256"), "overlap", "asr_failure")


def _clouds_of(samples: DataFrame) -> DataFrame:
    return kept(C.plain_clouds(samples), "clouds")


def _profiles(clouds: DataFrame) -> DataFrame:
    """The speakers of the recording before; those of under 25 samples are not usable."""
    after = F.concat(F.lit("rec-"), (F.substring("recording_id", 5, 18).cast("bigint") + 1).cast("string"))
    p = clouds.select(after.alias("recording_id"), F.col("speaker_id").alias("profile_id"), F.col("prototype").alias("profile"), ((F.col("status") != "mixed_cluster") & (F.col("candidates") >= 25)).alias("usable"))
    return p.join(clouds.select("recording_id").distinct(), "recording_id", "left_semi")


_MATCH = f"""{_clouds("cloud", "sample")},
prof AS (SELECT 'rec-' || CAST(CAST(substr(c.recording_id, 5) AS BIGINT) + 1 AS VARCHAR) AS recording_id, c.speaker_id AS profile_id, p.v, c.status <> 'mixed_cluster' AND c.candidates >= 25 AS usable FROM cloud c JOIN cloud_p p USING (recording_id, speaker_id)),
known AS (SELECT * FROM prof SEMI JOIN cloud USING (recording_id)),
edge AS (SELECT c.recording_id, c.speaker_id, k.profile_id, list_cosine_similarity(p.v, k.v) AS cosine FROM cloud c JOIN cloud_p p USING (recording_id, speaker_id) JOIN known k ON k.recording_id = c.recording_id AND k.usable),
pair AS (SELECT *, cosine >= 0.6 AS accepted FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, speaker_id ORDER BY cosine DESC, profile_id) AS a, row_number() OVER (PARTITION BY recording_id, profile_id ORDER BY cosine DESC, speaker_id) AS b FROM edge) WHERE a = 1 AND b = 1 AND cosine >= 0.45),
have AS (SELECT recording_id, bool_or(usable) AS some, bool_and(usable) AS every FROM known GROUP BY ALL),
open AS (SELECT c.recording_id, c.speaker_id, CASE WHEN h.some THEN p.profile_id END AS candidate_id, CASE WHEN NOT h.some OR p.profile_id IS NULL THEN 'profile_evidence_unavailable' END AS reason
  FROM cloud c JOIN have h USING (recording_id) LEFT JOIN pair p USING (recording_id, speaker_id) WHERE NOT h.some OR (p.profile_id IS NOT NULL AND NOT p.accepted) OR (p.profile_id IS NULL AND NOT h.every))"""


def _matched(clouds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = _profiles(clouds)
    pairs = kept(B.mutual_matches(clouds, p.where("usable")), "pairs")
    return p, pairs, B.unresolved_speakers(clouds, p, pairs)


@query("mt_reasons", f"WITH {S['voice']}, {_MATCH} SELECT recording_id, speaker_id, candidate_id, reason FROM open")
def mt_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _matched(_clouds_of(_samples(spark, d)))[2]


_NAMES = """label AS (SELECT recording_id, speaker_id FROM cloud UNION SELECT recording_id, speaker_id FROM sg),
name AS (SELECT l.recording_id, l.speaker_id, p.cosine, CASE WHEN p.profile_id IS NOT NULL THEN p.profile_id WHEN k.profile_id IS NOT NULL THEN 'unknown-' || l.speaker_id ELSE l.speaker_id END AS public_id, CASE WHEN p.profile_id IS NOT NULL THEN 'known' WHEN o.speaker_id IS NOT NULL THEN 'unresolved' ELSE 'unknown' END AS kind
  FROM label l LEFT JOIN pair p ON p.recording_id = l.recording_id AND p.speaker_id = l.speaker_id AND p.accepted LEFT JOIN known k ON k.recording_id = l.recording_id AND k.profile_id = l.speaker_id LEFT JOIN open o ON o.recording_id = l.recording_id AND o.speaker_id = l.speaker_id)"""


def _kinds(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    clouds = _clouds_of(samples)
    p, pairs, unresolved = _matched(clouds)
    labels = V.turns_of(samples).select("recording_id", F.col("speaker_id").alias("diarization_speaker_id"), F.lit(None).cast("string").alias("refined_diarization_speaker_id"))
    return B.named_speakers(labels, clouds, pairs, unresolved, p).select("recording_id", "speaker_id", "public_id", "kind"), clouds


@query(
    "prj_kind",
    f"WITH {S['voice']}, {_MATCH}, sg AS (SELECT recording_id, speaker_id FROM voice_turn), {_NAMES} SELECT recording_id, speaker_id, public_id, kind FROM name",
)
def prj_kind(spark: SparkSession, d: str) -> DataFrame:
    """The public name and kind of each speaker of a request, by its matches."""
    return _kinds(_samples(spark, d))[0]


@query(
    "agg_speaker_counts",
    f"WITH {S['voice']}, {_MATCH}, sg AS (SELECT recording_id, speaker_id FROM voice_turn), {_NAMES} SELECT n.recording_id, count(*) AS detected, count(*) FILTER (kind = 'known') AS known, count(*) FILTER (kind = 'unknown') AS unknown, count(*) FILTER (kind = 'unresolved') AS unresolved, count(*) <> {EXPECTED} AS mismatch FROM name n SEMI JOIN cloud USING (recording_id, speaker_id) GROUP BY ALL",
)
def agg_speaker_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many speakers of each kind a request has, and whether it has as many as were expected."""
    n, clouds = _kinds(_samples(spark, d))
    n = n.join(clouds.select(*C.WHO), C.WHO, "left_semi")
    c = n.groupBy("recording_id").agg(F.count("*").alias("detected"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("known", "unknown", "unresolved")])
    return c.withColumn("mismatch", F.col("detected") != EXPECTED)


_CODES = "[" + ", ".join(f"'{c}'" for c in V.LANGUAGES) + "]"
_MATCH_JSON = "'candidate_speaker_id': o.candidate_id, 'cosine_similarity': round(coalesce(n.cosine, t.cosine), 6), 'support': NULL::DOUBLE, 'stability_margin': NULL::DOUBLE, 'reason': o.reason"
_WARN = "{{'code': {0}, 'speaker_id': {1}, 'diarization_speaker_id': {2}, 'status': {3}, 'speaker_ids': {4}, 'expected': {5}, 'detected': {6}}}"


@query(
    "rp_assemble",
    f"""WITH {_LANG}, {_MATCH}, {_SEGMENTS}, {_NAMES},
seg AS (SELECT s.recording_id, list({{'index': s.turn_idx, 'start_ms': s.start_ms, 'end_ms': s.end_ms, 'diarization_speaker_id': s.speaker_id, 'refined_diarization_speaker_id': NULL::VARCHAR, 'text': s.text, 'overlap': s.overlap, 'asr_failure': s.asr_failure, 'speaker_id': n.public_id, 'speaker_kind': n.kind,
    'language': {_CODES}[l.code], 'language_source': CASE WHEN l.code <> l.prior THEN 'turn' ELSE 'speaker' END}} ORDER BY s.turn_idx) AS segments, trim(string_agg(s.text, ' ' ORDER BY s.turn_idx)) AS text FROM sg s JOIN name n USING (recording_id, speaker_id) JOIN tl l ON l.recording_id = s.recording_id AND l.turn_idx = s.turn_idx GROUP BY ALL),
who AS (SELECT c.*, n.public_id, n.kind,
    {{'diarization_speaker_id': c.speaker_id, 'speaker_id': n.public_id, 'kind': n.kind, 'embedding_status': c.status, {_MATCH_JSON}, 'language': {_CODES}[p.code], 'language_source': p.source}} AS assignment,
    {{'speaker_id': n.public_id, 'diarization_speaker_id': c.speaker_id, 'speaker_kind': n.kind, 'embedding_status': c.status, 'shown': least(c.kept + 1, 64), 'embeddings_truncated': c.kept > greatest(least(c.kept + 1, 64) - 1, 0), 'candidate_count': c.candidates, 'retained_count': c.kept, 'discarded_outliers': c.candidates - c.kept, 'purity': round(c.purity, 6), {_MATCH_JSON}}} AS public,
    {_WARN.format("CASE WHEN n.kind = 'known' THEN 'KNOWN_SPEAKER_IMPERFECT_CLUSTER' ELSE 'SPEAKER_EMBEDDING_QUALITY' END", "CASE WHEN n.kind = 'known' THEN n.public_id ELSE c.speaker_id END", "CASE WHEN n.kind = 'known' THEN c.speaker_id END", "c.status", "NULL::VARCHAR[]", "NULL::BIGINT", "NULL::BIGINT")} AS warning
  FROM cloud c JOIN name n USING (recording_id, speaker_id) JOIN sp p USING (recording_id, speaker_id) LEFT JOIN open o USING (recording_id, speaker_id) LEFT JOIN pair t ON t.recording_id = c.recording_id AND t.speaker_id = c.speaker_id AND NOT t.accepted AND o.candidate_id IS NOT NULL),
w AS (SELECT recording_id, count(*) AS detected, count(*) FILTER (kind = 'known') AS known, list(assignment ORDER BY speaker_id) AS assignments, coalesce(list(public ORDER BY speaker_id) FILTER (kind = 'unknown'), []) AS unknowns, coalesce(list(public ORDER BY speaker_id) FILTER (kind = 'unresolved'), []) AS unresolved, coalesce(list(warning ORDER BY speaker_id) FILTER (status <> 'ready'), []) AS warnings FROM who GROUP BY ALL),
gone AS (SELECT k.recording_id, list(k.profile_id ORDER BY k.profile_id) AS ids FROM known k WHERE NOT EXISTS (SELECT 1 FROM pair p WHERE p.recording_id = k.recording_id AND p.profile_id = k.profile_id AND p.accepted) GROUP BY ALL),
given AS (SELECT recording_id, count(DISTINCT profile_id) AS n FROM known GROUP BY ALL)
SELECT w.recording_id, CAST(to_json({{
  'transcript': {{'text': coalesce(seg.text, ''), 'language': {_CODES}[dl.code], 'segments': coalesce(seg.segments, [])}},
  'speaker_counts': {{'expected': {EXPECTED}, 'detected': w.detected, 'known_provided': coalesce(given.n, 0), 'known_assigned': w.known, 'unknown': len(w.unknowns), 'unresolved': len(w.unresolved)}},
  'speaker_assignments': w.assignments, 'unknown_speakers': w.unknowns, 'unresolved_speakers': w.unresolved, 'unresolved_known_speakers': coalesce(gone.ids, []),
  'warnings': w.warnings || CASE WHEN gone.ids IS NULL THEN [] ELSE [{_WARN.format("'KNOWN_SPEAKERS_UNRESOLVED'", "NULL::VARCHAR", "NULL::VARCHAR", "NULL::VARCHAR", "gone.ids", "NULL::BIGINT", "NULL::BIGINT")}] END
    || CASE WHEN w.detected = {EXPECTED} THEN [] ELSE [{_WARN.format("'EXPECTED_SPEAKER_COUNT_MISMATCH'", "NULL::VARCHAR", "NULL::VARCHAR", "NULL::VARCHAR", "NULL::VARCHAR[]", f"{EXPECTED}::BIGINT", "w.detected")}] END
}}) AS VARCHAR) AS document FROM w LEFT JOIN seg USING (recording_id) LEFT JOIN gone USING (recording_id) LEFT JOIN given USING (recording_id) JOIN dl ON dl.recording_id = w.recording_id AND dl.chosen""",
)
def rp_assemble(spark: SparkSession, d: str) -> DataFrame:
    """The whole document of each request."""
    samples = _samples(spark, d)
    t, clouds = _turns(spark, d, samples), _clouds_of(samples)
    p, pairs, unresolved = _matched(clouds)
    named = F.array(*map(F.lit, V.LANGUAGES))
    name = lambda c: F.element_at(named, F.col(c).cast("int"))
    spoken = kept(_speakers(t), "speakers")
    heard = B.turn_languages(t.drop("chunks"), spoken).select("recording_id", F.col("turn_idx").alias("index"), name("code").alias("language"), F.col("source").alias("language_source"))
    segments = _segments(t, samples).join(heard, ["recording_id", "index"])
    speakers = clouds.drop("ids", "prototype").withColumn("shown", F.least(F.col("kept") + 1, F.lit(C.PUBLIC))).join(spoken.select(*C.WHO, name("resolved").alias("language"), F.col("source").alias("language_source")), C.WHO)
    requests = B.language_decision(t.drop("chunks"), spoken).select("recording_id", F.lit(EXPECTED).cast("bigint").alias("expected"), name("code").alias("language"))
    pairs = pairs.withColumns({"support": F.lit(None).cast("double"), "margin": F.lit(None).cast("double")})
    return B.assembled(requests, segments, speakers, p, pairs, unresolved)
