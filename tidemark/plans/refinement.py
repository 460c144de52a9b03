"""Registered queries on the refinement of turns, with their DuckDB SQL.

Seeds, votes, proposals and checks are held against SQL with clouds of one component each, which SQL can build; `rf_rebuild` and `rf_refine` build the
clouds of `clouds.clouds`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import clouds as C
from tidemark.operators import refinement as N
from tidemark.sources import views as V
from tidemark.sources.steps import kept
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


def _mean(name: str, rows: str) -> str:
    """SQL of the weighted means of rows' vectors by recording and speaker."""
    return f"""{name}_x AS (SELECT recording_id, speaker_id, weight, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM {rows}),
{name}_m AS (SELECT recording_id, speaker_id, i, sum(weight * x) / sum(weight) AS m FROM {name}_x GROUP BY ALL),
{name} AS (SELECT recording_id, speaker_id, list(m ORDER BY i) AS v FROM {name}_m GROUP BY ALL)"""


def _clouds(name: str, rows: str) -> str:
    return f"""{_mean(f"{name}_p", rows)},
{name}_n AS (SELECT s.*, list_cosine_similarity(s.vector, p.v) AS own FROM {rows} s JOIN {name}_p p USING (recording_id, speaker_id)),
{name}_k AS (SELECT recording_id, speaker_id, coalesce(sum(weight) FILTER (own >= 0.45), 0) / sum(weight) AS purity, count(*) AS candidates, count(*) FILTER (own >= 0.45) AS kept, sum(seconds) FILTER (own >= 0.45) AS kept_s FROM {name}_n GROUP BY ALL),
{name} AS (SELECT *, CASE WHEN purity < 0.6 THEN 'mixed_cluster' WHEN kept >= 2 AND kept_s >= 4 THEN 'ready' ELSE 'low_support' END AS status FROM {name}_k)"""


_SEEDS = f"""{S["voice"]}, {_clouds("cloud", "sample")},
good AS (SELECT n.* FROM cloud_n n JOIN cloud c USING (recording_id, speaker_id) WHERE n.own >= 0.45 AND NOT n.stitched AND c.status = 'ready' AND c.purity >= 0.7),
seed_s AS (SELECT * FROM good SEMI JOIN (SELECT recording_id, speaker_id FROM good GROUP BY ALL HAVING count(*) >= 3 AND sum(seconds) >= 6) USING (recording_id, speaker_id)),
{_mean("seed", "seed_s")}"""

_EVIDENCE = f"""{_SEEDS},
standard AS (SELECT recording_id, speaker_id, start_ms, end_ms + 400 AS end_ms FROM voice_turn),
ev AS (
  SELECT n.*, t.turn_idx AS turn FROM cloud_n n JOIN voice_turn t ON t.recording_id = n.recording_id AND t.speaker_id = n.speaker_id AND t.start_ms <= n.start_ms AND n.end_ms <= t.end_ms
  WHERE NOT n.stitched QUALIFY count(*) OVER (PARTITION BY n.recording_id, n.sample_idx) = 1
), ok AS (
  SELECT * FROM ev WHERE quality >= 0.6 AND seconds >= 2 AND NOT EXISTS (SELECT 1 FROM voice_overlap o WHERE o.recording_id = ev.recording_id AND o.end_ms > ev.start_ms AND o.start_ms < ev.end_ms)
), score AS (
  SELECT ok.recording_id, ok.sample_idx, ok.turn, ok.own, s.speaker_id AS goal, list_cosine_similarity(ok.vector, s.v) AS c,
    s.speaker_id <> ok.speaker_id AND NOT EXISTS (SELECT 1 FROM standard x JOIN voice_turn t ON t.recording_id = x.recording_id AND x.end_ms > t.start_ms AND x.start_ms < t.end_ms WHERE t.recording_id = ok.recording_id AND t.turn_idx = ok.turn AND x.speaker_id = s.speaker_id) AS free
  FROM ok JOIN seed s ON s.recording_id = ok.recording_id
), best AS (
  SELECT recording_id, sample_idx, goal, c, c - own AS gain, c - coalesce(lead(c) OVER w, -1) AS margin FROM score WHERE free WINDOW w AS (PARTITION BY recording_id, sample_idx ORDER BY c DESC, goal) QUALIFY row_number() OVER w = 1
), win AS (
  SELECT ok.*, b.c, b.gain, b.margin, CASE WHEN NOT ok.own >= 0.55 AND b.c >= 0.65 AND b.gain >= 0.1 AND b.margin >= 0.06 THEN b.goal END AS goal FROM ok LEFT JOIN best b USING (recording_id, sample_idx)
), vote AS (
  SELECT recording_id, turn AS turn_idx, count(goal) AS n, count(DISTINCT goal) AS targets, min(goal) AS goal, sum(weight) FILTER (goal IS NOT NULL) / sum(weight) AS share, sum(least(seconds, (end_ms - start_ms) / 1000)) FILTER (goal IS NOT NULL) AS evidence_s,
    sum(end_ms - start_ms) FILTER (goal IS NOT NULL) AS covered, {", ".join(f"sum({a} * weight) FILTER (goal IS NOT NULL) / sum(weight) FILTER (goal IS NOT NULL) AS {b}" for a, b in (("c", "c"), ("own", "own"), ("gain", "gain"), ("margin", "margin")))} FROM win GROUP BY ALL HAVING count(goal) > 0
), change AS (
  SELECT v.*, t.start_ms, t.end_ms, t.speaker_id FROM vote v JOIN voice_turn t USING (recording_id, turn_idx)
  WHERE targets = 1 AND n >= 2 AND evidence_s >= 4 AND share >= 0.75 AND covered / (t.end_ms - t.start_ms) >= 0.6
    AND NOT EXISTS (SELECT 1 FROM score x WHERE x.recording_id = v.recording_id AND x.turn = v.turn_idx AND x.goal = v.goal AND x.own >= 0.65 AND x.own - x.c >= 0.06)
)"""


def _inputs(spark: SparkSession, d: str, clouds: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Turns, standard segments (which run 0.4 s into the next turn), overlaps, samples and clouds."""
    s = kept(V.voice_sample(spark, d), "samples")
    t = kept(V.turns_of(s), "turns")
    return t, t.select("recording_id", "speaker_id", "start_ms", (F.col("end_ms") + 400).alias("end_ms")), V.overlaps_of(s), s.drop("turn_idx"), kept(clouds(s), "clouds")


@query("rf_seed", f"WITH {_SEEDS} SELECT s.recording_id, s.speaker_id, s.sample_idx, round(list_cosine_similarity(s.vector, p.v), 6) AS cosine FROM seed_s s JOIN seed p USING (recording_id, speaker_id)")
def rf_seed(spark: SparkSession, d: str) -> DataFrame:
    """The samples of each stable seed, and their cosines to the prototype that is frozen from them."""
    _, _, _, s, c = _inputs(spark, d, C.plain_clouds)
    rows = N.seed_samples(s, c).join(N.seeds(s, c), C.WHO)
    return rows.select(*C.WHO, "sample_idx", F.round(C.dot(F.col("vector"), F.col("prototype")), 6).alias("cosine"))


@query("agg_votes", f"WITH {_EVIDENCE} SELECT recording_id, turn_idx, n AS windows, CAST(targets AS BIGINT) AS targets, round(share, 6) AS share, CAST(covered AS BIGINT) AS covered_ms FROM vote")
def agg_votes(spark: SparkSession, d: str) -> DataFrame:
    """What votes in each turn: windows, their targets, share of the weight, and milliseconds."""
    v = N.turn_votes(N.evidence(*_inputs(spark, d, C.plain_clouds)))
    return v.select("recording_id", "turn_idx", F.col("supporting_windows").alias("windows"), F.size("targets").cast("bigint").alias("targets"), F.round("share", 6).alias("share"), F.col("covered_ms"))


@query(
    "rf_propose",
    f"WITH {_EVIDENCE} SELECT recording_id, turn_idx, start_ms, end_ms, speaker_id AS from_speaker_id, goal AS to_speaker_id, n AS supporting_windows, CAST(round(evidence_s * 1000) AS BIGINT) AS evidence_duration_ms, round(covered / (end_ms - start_ms), 6) AS evidence_coverage, round(share, 6) AS weighted_vote_share, round(c, 6) AS target_cosine, round(own, 6) AS own_cosine, round(gain, 6) AS similarity_gain, round(margin, 6) AS runner_up_margin, false AS short_turn_exception FROM change",
)
def rf_propose(spark: SparkSession, d: str) -> DataFrame:
    t, *rest = _inputs(spark, d, C.plain_clouds)
    return N.proposals(t, kept(N.evidence(t, *rest), "evidence"))


@query(
    "agg_rollback",
    f"""WITH {_EVIDENCE},
new_t AS (SELECT t.*, coalesce(c.goal, t.speaker_id) AS now FROM voice_turn t LEFT JOIN change c USING (recording_id, turn_idx) WHERE t.recording_id IN (SELECT recording_id FROM change)),
new_s AS (SELECT s.* REPLACE (coalesce(c.goal, s.speaker_id) AS speaker_id), c.goal IS NULL AS stays FROM sample s LEFT JOIN ev e USING (recording_id, sample_idx) LEFT JOIN change c ON c.recording_id = s.recording_id AND c.turn_idx = e.turn WHERE s.recording_id IN (SELECT recording_id FROM change)),
{_clouds("again", "new_s")},
a AS (SELECT recording_id, list_sort(list(DISTINCT speaker_id)) <> list_sort(list(DISTINCT now)) AS others, sum(end_ms - start_ms) AS all_ms, coalesce(sum(end_ms - start_ms) FILTER (now <> speaker_id), 0) AS moved FROM new_t GROUP BY ALL),
hit AS (SELECT DISTINCT t.recording_id FROM new_t t JOIN standard x ON x.recording_id = t.recording_id AND x.speaker_id = t.now AND t.now <> t.speaker_id AND x.end_ms > t.start_ms AND x.start_ms < t.end_ms),
lost AS (SELECT DISTINCT recording_id FROM (SELECT s.recording_id, s.speaker_id, count(*) FILTER (n.stays) AS kept, coalesce(sum(s.seconds) FILTER (n.stays), 0) AS kept_s FROM seed_s s JOIN new_s n USING (recording_id, sample_idx) GROUP BY ALL) WHERE kept < 3 OR kept_s < 6),
mixed AS (SELECT DISTINCT c.recording_id FROM cloud c JOIN again n USING (recording_id, speaker_id) WHERE c.status = 'ready' AND n.status = 'mixed_cluster')
SELECT a.recording_id, CASE WHEN others THEN 'speaker_count_changed' WHEN all_ms <= 0 OR moved > all_ms * 0.1::DOUBLE THEN 'reassigned_speech_exceeds_10_percent' WHEN hit.recording_id IS NOT NULL THEN 'overlap_invariant_violation' WHEN lost.recording_id IS NOT NULL THEN 'seed_core_lost' WHEN mixed.recording_id IS NOT NULL THEN 'ready_cloud_became_mixed_cluster' END AS reason
FROM a LEFT JOIN hit USING (recording_id) LEFT JOIN lost USING (recording_id) LEFT JOIN mixed USING (recording_id)""",
)
def agg_rollback(spark: SparkSession, d: str) -> DataFrame:
    """The first invariant that a recording's proposals break, with clouds built again."""
    t, standard, overlaps, s, c = _inputs(spark, d, C.plain_clouds)
    changes = kept(N.proposals(t, N.evidence(t, standard, overlaps, s, c)), "changes")
    return N.checked(t, standard, s, c, changes, C.plain_clouds(N.relabelled(t, s, c, changes)))


@query("rf_rebuild")
def rf_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """The clouds of recordings with proposals, built again after them."""
    t, standard, overlaps, s, c = _inputs(spark, d, C.clouds)
    changes = kept(N.proposals(t, N.evidence(t, standard, overlaps, s, c)), "changes")
    return N.rebuilt(t, s, c, changes).select(*C.WHO, "status", F.round("purity", 6).alias("purity"), "candidates", "kept", "discarded")


@query("rf_refine")
def rf_refine(spark: SparkSession, d: str) -> DataFrame:
    """What a conservative refinement reports of each recording."""
    t, standard, overlaps, s, c = _inputs(spark, d, C.clouds)
    windows = kept(N.evidence(t, standard, overlaps, s, c), "evidence")
    changes = kept(N.proposals(t, windows), "changes")
    reasons = N.checked(t, standard, s, c, changes, N.rebuilt(t, s, c, changes))
    return N.report(t, windows, changes, reasons)
