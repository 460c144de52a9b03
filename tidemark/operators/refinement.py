"""Refinement of a recording's turns: windows vote against frozen seeds, turns are proposed, and a recording changes as a whole or not at all.

Narrow rows find their turns and overlaps first; vectors join once. A recording's seed prototypes come to its windows as one array (a
recording has few speakers), so that each window is scored in one row. Votes are weighed by one window and one aggregate over the same key. Only
rebuilding clouds is a grouped function, on recordings with proposals only.

Tables: turns (recording_id, turn_idx, start_ms, end_ms, speaker_id), standard (recording_id, speaker_id, start_ms, end_ms), overlaps (recording_id, start_ms, end_ms),
samples (recording_id, speaker_id, sample_idx, start_ms, end_ms, seconds, quality, weight, stitched, vector), clouds (as `clouds.clouds` gives them: status,
purity, prototype and the ids of the inliers). turn_idx and sample_idx are unique within a recording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import clouds as C
from tidemark.operators import joins as J
from tidemark.operators import requests as R
from tidemark.operators.aggregates import dot, weighted_mean_vector

#: A candidate's own cosine, a window's quality and seconds; what a vote needs; what a turn needs; what one window alone needs in a short turn.
OWN, QUALITY, CLEAN_S = 0.55, 0.60, 2.0
TARGET, GAIN, MARGIN = 0.65, 0.10, 0.06
WINDOWS, EVIDENCE_S, SHARE, COVERED = 2, 4.0, 0.75, 0.60
SHORT_MS, SHORT_TARGET, SHORT_GAIN, SHORT_MARGIN, EDGE_MS = 4000, 0.75, 0.15, 0.10, 200
MODES, CHANGES = ("off", "shadow", "conservative"), 100
WHO, TURN, WINDOW = C.WHO, ["recording_id", "turn_idx"], ["recording_id", "sample_idx"]
CHANGE = ("turn_idx", "start_ms", "end_ms", "from_speaker_id", "to_speaker_id", "supporting_windows", "evidence_duration_ms", "evidence_coverage", "weighted_vote_share", "target_cosine", "own_cosine", "similarity_gain", "runner_up_margin", "short_turn_exception")


def unit(vector: Column) -> Column:
    """The vector at length 1; null where it is null, zero or not finite."""
    length = F.sqrt(dot(vector, vector))
    # repeated as an array, the length is taken once and not for each component
    return F.when((length > 1e-12) & (length < float("inf")), F.zip_with(vector, F.array_repeat(length, F.size(vector)), lambda x, n: x / n))


def _weight() -> Column:
    return F.greatest(F.col("quality") * F.col("seconds"), F.lit(1e-6))


def seed_samples(samples: DataFrame, clouds: DataFrame) -> DataFrame:
    """The inliers that no stitching made, of clouds on which a refinement may rest."""
    inliers = clouds.where("prototype is not null").select(*WHO, "status", "purity", F.explode("ids").alias("sample_idx"))
    s = samples.where(~F.col("stitched") & (F.col("quality") < float("inf")) & (F.col("seconds") > 0) & (F.col("seconds") < float("inf")))
    s = s.join(inliers, [*WHO, "sample_idx"])
    stable = R.stable_seeds(s.groupBy(*WHO).agg(F.min("status").alias("status"), F.min("purity").alias("purity"), F.count("*").alias("kept"), F.sum("seconds").alias("kept_s")))
    return s.drop("status", "purity").join(stable.select(*WHO), WHO, "left_semi")


def seeds(samples: DataFrame, clouds: DataFrame) -> DataFrame:
    """recording_id, speaker_id, prototype of the stable seeds, from these samples alone; none where one of them has no direction."""
    s = seed_samples(samples, clouds).select(*WHO, unit(F.col("vector")).alias("vector"), _weight().alias("weight"))
    whole = s.groupBy(*WHO).agg(F.count_if(F.col("vector").isNull()).alias("broken")).where("broken = 0").select(*WHO)
    return weighted_mean_vector(s.where("vector is not null").join(whole, WHO, "left_semi"), WHO).where("prototype is not null")


def placed(turns: DataFrame, samples: DataFrame, clouds: DataFrame) -> DataFrame:
    """Samples without their vectors, with the one turn of their speaker that holds them and whether their cloud counts them in; stitched samples, and those of speakers without a prototype, have no place."""
    have = clouds.where("prototype is not null")
    rows = samples.where("not stitched and start_ms is not null and end_ms > start_ms").select(*WHO, "sample_idx", "start_ms", "end_ms", "seconds", "quality").join(have.select(*WHO), WHO, "left_semi")
    rows = J.sole_container(rows, turns, "sample_idx").where("turn_idx is not null")
    inliers = have.select(*WHO, F.explode("ids").alias("sample_idx")).withColumn("inlier", F.lit(True))
    return rows.join(inliers, [*WHO, "sample_idx"], "left").withColumn("inlier", F.coalesce("inlier", F.lit(False)))


def _active(turns: DataFrame, standard: DataFrame, bucket: int = 60_000) -> DataFrame:
    """The speakers that speak anywhere in each turn by the standard segments."""
    deal = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bucket), F.floor((F.col(e) - 1) / bucket)))
    a = turns.where("end_ms > start_ms").select(*TURN, "start_ms", "end_ms", deal("start_ms", "end_ms").alias("_b"))
    b = standard.where("end_ms > start_ms").select("recording_id", F.col("speaker_id").alias("_who"), F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"), deal("start_ms", "end_ms").alias("_b"))
    met = a.join(b, ["recording_id", "_b"]).where("_e > start_ms and _s < end_ms")
    return met.groupBy(*TURN).agg(F.collect_set("_who").alias("active"))


def evidence(turns: DataFrame, standard: DataFrame, overlaps: DataFrame, samples: DataFrame, clouds: DataFrame) -> DataFrame:
    """Windows good enough to count, each with its weight, its own cosine, its vote (`to` and cosines; null if it has none) and the speakers that it speaks against."""
    good = placed(turns, samples, clouds).where((F.col("quality") >= QUALITY) & (F.col("quality") < float("inf")) & (F.col("seconds") >= CLEAN_S) & (F.col("seconds") < float("inf")))
    good = J.overlaps(good, overlaps, "sample_idx").where("not has_overlap").drop("has_overlap")
    own = clouds.select(*WHO, unit(F.col("prototype")).alias("own"))
    w = good.join(samples.select(*WINDOW, unit(F.col("vector")).alias("v")).where("v is not null"), WINDOW).join(own, WHO)
    w = w.withColumn("own_cosine", dot(F.col("v"), F.col("own"))).drop("own")
    known = seeds(samples, clouds).groupBy("recording_id").agg(F.collect_list(F.struct("speaker_id", "prototype")).alias("seeds"))
    w = w.join(known, "recording_id", "left").join(_active(turns, standard), TURN, "left")
    active = F.coalesce("active", F.array().cast("array<string>"))
    scored = F.transform("seeds", lambda s: F.struct(dot(F.col("v"), s["prototype"]).alias("cosine"), s["speaker_id"].alias("to")))
    w = w.withColumn("scored", F.coalesce(scored, F.array().cast("array<struct<cosine:double,to:string>>"))).drop("seeds", "v")
    # the likest first, the earlier speaker of equals
    ranked = F.array_sort(F.transform(F.filter("scored", lambda s: (s["to"] != F.col("speaker_id")) & ~F.array_contains(active, s["to"])), lambda s: F.struct((-s["cosine"]).alias("c"), s["to"].alias("to"))))
    w = w.withColumn("ranked", ranked).withColumn("target_cosine", -F.get("ranked", F.lit(0))["c"])
    w = w.withColumn("similarity_gain", F.col("target_cosine") - F.col("own_cosine")).withColumn("runner_up_margin", F.col("target_cosine") - F.coalesce(-F.get("ranked", F.lit(1))["c"], F.lit(-1.0)))
    votes = ~(F.col("inlier") & (F.col("own_cosine") >= OWN)) & (F.col("target_cosine") >= TARGET) & (F.col("similarity_gain") >= GAIN) & (F.col("runner_up_margin") >= MARGIN)
    against = F.transform(F.filter("scored", lambda s: (F.col("own_cosine") >= TARGET) & (F.col("own_cosine") - s["cosine"] >= MARGIN)), lambda s: s["to"])
    return w.select(*TURN, "sample_idx", "speaker_id", "start_ms", "end_ms", "seconds", _weight().alias("weight"), "own_cosine", F.when(votes, F.get("ranked", F.lit(0))["to"]).alias("to"), "target_cosine", "similarity_gain", "runner_up_margin", against.alias("against"))


def turn_votes(windows: DataFrame) -> DataFrame:
    """The evidence of each turn that has a vote: targets, how much of the weight votes, seconds and milliseconds covered, weighted means, and the speakers spoken against."""
    vote = F.col("to").isNotNull()
    over = W.partitionBy(*TURN).orderBy("start_ms", "end_ms", "sample_idx").rowsBetween(W.unboundedPreceding, -1)
    reach = F.max(F.when(vote, F.col("end_ms"))).over(over)
    rows = windows.withColumn("fresh", F.when(vote, F.greatest(F.col("end_ms") - F.greatest(F.col("start_ms"), F.coalesce(reach, F.col("start_ms"))), F.lit(0))))
    mine = lambda c: F.sum(F.when(vote, F.col(c) * F.col("weight"))) / F.sum(F.when(vote, F.col("weight")))
    length = F.least(F.col("seconds"), (F.col("end_ms") - F.col("start_ms")) / 1000)
    return rows.groupBy(*TURN).agg(
        F.count_if(vote).alias("supporting_windows"), F.array_sort(F.collect_set("to")).alias("targets"), F.array_distinct(F.flatten(F.collect_set("against"))).alias("against"),
        (F.coalesce(F.sum(F.when(vote, F.col("weight"))), F.lit(0.0)) / F.sum("weight")).alias("share"), F.sum(F.when(vote, length)).alias("evidence_s"), F.sum("fresh").alias("covered_ms"),
        F.min(F.when(vote, F.col("start_ms"))).alias("first_ms"), F.max(F.when(vote, F.col("end_ms"))).alias("last_ms"), *[mine(c).alias(c) for c in ("target_cosine", "own_cosine", "similarity_gain", "runner_up_margin")],
    ).where("supporting_windows > 0")


def proposals(turns: DataFrame, windows: DataFrame) -> DataFrame:
    """recording_id and CHANGE of each turn that should have another speaker: one target only, nothing spoken against it, and enough evidence (in a short turn, one strong window that covers it)."""
    t = turns.select(*TURN, "start_ms", "end_ms", F.col("speaker_id").alias("from_speaker_id"))
    p = turn_votes(windows).where("size(targets) = 1").withColumn("to_speaker_id", F.get("targets", F.lit(0))).where("not array_contains(against, to_speaker_id)").join(t, TURN)
    length = F.col("end_ms") - F.col("start_ms")
    covered, n = F.col("covered_ms") / F.greatest(length, F.lit(1)), F.col("supporting_windows")
    regular = (n >= WINDOWS) & (F.col("evidence_s") >= EVIDENCE_S) & (F.col("share") >= SHARE) & (covered >= COVERED)
    safe_start, safe_end = F.least("end_ms", F.col("start_ms") + EDGE_MS), F.greatest("start_ms", F.col("end_ms") - EDGE_MS)
    thin = safe_end <= safe_start
    whole = (F.col("first_ms") <= F.when(thin, F.col("start_ms")).otherwise(safe_start)) & (F.col("last_ms") >= F.when(thin, F.col("end_ms")).otherwise(safe_end))
    strong = (F.col("target_cosine") >= SHORT_TARGET) & (F.col("similarity_gain") >= SHORT_GAIN) & (F.col("runner_up_margin") >= SHORT_MARGIN)
    short = ~regular & (length < SHORT_MS) & (n == 1) & (F.col("share") >= SHARE) & whole & strong
    p = p.withColumns({"short_turn_exception": short, "evidence_duration_ms": F.round(F.col("evidence_s") * 1000).cast("bigint"), "evidence_coverage": F.round(covered, 6), "weighted_vote_share": F.round("share", 6)}).where(regular | short)
    return p.withColumns({c: F.round(c, 6) for c in ("target_cosine", "own_cosine", "similarity_gain", "runner_up_margin")}).select("recording_id", *CHANGE)


def relabelled(turns: DataFrame, samples: DataFrame, clouds: DataFrame, changes: DataFrame) -> DataFrame:
    """Samples of recordings with changes; speaker_id is that of their turn after the changes, old_speaker_id that before."""
    to = placed(turns, samples, clouds).select(*WINDOW, "turn_idx").join(changes.select(*TURN, "to_speaker_id"), TURN).select(*WINDOW, "to_speaker_id")
    rows = samples.join(changes.select("recording_id").distinct(), "recording_id", "left_semi").join(to, WINDOW, "left")
    return rows.withColumn("old_speaker_id", F.col("speaker_id")).withColumn("speaker_id", F.coalesce("to_speaker_id", "speaker_id")).drop("to_speaker_id")


def rebuilt(turns: DataFrame, samples: DataFrame, clouds: DataFrame, changes: DataFrame) -> DataFrame:
    """The clouds of recordings with changes, built again from the same samples."""
    return C.clouds(relabelled(turns, samples, clouds, changes))


def checked(turns: DataFrame, standard: DataFrame, samples: DataFrame, clouds: DataFrame, changes: DataFrame, new_clouds: DataFrame) -> DataFrame:
    """recording_id and `reason` of recordings with changes: the first invariant that all its changes together break, null if none."""
    some = changes.select("recording_id").distinct()
    t = turns.join(some, "recording_id", "left_semi").join(changes.select(*TURN, "to_speaker_id"), TURN, "left")
    t = t.withColumns({"new_start_ms": F.col("start_ms"), "new_end_ms": F.col("end_ms"), "new_speaker_id": F.coalesce("to_speaker_id", "speaker_id")})
    now = relabelled(turns, samples, clouds, changes).select(*WINDOW, (F.col("speaker_id") == F.col("old_speaker_id")).alias("stays"))
    held = seed_samples(samples, clouds).join(now, WINDOW).groupBy(*WHO).agg(F.count_if("stays").alias("kept"), F.coalesce(F.sum(F.when(F.col("stays"), F.col("seconds"))), F.lit(0.0)).alias("kept_s"))
    both = clouds.select(*WHO, "status").join(new_clouds.select(*WHO, F.col("status").alias("new_status")), WHO)
    return R.rollback_reasons(t, standard, held, both)


def report(turns: DataFrame, windows: DataFrame, changes: DataFrame, reasons: DataFrame | None, mode: str = "conservative") -> DataFrame:
    """One row a recording: mode, status (disabled, not_needed, shadow, rejected, applied), counts, reassigned_duration_ms, rollback_reason, and the first CHANGES changes in the order of time."""
    if mode not in MODES:
        raise ValueError(f"speaker refinement is one of {', '.join(MODES)}")
    rows = turns.select("recording_id").distinct().withColumn("mode", F.lit(mode))
    zero = F.lit(0).cast("bigint")
    if mode == "off":
        none = F.array().cast("array<struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in changes.select(*CHANGE).schema) + ">>")
        return rows.select("recording_id", "mode", F.lit("disabled").alias("status"), *[zero.alias(c) for c in ("eligible_windows", "proposed_turns", "applied_turns", "reassigned_duration_ms")], F.lit(None).cast("string").alias("rollback_reason"), none.alias("changes"), F.lit(False).alias("changes_truncated"))
    seen = windows.groupBy("recording_id").agg(F.count("*").alias("eligible_windows"))
    totals = changes.groupBy("recording_id").agg(F.count("*").alias("proposed_turns"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("moved_ms"))
    first = R.first_changes(changes.withColumn("_at", F.struct("start_ms", "end_ms", "from_speaker_id", "to_speaker_id", "turn_idx")), ["recording_id"], "_at", CHANGES)
    first = first.groupBy("recording_id").agg(F.sort_array(F.collect_list(F.struct("_at", F.struct(*CHANGE).alias("c")))).alias("x"), F.max("truncated").alias("changes_truncated"))
    rows = rows.join(seen, "recording_id", "left").join(totals, "recording_id", "left").join(first.withColumn("changes", F.transform("x", lambda x: x["c"])).drop("x"), "recording_id", "left")
    rows = rows.join(reasons.withColumnRenamed("reason", "rollback_reason"), "recording_id", "left") if reasons is not None and mode == "conservative" else rows.withColumn("rollback_reason", F.lit(None).cast("string"))
    n = F.coalesce("proposed_turns", zero)
    status = F.when(n == 0, "not_needed").when(F.lit(mode == "shadow"), "shadow").when(F.col("rollback_reason").isNotNull(), "rejected").otherwise("applied")
    done = F.col("status") == "applied"
    rows = rows.withColumn("status", status).withColumn("changes", F.coalesce("changes", F.array()))
    return rows.select("recording_id", "mode", "status", F.coalesce("eligible_windows", zero).alias("eligible_windows"), n.alias("proposed_turns"), F.when(done, n).otherwise(0).alias("applied_turns"), F.when(done, F.col("moved_ms")).otherwise(0).alias("reassigned_duration_ms"), "rollback_reason", "changes", F.coalesce("changes_truncated", F.lit(False)).alias("changes_truncated"))


def applied(turns: DataFrame, changes: DataFrame, reasons: DataFrame) -> DataFrame:
    """turns with original_speaker_id; speaker_id is the new one in recordings whose changes break nothing."""
    fine = changes.join(reasons.where("reason is null"), "recording_id", "left_semi").select(*TURN, "to_speaker_id")
    return turns.join(fine, TURN, "left").withColumn("original_speaker_id", F.col("speaker_id")).withColumn("speaker_id", F.coalesce("to_speaker_id", "speaker_id")).drop("to_speaker_id")


def effective_clouds(clouds: DataFrame, new_clouds: DataFrame, reasons: DataFrame) -> DataFrame:
    """The rebuilt clouds of recordings whose changes were applied, the original ones of all others."""
    fine = reasons.where("reason is null").select("recording_id")
    return clouds.join(fine, "recording_id", "left_anti").unionByName(new_clouds.join(fine, "recording_id", "left_semi"), allowMissingColumns=True)
