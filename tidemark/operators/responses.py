"""Responses: why speakers stay unresolved, languages of speakers and turns of a request, transcript segments, and one document a recording.

Parts of a document are aggregated each by its own recording into arrays in a fixed order, and joined by recording; a document is as long as its recording and
no group function sees it. A field that does not apply is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import repetition as P
from tidemark.functions import text as X
from tidemark.operators import aggregates as A
from tidemark.operators import assembly as Y
from tidemark.operators import clouds as C
from tidemark.operators import joins as J
from tidemark.operators import languages as L

#: Reasons of speakers without a candidate.
NO_EMBEDDING, NO_PROFILE = "embedding_evidence_unavailable", "profile_evidence_unavailable"
REC, WHO = "recording_id", C.WHO


def mutual_matches(clouds: DataFrame, profiles: DataFrame, keys: Sequence[str] = (REC,)) -> DataFrame:
    """recording_id, profile_id, speaker_id, cosine, accepted of profiles (recording_id, profile_id, profile) and speakers that are each other's likest, from the cosine of a candidate on.

    For requests whose profiles and speakers are one vector each; `clouds.matches` solves the whole assignment.
    """
    e = clouds.where("prototype is not null").select(*WHO, "prototype").join(profiles, list(keys)).select(*WHO, "profile_id", A.dot(F.col("prototype"), F.col("profile")).alias("cosine"))
    first = lambda k, other: F.row_number().over(W.partitionBy(REC, k).orderBy(F.desc("cosine"), other))
    e = e.withColumns({"_a": first("speaker_id", "profile_id"), "_b": first("profile_id", "speaker_id")})
    return e.where((F.col("_a") == 1) & (F.col("_b") == 1) & (F.col("cosine") >= C.TENTATIVE)).select(REC, "profile_id", "speaker_id", "cosine", (F.col("cosine") >= C.MATCH).alias("accepted"))


def unresolved_profiles(profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """recording_id, profile_id of the profiles that no speaker was accepted for."""
    return profiles.select(REC, "profile_id").distinct().join(pairs.where("accepted").select(REC, "profile_id"), [REC, "profile_id"], "left_anti")


def unresolved_speakers(clouds: DataFrame, profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """recording_id, speaker_id, candidate_id, reason of the speakers that are neither known nor certainly unknown.

    profiles: recording_id, profile_id, usable. Without a usable profile, or without a speaker that has a prototype, all speakers of a recording with profiles are unresolved.
    Else the tentative pairs are; where profiles are left over, speakers without a prototype are; and where a profile is not usable, all that are left.
    """
    p = profiles.groupBy(REC).agg(F.max("usable").alias("some"), F.min("usable").alias("all"))
    has = F.max(F.col("prototype").isNotNull()).over(W.partitionBy(REC))
    left = unresolved_profiles(profiles, pairs).select(REC).distinct().withColumn("open", F.lit(True))
    mine = pairs.select(*WHO, F.when(~F.col("accepted"), F.col("profile_id")).alias("candidate_id"), "accepted")
    s = clouds.select(*WHO, "status", "prototype").withColumn("has", has).join(p, REC).join(left, REC, "left").join(mine, WHO, "left")
    reason = (
        F.when(~F.col("some"), NO_PROFILE).when(~F.col("has"), NO_EMBEDDING).when(F.col("accepted"), "").when(F.col("candidate_id").isNotNull(), "tentative")
        .when(F.col("open") & (F.col("status") != "ready") & F.col("prototype").isNull(), NO_EMBEDDING).when(~F.col("all"), NO_PROFILE)
    )
    s = s.withColumn("reason", reason).where("reason != ''")
    tentative = F.col("reason") == "tentative"
    return s.select(*WHO, F.when(tentative, F.col("candidate_id")).alias("candidate_id"), F.when(~tentative, F.col("reason")).alias("reason"))


def item_languages(items: DataFrame, scores: DataFrame, item: str = "item_idx", keys: Sequence[str] = (REC,), fallback: int = L.FALLBACK) -> DataFrame:
    """items (keys, item, seconds) with code_idx and probability, pooled from their windows' scores (keys, item, seconds of the window, code_idx, p), and `smoothed`, their language over the file.

    Windows go to their item by pooled logarithms, items to the file's majority and back; items without scores, or too short to be judged, follow the majority.
    """
    pooled = A.pooled_language(scores, [*keys, item])
    rows = items.join(pooled, [*keys, item], "left")
    return L.smoothed_chunks(rows, keys, fallback)


def turn_languages(turns: DataFrame, speakers: DataFrame, fallback: int = L.FALLBACK) -> DataFrame:
    """turns with prior, code and source: a turn keeps its speaker's language unless its own detection is long and sure enough of another one.

    turns: recording_id, turn_idx, speaker_id, seconds, code_idx, probability; speakers: recording_id, speaker_id, resolved, source, speech_s. A speaker that was not
    judged has the recording's dominant language, that with most speech.
    """
    by = speakers.groupBy(REC, "resolved").agg(F.sum("speech_s").alias("s"))
    dominant = by.groupBy(REC).agg(F.max_by("resolved", F.struct(F.col("s"), (-F.col("resolved")).alias("c"))).alias("dominant"))
    t = turns.join(speakers.select(*WHO, "resolved"), WHO, "left").join(dominant, REC, "left")
    prior = F.coalesce("resolved", "dominant", F.lit(fallback))
    other = F.coalesce((F.col("seconds") >= L.PIECE_S) & (F.col("probability") >= L.OTHER_P) & (F.col("code_idx") != prior), F.lit(False))
    t = t.withColumns({"prior": prior, "code": F.when(other, F.col("code_idx")).otherwise(prior), "source": F.when(other, "turn").otherwise("speaker")})
    return t.drop("resolved", "dominant")


def language_decision(turns: DataFrame, speakers: DataFrame, fallback: int = L.FALLBACK) -> DataFrame:
    """recording_id, code, seconds (array of code and seconds) of a request: speakers' seconds by their language, from which turns that differ take theirs; the one with most is the request's."""
    t = turn_languages(turns, speakers, fallback).where("code != prior")
    moved = t.select(REC, F.col("prior").alias("code"), (-F.col("seconds")).alias("s")).union(t.select(REC, "code", F.col("seconds").alias("s")))
    rows = speakers.select(REC, F.col("resolved").alias("code"), F.col("speech_s").alias("s")).union(moved)
    by = rows.groupBy(REC, "code").agg(F.greatest(F.sum("s"), F.lit(0.0)).alias("s"))
    some = F.max("s").over(W.partitionBy(REC)) > 0
    by = by.withColumn("_some", some).where("s > 0 or not _some")
    return by.groupBy(REC).agg(F.max_by("code", F.struct(F.col("s"), (-F.col("code")).alias("c"))).alias("code"), F.sort_array(F.collect_list(F.struct("code", F.round("s", 1).alias("seconds")))).alias("seconds"))


def transcript_segments(turns: DataFrame, overlaps: DataFrame, filtered: bool = True, gated: bool = True) -> DataFrame:
    """The segments of a request: turns (recording_id, turn_idx, start_ms, end_ms, speaker_id, original_speaker_id, chunks) with their chunks' texts joined.

    chunks are texts in order; null and blank ones do not count. With gated, text without a letter or digit is dropped from short turns and marked asr_failure, uncleaned, in longer ones.
    """
    text = F.array_join(F.filter(F.transform(F.coalesce("chunks", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), " ")
    rows = turns.withColumn("text", P.fold_repeats(text) if filtered else text).withColumn("asr_failure", F.lit(False))
    if gated:
        rows = rows.withColumn("_clean", P.clean_segment(F.col("text")))
        rows = rows.withColumn("_what", X.disposition(F.col("_clean"), F.col("end_ms") - F.col("start_ms"))).where("_what != 'drop'")
        rows = rows.withColumn("asr_failure", F.col("_what") == "asr_failure").withColumn("text", F.when(F.col("asr_failure"), F.trim("text")).otherwise(F.col("_clean")))
    rows = J.overlaps(rows.where("text != ''"), overlaps, "turn_idx")
    refined = F.when(F.col("original_speaker_id").isNotNull(), F.col("speaker_id"))
    return rows.select(REC, F.col("turn_idx").alias("index"), "start_ms", "end_ms", F.coalesce("original_speaker_id", "speaker_id").alias("diarization_speaker_id"), refined.alias("refined_diarization_speaker_id"), "text", F.col("has_overlap").alias("overlap"), "asr_failure")


def _listed(rows: DataFrame, order: Sequence[str], item: Column, name: str) -> DataFrame:
    """recording_id and an array of the items in order."""
    lists = rows.groupBy(REC).agg(F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("o"), item.alias("x")))).alias(name))
    return lists.withColumn(name, F.transform(name, lambda e: e["x"]))


def named_speakers(segments: DataFrame, speakers: DataFrame, pairs: DataFrame, unresolved: DataFrame, known: DataFrame) -> DataFrame:
    """recording_id, speaker_id, public_id, kind of every label that speakers or segments have."""
    label = F.coalesce("refined_diarization_speaker_id", "diarization_speaker_id").alias("speaker_id")
    labels = speakers.select(*WHO).union(segments.select(REC, label)).distinct()
    accepted = pairs.where("accepted").select(*WHO, "profile_id")
    public = Y.public_ids(labels.join(accepted, WHO, "left_anti"), known.select(REC, F.col("profile_id").alias("known_id")))
    return Y.named(labels, accepted, unresolved, public)


def assembled(requests: DataFrame, segments: DataFrame, speakers: DataFrame, profiles: DataFrame, pairs: DataFrame, unresolved: DataFrame) -> DataFrame:
    """recording_id and document (JSON) of each request.

    requests: recording_id, expected, language; segments: as transcript_segments gives them, with language and language_source; speakers: recording_id, speaker_id, status, purity,
    candidates, kept, discarded, shown (embeddings shown), language, language_source; profiles: recording_id, profile_id; pairs: profile_id, speaker_id, cosine,
    support, margin, accepted; unresolved: as unresolved_speakers gives them.
    """
    names = named_speakers(segments, speakers, pairs, unresolved, profiles)
    label = F.coalesce("refined_diarization_speaker_id", "diarization_speaker_id")
    seg = segments.withColumn("_label", label).join(names.select(REC, F.col("speaker_id").alias("_label"), "public_id", "kind"), [REC, "_label"])
    seg = seg.withColumn("speaker_id", F.col("public_id"))
    item = F.struct("index", "start_ms", "end_ms", "diarization_speaker_id", "refined_diarization_speaker_id", "text", "overlap", "asr_failure", "speaker_id", F.col("kind").alias("speaker_kind"), "language", "language_source")
    seg = _listed(seg, ["index"], item, "segments")
    accepted = pairs.where("accepted").select(*WHO, "cosine", "support", "margin")
    tentative = pairs.where("not accepted").select(*WHO, F.col("cosine").alias("_c"), F.col("support").alias("_s"), F.col("margin").alias("_m"))
    s = speakers.join(names, WHO).join(accepted, WHO, "left").join(unresolved.select(*WHO, "candidate_id", "reason"), WHO, "left").join(tentative, WHO, "left")
    number = lambda a, b: F.round(F.coalesce(a, F.when(F.col("candidate_id").isNotNull(), F.col(b))), 6)
    s = s.withColumns({"cosine": number("cosine", "_c"), "support": number("support", "_s"), "margin": number("margin", "_m")})
    match = [F.col("candidate_id").alias("candidate_speaker_id"), F.col("cosine").alias("cosine_similarity"), "support", F.col("margin").alias("stability_margin"), "reason"]
    assignment = F.struct(F.col("speaker_id").alias("diarization_speaker_id"), F.col("public_id").alias("speaker_id"), "kind", F.col("status").alias("embedding_status"), *match, "language", "language_source")
    public = F.struct(
        F.col("public_id").alias("speaker_id"), F.col("speaker_id").alias("diarization_speaker_id"), F.col("kind").alias("speaker_kind"), F.col("status").alias("embedding_status"), "shown",
        (F.col("kept") > F.greatest(F.col("shown") - 1, F.lit(0))).alias("embeddings_truncated"), F.col("candidates").alias("candidate_count"), F.col("kept").alias("retained_count"), F.col("discarded").alias("discarded_outliers"), F.round("purity", 6).alias("purity"), *match,
    )
    kind = F.col("kind")
    none = lambda kind: F.lit(None).cast(kind)
    code = F.when(kind == "known", "KNOWN_SPEAKER_IMPERFECT_CLUSTER").otherwise("SPEAKER_EMBEDDING_QUALITY")
    warning = F.struct(code.alias("code"), F.when(kind == "known", F.col("public_id")).otherwise(F.col("speaker_id")).alias("speaker_id"), F.when(kind == "known", F.col("speaker_id")).alias("diarization_speaker_id"), F.col("status").alias("status"), none("array<string>").alias("speaker_ids"), none("bigint").alias("expected"), none("bigint").alias("detected"))
    own = _listed(s.withColumns({"_assignment": assignment, "_public": public, "_warning": F.when(F.col("status") != "ready", warning)}), ["speaker_id"], F.struct("_assignment", "_public", "_warning", "kind"), "all")
    take = lambda c, *kinds: F.transform(F.filter("all", lambda x: x["kind"].isin(*kinds)), lambda x: x[c])
    left = _listed(unresolved_profiles(profiles, pairs), ["profile_id"], F.col("profile_id"), "unresolved_known_speakers")
    given = profiles.groupBy(REC).agg(F.countDistinct("profile_id").alias("known_provided"))
    r = requests.join(seg, REC, "left").join(own, REC, "left").join(left, REC, "left").join(given, REC, "left")
    for c in ("segments", "all", "unresolved_known_speakers"):
        r = r.withColumn(c, F.coalesce(c, F.array()))
    kinds = ("known", "unknown", "unresolved")
    r = r.withColumns({"detected": F.size("all").cast("bigint"), "_assignments": take("_assignment", *kinds), "_unknown": take("_public", "unknown"), "_unresolved": take("_public", "unresolved"), "_known": F.size(take("kind", "known")).cast("bigint")})
    extra = lambda code, **more: F.struct(F.lit(code).alias("code"), none("string").alias("speaker_id"), none("string").alias("diarization_speaker_id"), none("string").alias("status"), *[more.get(c, none(k)).alias(c) for c, k in (("speaker_ids", "array<string>"), ("expected", "bigint"), ("detected", "bigint"))])
    warnings = F.array_compact(F.concat(take("_warning", *kinds), F.array(
        F.when(F.size("unresolved_known_speakers") > 0, extra("KNOWN_SPEAKERS_UNRESOLVED", speaker_ids=F.col("unresolved_known_speakers"))),
        F.when(F.col("expected").isNotNull() & (F.col("expected") != F.col("detected")), extra("EXPECTED_SPEAKER_COUNT_MISMATCH", expected=F.col("expected"), detected=F.col("detected"))),
    )))
    document = F.struct(
        F.struct(F.trim(F.array_join(F.transform("segments", lambda x: x["text"]), " ")).alias("text"), "language", "segments").alias("transcript"),
        F.struct("expected", "detected", F.coalesce("known_provided", F.lit(0)).alias("known_provided"), F.col("_known").alias("known_assigned"), F.size("_unknown").alias("unknown"), F.size("_unresolved").alias("unresolved")).alias("speaker_counts"),
        F.col("_assignments").alias("speaker_assignments"), F.col("_unknown").alias("unknown_speakers"), F.col("_unresolved").alias("unresolved_speakers"), "unresolved_known_speakers", warnings.alias("warnings"),
    )
    return r.select(REC, F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))
