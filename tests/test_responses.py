"""Reasons of unresolved speakers, languages of items and turns, segments, and the document of a response."""

import json

from tidemark.operators import responses as B

CLOUDS = "recording_id string, speaker_id string, status string, prototype array<double>"


def test_reasons(spark):
    v = [1.0, 0.0]
    clouds = [("none", "A", "ready", v), ("mixed", "A", "ready", v), ("mixed", "B", "low_support", None), ("bare", "A", "low_support", None), ("left", "A", "ready", v), ("left", "B", "low_support", None), ("left", "C", "ready", v), ("left", "D", "ready", v), ("some", "A", "ready", v), ("some", "B", "ready", v), ("done", "A", "ready", v), ("done", "B", "low_support", None)]
    profiles = [("mixed", "p", False), ("bare", "p", True), ("left", "p", True), ("left", "q", True), ("some", "p", True), ("some", "q", False), ("done", "p", True)]
    pairs = [("left", "p", "A", 0.9, True), ("left", "q", "C", 0.5, False), ("some", "p", "A", 0.9, True), ("done", "p", "A", 0.9, True)]
    c, p = spark.createDataFrame(clouds, CLOUDS), spark.createDataFrame(profiles, "recording_id string, profile_id string, usable boolean")
    m = spark.createDataFrame(pairs, "recording_id string, profile_id string, speaker_id string, cosine double, accepted boolean")
    got = {(r.recording_id, r.speaker_id): (r.candidate_id, r.reason) for r in B.unresolved_speakers(c, p, m).collect()}
    no_profile, no_embedding = (None, B.NO_PROFILE), (None, B.NO_EMBEDDING)
    assert got == {("mixed", "A"): no_profile, ("mixed", "B"): no_profile, ("bare", "A"): no_embedding, ("left", "B"): no_embedding, ("left", "C"): ("q", None), ("some", "B"): no_profile}
    assert sorted((r.recording_id, r.profile_id) for r in B.unresolved_profiles(p, m).collect()) == [("bare", "p"), ("left", "q"), ("mixed", "p"), ("some", "q")]


def test_mutual_matches(spark):
    c = spark.createDataFrame([("r", "A", "ready", [1.0, 0.0]), ("r", "B", "ready", [0.6, 0.8]), ("r", "C", "ready", None), ("s", "A", "ready", [0.0, 1.0])], CLOUDS)
    p = spark.createDataFrame([("r", "p", [0.9, 0.436]), ("r", "q", [0.95, 0.312]), ("s", "p", [0.866, 0.5])], "recording_id string, profile_id string, profile array<double>")
    got = {(r.recording_id, r.profile_id, r.speaker_id): r.accepted for r in B.mutual_matches(c, p).collect()}
    assert got == {("r", "q", "A"): True, ("s", "p", "A"): False}  # p is likest to A, which is likest to q


def test_languages(spark):
    items = spark.createDataFrame([("r", 0, 4.0), ("r", 1, 0.5), ("r", 2, 3.0)], "recording_id string, item_idx int, seconds double")
    scores = [("r", 0, 3.0, 1, 0.9), ("r", 0, 3.0, 2, 0.1), ("r", 0, 1.0, 1, 0.2), ("r", 0, 1.0, 2, 0.8), ("r", 1, 0.5, 1, 0.1), ("r", 1, 0.5, 2, 0.9)]
    got = {r.item_idx: (r.code_idx, r.smoothed) for r in B.item_languages(items, spark.createDataFrame(scores, "recording_id string, item_idx int, seconds double, code_idx int, p double")).collect()}
    assert got == {0: (1, 1), 1: (2, 1), 2: (None, 1)}  # too short, and without scores: the majority
    turns = [("r", 0, "A", 5.0, 2, 0.9), ("r", 1, "A", 5.0, 2, 0.8), ("r", 2, "A", 1.0, 2, 0.99), ("r", 3, "B", 2.0, 1, 0.99), ("r", 4, "new", 2.0, None, None)]
    t = spark.createDataFrame(turns, "recording_id string, turn_idx int, speaker_id string, seconds double, code_idx int, probability double")
    s = spark.createDataFrame([("r", "A", 1, "detected", 11.0), ("r", "B", 3, "majority", 2.0)], "recording_id string, speaker_id string, resolved int, source string, speech_s double")
    got = {r.turn_idx: (r.prior, r.code, r.source) for r in B.turn_languages(t, s).collect()}
    assert got == {0: (1, 2, "turn"), 1: (1, 1, "speaker"), 2: (1, 1, "speaker"), 3: (3, 1, "turn"), 4: (1, 1, "speaker")}
    d = B.language_decision(t, s).first()
    assert d.code == 1 and [(x.code, x.seconds) for x in d.seconds] == [(1, 8.0), (2, 5.0)]  # nothing is left of code 3


def test_segments_and_document(spark):
    turns = [("r", 0, 0, 3000, "A", None, ["so so so so so so", " ", "yes."]), ("r", 1, 3000, 3400, "B", None, ["..."]), ("r", 2, 4000, 6000, "B", "A", [" ?! ", None]), ("r", 3, 7000, 9000, "B", None, None), ("r", 4, 9000, 9900, "A", None, ["Ok"])]
    t = spark.createDataFrame(turns, "recording_id string, turn_idx bigint, start_ms bigint, end_ms bigint, speaker_id string, original_speaker_id string, chunks array<string>")
    o = spark.createDataFrame([("r", 2500, 3200)], "recording_id string, start_ms bigint, end_ms bigint")
    seg = B.transcript_segments(t, o)
    got = {r["index"]: (r.diarization_speaker_id, r.refined_diarization_speaker_id, r.text, r.overlap, r.asr_failure) for r in seg.collect()}
    assert got == {0: ("A", None, "so yes.", True, False), 2: ("A", "B", "?!", False, True), 4: ("A", None, "Ok", False, False)}
    assert {r["index"]: r.text for r in B.transcript_segments(t, o, False, False).collect()} == {0: "so so so so so so yes.", 1: "...", 2: "?!", 4: "Ok"}
    seg = seg.selectExpr("*", "'de' language", "'speaker' language_source")
    speakers = spark.createDataFrame([("r", "A", "ready", 1.0, 5, 4, 1, 5, "de", "detected"), ("r", "B", "low_support", 0.5, 1, 1, 0, 0, "de", "majority")], "recording_id string, speaker_id string, status string, purity double, candidates bigint, kept bigint, discarded bigint, shown bigint, language string, language_source string")
    requests = spark.createDataFrame([("r", 3, "de"), ("empty", None, "en")], "recording_id string, expected bigint, language string")
    profiles = spark.createDataFrame([("r", "B"), ("r", "p")], "recording_id string, profile_id string")
    pairs = spark.createDataFrame([("r", "p", "A", 0.81234567, 0.9, 0.1, True)], "recording_id string, profile_id string, speaker_id string, cosine double, support double, margin double, accepted boolean")
    none = spark.createDataFrame([], "recording_id string, speaker_id string, candidate_id string, reason string")
    docs = {r.recording_id: json.loads(r.document) for r in B.assembled(requests, seg, speakers, profiles, pairs, none).collect()}
    d = docs["r"]
    assert d["transcript"]["text"] == "so yes. ?! Ok" and [(s["index"], s["speaker_id"], s["speaker_kind"]) for s in d["transcript"]["segments"]] == [(0, "p", "known"), (2, "unknown-B", "unknown"), (4, "p", "known")]
    assert d["speaker_counts"] == {"expected": 3, "detected": 2, "known_provided": 2, "known_assigned": 1, "unknown": 1, "unresolved": 0}
    assert [(a["speaker_id"], a["kind"], a["cosine_similarity"]) for a in d["speaker_assignments"]] == [("p", "known", 0.812346), ("unknown-B", "unknown", None)]
    assert [(u["speaker_id"], u["embeddings_truncated"], u["retained_count"]) for u in d["unknown_speakers"]] == [("unknown-B", True, 1)] and d["unresolved_speakers"] == []
    assert d["unresolved_known_speakers"] == ["B"]
    assert [(w["code"], w["speaker_id"], w["speaker_ids"], w["detected"]) for w in d["warnings"]] == [("SPEAKER_EMBEDDING_QUALITY", "B", None, None), ("KNOWN_SPEAKERS_UNRESOLVED", None, ["B"], None), ("EXPECTED_SPEAKER_COUNT_MISMATCH", None, None, 2)]
    assert docs["empty"]["transcript"] == {"text": "", "language": "en", "segments": []} and docs["empty"]["warnings"] == [] and docs["empty"]["speaker_counts"]["detected"] == 0
