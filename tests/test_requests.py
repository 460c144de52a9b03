"""Names, settings and plans of requests."""

from collections import Counter

from pyspark.sql import functions as F

from tidemark.operators import requests


def test_safe_names(spark):
    names = ["/tmp/..a b.wav. ", "c:\\x\\y\x07z.mp3", "", None, "é" * 200, "a" * 239 + "é", "€" * 81]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(names)), "i int, n string").select(F.col("i"), requests.safe_name(F.col("n")).alias("s")).orderBy("i").select("s").collect()]
    assert got == ["a b.wav", "yz.mp3", "", None, "é" * 120, "a" * 239, "€" * 80]


def test_forms(spark):
    table = lambda x: spark.createDataFrame(list(x.items()), "name string, value string")
    typed, base, service = table({"a": "1", "b": "2", "c": "9"}), table({"a": "1", "b": "0"}), table({"a": "5", "b": "6", "d": "7"})
    got = {r.name: r.value for r in requests.merged_forms(typed, base, service, F.lit(True)).collect()}
    assert got == {"a": "5", "b": "2", "c": "9", "d": "7"}
    assert {r.name: r.value for r in requests.merged_forms(typed, base, service, F.lit(False)).collect()} == {"a": "1", "b": "2", "c": "9", "d": "7"}


def test_cycle(spark):
    files = spark.createDataFrame([(f"f{i}",) for i in range(5)], "name string")
    plan = requests.cycle(files, "name", 12).collect()
    assert sorted(r.request for r in plan) == list(range(12)) and sorted(Counter(r["name"] for r in plan).values()) == [2, 2, 2, 3, 3]
    assert {r["name"] for r in plan if r.request % 5 == 1} == {next(r["name"] for r in plan if r.request == 1)}
    assert requests.cycle(files.limit(0), "name", 3).count() == 0


def test_rollback(spark):
    kind = "recording_id string, start_ms bigint, end_ms bigint, speaker_id string, new_start_ms bigint, new_end_ms bigint, new_speaker_id string"
    same = [(0, 10_000, "A"), (10_000, 20_000, "B"), (20_000, 21_000, "A"), (22_000, 23_000, "B")]
    moved = {"ok": (2, "B"), "hit": (2, "B"), "share": (0, "B"), "none": (2, "A"), "gone": (2, "C"), "seed": (2, "B"), "mixed": (2, "B")}
    rows = [(r, a, b, s, a, b, n if i == k else s) for r, (k, n) in moved.items() for i, (a, b, s) in enumerate(same)]
    rows += [("bent", 0, 10_000, "A", 0, 9_999, "A"), ("lost", 0, 10_000, "A", None, None, None)]
    standard = spark.createDataFrame([("hit", "B", 20_500, 20_600), ("ok", "A", 20_500, 20_600)], "recording_id string, speaker_id string, start_ms bigint, end_ms bigint")
    seeds = spark.createDataFrame([("seed", 2, 9.0), ("ok", 3, 6.0)], "recording_id string, kept int, kept_s double")
    clouds = spark.createDataFrame([("mixed", "ready", "mixed_cluster"), ("ok", "ready", "low_support")], "recording_id string, status string, new_status string")
    got = {r.recording_id: r.reason for r in requests.rollback_reasons(spark.createDataFrame(rows, kind), standard, seeds, clouds).collect()}
    assert got == {
        "ok": None, "none": None, "hit": "overlap_invariant_violation", "share": "reassigned_speech_exceeds_10_percent", "gone": "speaker_count_changed", "seed": "seed_core_lost",
        "mixed": "ready_cloud_became_mixed_cluster", "bent": "timeline_invariant_violation", "lost": "timeline_invariant_violation",
    }
