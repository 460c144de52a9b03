"""Snapshots, statuses of models and diagnostics of chunks."""

from tidemark.operators import snapshots as K


def test_statuses(spark):
    required = spark.createDataFrame([(m, ["config", "vocab"], [["a", "b"], ["c"]]) for m in "pqrstuv"], "model_id string, all_of array<string>, any_of array<array<string>>")
    whole = ["config", "vocab", "b", "c"]
    files = [("p", "x1", f, 1 << 28) for f in whole] + [("p", "x0", f, 1 << 29) for f in whole] + [("q", "m", f, 1 << 28) for f in whole[:3]] + [("q", "n", f, 1 << 28) for f in [*whole, "more"]] + [("r", "m", "config", 1 << 28)] + [("s", "m", f, 1 << 28) for f in whole] + [("v", "m", f, 1) for f in whole[1:]]
    mains = spark.createDataFrame([("p", "x1"), ("q", "m")], "model_id string, main string")
    jobs = spark.createDataFrame([("s", "downloading", None), ("r", "error", "no"), ("t", "error", "gone"), ("p", "error", "old")], "model_id string, job string, error string")
    f = spark.createDataFrame(files, "model_id string, revision string, path string, bytes bigint")
    got = {r.model_id: (r.status, r.revision, r.gb, r.error) for r in K.model_statuses(required, f, mains, jobs).collect()}
    assert got == {"p": ("ready", "x1", 1.0, "old"), "q": ("ready", "n", 1.25, None), "r": ("error", None, 0.25, "no"), "s": ("downloading", "m", 1.0, None), "t": ("error", None, None, "gone"), "u": ("missing", None, None, None), "v": ("partial", None, 0.0, None)}
    none = K.complete_snapshots(f, spark.createDataFrame([("r", [], [])], "model_id string, all_of array<string>, any_of array<array<string>>")).collect()
    assert [(r.revision, r.complete) for r in none] == [("m", True)]  # nothing is required


def test_chunk_diagnostics(spark):
    regions = spark.createDataFrame([("r", 0, 1250), ("r", 3000, 4000), ("q", 0, 100)], "recording_id string, start_ms bigint, end_ms bigint")
    chunks = spark.createDataFrame([("r", "en"), ("r", "de"), ("r", "en"), ("q", None)], "recording_id string, language string")
    words = spark.createDataFrame([("r",)] * 3, "recording_id string")
    got = {x.recording_id: x for x in K.chunk_diagnostics(regions, chunks, words).collect()}
    r, q = got["r"], got["q"]
    assert (r.speech_regions, r.speech_seconds, r.superchunks, [tuple(x) for x in r.superchunk_languages], r.words_aligned) == (2, 2.2, 3, [("de", 1), ("en", 2)], 3)
    assert (q.speech_regions, q.speech_seconds, q.superchunks, q.superchunk_languages, q.words_aligned) == (1, 0.1, 1, [], 0)
