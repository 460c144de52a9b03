"""Settings rules, profiles, presets and merges."""

import json

from pyspark.sql import functions as F

from tidemark.operators import settings as G

RULES = G.default_rules(("cohere-x", "whisper-y"), ("de", "en"), ("small", "large"))


def documents(spark, rows):
    return spark.createDataFrame([(i, x if isinstance(x, str | None) else json.dumps(x)) for i, x in enumerate(rows)], "i int, body string")


def test_rules(spark):
    rows = [
        {}, None, "no json", [1], {"batch_wait_time_ms": -4, "batch_max_segments": 0, "batch_max_audio_seconds": 0.5, "scheduler_max_parallel_long_jobs": -1},
        {"batch_wait_time_ms": " 12 ", "batch_max_segments": 3.9, "batch_max_audio_seconds": "250", "scheduler_long_job_min_chunks": True},
        {"batch_wait_time_ms": "1.5", "batch_max_segments": None, "batch_max_audio_seconds": "x", "scheduler_long_job_min_chunks": [1]},
        {"cohere_cuda_graphs": False, "cuda_memory_trim_after_batch": "false", "debug_retain_history_audio": 1, "cohere_language_detection": None},
        {"local_model": " whisper-y ", "transcription_language": " EN ", "local_model_precision": "BF16", "language_detection_model": "large", "local_gpu_device": "  ", "dia_server_base_url": " http://x// "},
        {"local_model": "other", "transcription_language": "xx", "local_model_precision": 16, "local_gpu_device": "cuda:1"},
    ]
    got = {r.i: r.settings for r in G.normalised(documents(spark, rows), RULES).collect()}
    base = {k: r.default for k, r in RULES.items()}
    for i, change in enumerate((
        {}, {}, {}, {}, {"batch_wait_time_ms": "0", "batch_max_segments": "1", "batch_max_audio_seconds": "1.0", "scheduler_max_parallel_long_jobs": "0"},
        {"batch_wait_time_ms": "12", "batch_max_segments": "3", "batch_max_audio_seconds": "250.0", "scheduler_long_job_min_chunks": "1"}, {}, {"cohere_cuda_graphs": "false"},
        {"local_model": "whisper-y", "transcription_language": "en", "local_model_precision": "bf16", "language_detection_model": "large", "dia_server_base_url": "http://x"}, {"local_gpu_device": "cuda:1"},
    )):
        assert got[i] == base | change, i


def test_sizes(spark):
    rows = [{"redimnet_max_batch_size": x} for x in (6, 0, -3, 99, 8, "5", "two", True, None, 2.9)]
    got = [r.settings["redimnet_max_batch_size"] for r in G.normalised(documents(spark, rows), RULES).orderBy("i").collect()]
    assert got == ["4", "1", "1", "8", "8", "4", "8", "8", "8", "2"]


def test_seed_and_profiles(spark):
    docs = documents(spark, [{"batch_max_segments": 0, "colour": 1, "model_profiles": {"cohere-x": {"batch_max_segments": 0, "local_model": "no"}, "other": {"batch_max_segments": 2}, "whisper-y": {"colour": 1}}}, "x", {"model_profiles": 3}])
    assert [r.seed for r in G.seeded(docs, RULES).orderBy("i").collect()] == [{"batch_max_segments": "0"}, {}, {}]
    assert [(r.i, r.model, r["values"]) for r in G.profiles(docs, "i", RULES, ("cohere-x", "whisper-y")).collect()] == [(0, "cohere-x", {"batch_max_segments": "1"})]


def test_chains(spark):
    settings = [(0, "cohere-x", {"local_model": "cohere-x", "transcription_language": "auto", "cohere_language_detection": "false"}), (1, "whisper-y", {"local_model": "cohere-x", "transcription_language": "auto", "cohere_language_detection": "true"}), (2, "none", {"local_model": "whisper-y", "transcription_language": "en", "cohere_language_detection": "true"})]
    profiles = [(0, "cohere-x", {"batch_max_segments": "2", "transcription_language": "en"})]
    starts = [("whisper-y", {"batch_max_segments": "4", "local_gpu_device": "cuda:0"}), ("cohere-x", {"batch_max_segments": "16"})]
    kind = "i int, model string, {} map<string,string>"
    got = G.selected(spark.createDataFrame(settings, kind.format("settings")), spark.createDataFrame(profiles, kind.format("values")), spark.createDataFrame(starts, "model string, start map<string,string>"), "i")
    assert {r.i: r["values"] for r in got.collect()} == {0: {"batch_max_segments": "2", "transcription_language": "en"}, 1: {"batch_max_segments": "4", "transcription_language": "auto"}, 2: {"transcription_language": "en"}}
    row = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": "4"}, None)], "x map<string,string>, y map<string,string>, z map<string,string>")
    assert row.select(G.merged(F.col("x"), F.col("y"), F.col("z")).alias("m")).first().m == {"a": "1", "b": "3", "c": "4"}


def test_presets_and_saving(spark, tmp_path):
    rows = [("b", False, {"local_model": "m", "colour": "1"}), ("A", False, {"batch_max_segments": "1"}), ("z tier", True, {"local_model": "n"}), ("tier", True, {})]
    presets = spark.createDataFrame(rows, "name string, built_in boolean, values map<string,string>")
    assert [(r.name, r["values"]) for r in G.presets_for(presets).collect()] == [("tier", {}), ("z tier", {"local_model": "n"}), ("A", {"batch_max_segments": "1"}), ("b", {"local_model": "m"})]
    assert [r.name for r in G.presets_for(presets, "m").collect()] == ["tier", "A", "b"]
    for n in (2, 1):
        G.save_settings(spark.createDataFrame([(i, "x") for i in range(n)], "i int, v string"), f"{tmp_path}/s")
    assert [(r.i, r.v) for r in spark.read.json(f"{tmp_path}/s").collect()] == [(0, "x")]


def test_documents_are_read_once(spark, capsys):
    shown = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    docs = documents(spark, [{"local_model": "whisper-y", "batch_max_segments": 2}, {"local_model": "cohere-x", "colour": 1}, {}])
    both = G.seeded(G.normalised(docs, RULES), RULES)
    presets = both.select(F.col("i").cast("string").alias("name"), F.lit(False).alias("built_in"), F.map_filter("settings", lambda k, _: F.map_contains_key("seed", k)).alias("values"))
    try:
        for df, parsed, seeds in ((G.presets_for(presets, "whisper-y"), 1, 1), (G.normalised(docs, RULES).select("i", F.explode("settings")), 1, 0), (both.where("settings['local_model'] = 'cohere-x' and size(seed) < 3"), 1, 1)):
            df.explain(True)
            plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
            assert (plan.count("parseJson"), plan.count("from_json")) == (parsed, seeds)
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", shown)
    assert [(r.name, r.model_id, r["values"]) for r in G.presets_for(presets, "whisper-y").collect()] == [("0", "whisper-y", {"local_model": "whisper-y", "batch_max_segments": "2"}), ("2", None, {})]
