"""Settings documents: each value checked by a rule of its key, seeds, profiles by model, presets and chains of maps of which the later wins.

A document is JSON text; checked values are a map from key to text (numbers and booleans as JSON writes them), so that a white list is a filter and a merge is one of maps.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Precisions, languages beside those that are detected, sizes to which a batch size goes down, and the code taken where none is detected.
PRECISIONS, AUTO, SIZES, FALLBACK = ("bf16", "fp16", "int8_bnb", "fp32"), "auto", (1, 2, 4, 8), "de"


@dataclass(frozen=True)
class Rule:
    """How a key's value is checked. kind: int, float, bool, text, url (text without slashes at its end), enum or size; least: numbers below become it; of: what is allowed; default: what any other value becomes."""

    kind: str
    default: str
    least: float | None = None
    of: tuple[str, ...] = ()


def default_rules(models: Sequence[str], languages: Sequence[str], detectors: Sequence[str]) -> dict[str, Rule]:
    """The rules of a service's settings. Keys, defaults and floors are fixed values; models, languages and detectors are those on offer, the first one the default."""
    return {
        "local_model": Rule("enum", models[0], of=tuple(models)),
        "local_gpu_device": Rule("text", "auto"),
        "local_model_precision": Rule("enum", "fp16", of=PRECISIONS),
        "local_model_cache_path": Rule("text", ""),
        "transcription_language": Rule("enum", AUTO, of=(AUTO, *languages)),
        "batch_wait_time_ms": Rule("int", "500", 0),
        "batch_max_segments": Rule("int", "16", 1),
        "batch_max_audio_seconds": Rule("float", "100.0", 1.0),
        "scheduler_long_job_min_chunks": Rule("int", "5", 1),
        "scheduler_max_parallel_long_jobs": Rule("int", "2", 0),
        "scheduler_first_chunk_fast_path": Rule("bool", "true"),
        "cuda_memory_trim_after_batch": Rule("bool", "true"),
        "cohere_cuda_graphs": Rule("bool", "true"),
        "cohere_language_detection": Rule("bool", "true"),
        "language_detection_model": Rule("enum", detectors[0], of=tuple(detectors)),
        "redimnet_max_batch_size": Rule("size", "8"),
        "debug_retain_history_audio": Rule("bool", "false"),
        "huggingface_token": Rule("text", ""),
        "dia_server_base_url": Rule("url", ""),
        "dia_api_key": Rule("text", ""),
    }


#: Keys that a preset may set, and those that a model remembers.
PRESET_KEYS = (
    "local_model", "local_gpu_device", "local_model_precision", "batch_wait_time_ms", "batch_max_segments", "batch_max_audio_seconds", "scheduler_long_job_min_chunks",
    "scheduler_max_parallel_long_jobs", "scheduler_first_chunk_fast_path", "cuda_memory_trim_after_batch", "cohere_cuda_graphs", "redimnet_max_batch_size",
)
TUNED_KEYS = (*PRESET_KEYS[2:], "transcription_language")


def snapped(n: Column, sizes: Sequence[int] = SIZES) -> Column:
    """The largest of the sizes that is not above n, else the smallest."""
    return F.coalesce(*[F.when(n >= s, F.lit(s)) for s in sorted(sizes, reverse=True)], F.lit(min(sizes)))


def _checked(value: Column, kind: Column, text: Column, rule: Rule) -> Column:
    """A variant by its rule; kind and text: its type and itself as trimmed text."""
    number = F.when((kind == "BIGINT") | kind.startswith("DECIMAL") | (kind == "DOUBLE"), F.try_variant_get(value, "$", "double"))
    default = F.lit(rule.default)
    if rule.kind == "bool":
        return F.when(kind == "BOOLEAN", text).otherwise(default)
    if rule.kind in ("text", "url"):
        text = F.regexp_replace(text, "/+$", "") if rule.kind == "url" else text
        return F.when((kind != "VOID") & (text != ""), text).otherwise(default)
    if rule.kind == "enum":
        as_is = F.when(text.isin(*rule.of), text)
        return F.coalesce(as_is, F.when(F.lower(text).isin(*rule.of), F.lower(text)), default) if rule.default == rule.default.lower() else F.coalesce(as_is, default)
    if rule.kind == "float":
        number = F.coalesce(number, F.when(kind == "BOOLEAN", (text == "true").cast("double")), F.when(kind == "STRING", text.try_cast("double")))
        return F.coalesce(F.when(number.isNotNull(), F.greatest(number, F.lit(rule.least))).cast("string"), default)
    whole = F.coalesce(number.try_cast("bigint"), F.when(kind == "STRING", F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))))
    if rule.kind == "size":  # a boolean is no size
        return F.coalesce(F.when(whole.isNotNull(), snapped(whole)).cast("string"), default)
    whole = F.coalesce(whole, F.when(kind == "BOOLEAN", (text == "true").cast("bigint")))
    return F.coalesce(F.when(whole.isNotNull(), F.greatest(whole, F.lit(rule.least).cast("bigint"))).cast("string"), default)


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is computed once a row, by a generator of one row. A plain column's expression, with the parsing in it, is put into every later filter and lambda that names the column."""
    return rows.select(*[c for c in rows.columns if c != name], F.explode(F.array(value)).alias(name))


def _with_values(documents: DataFrame, name: str, body: str, rules: Mapping[str, Rule], sent: bool) -> DataFrame:
    """documents with the checked values of the rules' keys; with sent, of those keys only that a document has. The text is parsed once a row, a value read once."""
    rows = documents.withColumn("_document", F.try_parse_json(body))
    rows = rows.withColumns({f"_value_{i}": F.try_variant_get("_document", f"$.{k}", "variant") for i, k in enumerate(rules)})
    rows = rows.withColumns({f"_kind_{i}": F.coalesce(F.schema_of_variant(f"_value_{i}"), F.lit("VOID")) for i in range(len(rules))} | {f"_text_{i}": F.trim(F.regexp_replace(F.try_variant_get(f"_value_{i}", "$", "string"), r"^\s+|\s+$", "")) for i in range(len(rules))})
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), _checked(F.col(f"_value_{i}"), F.col(f"_kind_{i}"), F.col(f"_text_{i}"), r).alias("value")) for i, (k, r) in enumerate(rules.items())])
    keys = F.coalesce(F.json_object_keys(body), F.array().cast("array<string>"))
    values = F.map_from_entries(F.filter(pairs, lambda p: F.array_contains(keys, p["key"])) if sent else pairs)
    return _once(rows, name, values).select(*[c for c in documents.columns if c != name], name)


def normalised(documents: DataFrame, rules: Mapping[str, Rule], body: str = "body") -> DataFrame:
    """documents with `settings`: every key of the rules, checked; what is no JSON object (or has a key twice), or lacks a key, has the defaults."""
    return _with_values(documents, "settings", body, rules, False)


def seeded(documents: DataFrame, rules: Mapping[str, Rule], body: str = "body") -> DataFrame:
    """documents with `seed`: the values (as JSON text) of the known keys that a document has, unchecked."""
    values = F.coalesce(F.from_json(F.col(body), "map<string,string>"), F.create_map().cast("map<string,string>"))
    return _once(documents, "seed", F.map_filter(values, lambda k, _: k.isin(*rules)))


def profiles(documents: DataFrame, key: str, rules: Mapping[str, Rule], models: Sequence[str], body: str = "body") -> DataFrame:
    """key, model, values of the profiles in documents (`model_profiles`, an object by model): known models only, tuned keys only, each checked; none without a value."""
    tuned = {k: rules[k] for k in TUNED_KEYS}
    every = F.from_json(F.get_json_object(body, "$.model_profiles"), "map<string,string>")
    rows = documents.select(key, F.explode(every).alias("model", "_body")).where(F.col("model").isin(*models))
    return _with_values(rows, "values", "_body", tuned, True).where(F.size("values") > 0).drop("_body")


def merged(*maps: Column) -> Column:
    """One map of several, null ones left out; of equal keys the later map's value wins."""
    out, *later = (F.coalesce(m, F.create_map().cast("map<string,string>")) for m in maps)
    return reduce(lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b), later, out)


def listed(values: Column, keys: Sequence[str] = PRESET_KEYS) -> Column:
    """The entries of a map whose keys are on a white list."""
    return F.map_filter(values, lambda k, _: k.isin(*keys))


def selected(settings: DataFrame, profiles: DataFrame, starts: DataFrame, key: str, model: str = "model") -> DataFrame:
    """settings (key, model, settings) with `values` for the model chosen: its profile, else its start preset, else nothing; tuned keys only.

    Without a language it takes the one that the model before it really used. starts: model, start (a map).
    """
    rows = settings.join(profiles.select(key, F.col("model").alias(model), F.col("values").alias("_own")), [key, model], "left").join(starts.withColumnRenamed("model", model), model, "left")
    used = F.lower(F.trim(F.col("settings")["transcription_language"]))
    detects = F.col("settings")["cohere_language_detection"] == "true"
    used = F.when(F.col("settings")["local_model"].startswith("cohere") & (used == AUTO) & ~detects, FALLBACK).otherwise(used)
    values = listed(F.coalesce(F.when(F.size("_own") > 0, F.col("_own")), F.col("start"), F.create_map().cast("map<string,string>")), TUNED_KEYS)
    return rows.withColumn("values", merged(F.create_map(F.lit("transcription_language"), used), values)).drop("_own", "start")


def presets_for(presets: DataFrame, model: str | None = None) -> DataFrame:
    """Presets (name, built_in, values) with what a preset may set and the model it is for, in order: built-in ones first, then by name; with model, only those for it or for any."""
    rows = presets.withColumn("values", listed(F.col("values"))).withColumn("model_id", F.col("values")["local_model"])
    if model is not None:
        rows = rows.where(F.col("model_id").isNull() | (F.col("model_id") == model))
    # a sort first looks at all its rows for its bounds: dealt out before, they are not made a second time
    return rows.repartition("name").orderBy(F.desc("built_in"), F.lower("name"), "name")


def save_settings(settings: DataFrame, path: str) -> None:
    """One JSON document a row, in place of what was there."""
    settings.coalesce(1).write.mode("overwrite").json(path)
