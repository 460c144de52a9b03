"""Registered queries on settings documents, profiles and presets, with their DuckDB SQL.

A customer is a settings document: JSON text whose values come from its columns, some of a wrong type, out of range or unknown. The text is made by one expression that Spark and DuckDB share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import settings as G
from tidemark.sources import views as V

MODELS, DETECTORS = ("model-0", "model-1"), ("detector-a", "detector-b")
RULES = G.default_rules(MODELS, V.LANGUAGES, DETECTORS)
_VALUES = (
    "'\"batch_wait_time_ms\":', c_nationkey - 5, ',\"batch_max_segments\":\" ', c_nationkey - 3, ' \",\"batch_max_audio_seconds\":', c_custkey % 50, '.25,\"transcription_language\":\" ', substr(c_mktsegment, 1, 2), '\",\"cohere_cuda_graphs\":', "
    "CASE c_custkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN '\"true\"' WHEN 2 THEN 'null' ELSE 'false' END, ',\"redimnet_max_batch_size\":', c_custkey % 12 - 1, ',\"scheduler_long_job_min_chunks\":', CASE c_custkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN '7.9' ELSE '\"many\"' END"
)
_BODY = f"concat('{{\"local_model\":\"model-', c_custkey % 3, '\",\"language_detection_model\":\"detector-b\",\"colour\":1,', {_VALUES}, ',\"model_profiles\":{{\"model-', c_custkey % 3, '\":{{', {_VALUES}, '}},\"model-7\":{{\"colour\":2}}}}}}')"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    c = V.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").repartition("c_custkey")  # a document is a hundred times its row, so a file's rows are dealt out
    body = F.when(F.col("c_custkey") % 17 == 0, F.lit("no object")).otherwise(F.expr(_BODY))
    return c.select("c_custkey", body.alias("body"))


_DOC = f"doc AS (SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN '{{}}' ELSE {_BODY} END AS body FROM customer)"


def _rule_sql(key: str, j: str) -> str:
    """The checked value of a key of the JSON object j."""
    r, t = RULES[key], f"json_type({j}, '$.{key}')"
    x = f"trim(json_extract_string({j}, '$.{key}'))"
    number = f"CASE WHEN {t} IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(trunc(CAST({x} AS DOUBLE)) AS BIGINT) WHEN {t} = 'VARCHAR' AND regexp_full_match({x}, '[+-]?[0-9]+') THEN CAST({x} AS BIGINT)"
    if r.kind == "bool":
        return f"CASE WHEN {t} = 'BOOLEAN' THEN {x} ELSE '{r.default}' END"
    if r.kind in ("text", "url"):
        return f"CASE WHEN {t} <> 'NULL' AND {x} <> '' THEN {x} ELSE '{r.default}' END"
    if r.kind == "enum":
        return f"CASE WHEN lower({x}) IN ({', '.join(repr(o) for o in r.of)}) THEN lower({x}) ELSE '{r.default}' END"
    if r.kind == "float":
        return f"coalesce(CAST((SELECT CASE WHEN n IS NOT NULL THEN greatest(n, {r.least}) END FROM (SELECT CASE WHEN {t} = 'BOOLEAN' THEN CAST({x} = 'true' AS INT) ELSE TRY_CAST({x} AS DOUBLE) END AS n)) AS VARCHAR), '{r.default}')"
    if r.kind == "size":
        return f"coalesce(CAST((SELECT CASE WHEN n >= 8 THEN 8 WHEN n >= 4 THEN 4 WHEN n >= 2 THEN 2 WHEN n IS NOT NULL THEN 1 END FROM (SELECT {number} END AS n)) AS VARCHAR), '{r.default}')"
    return f"coalesce(CAST((SELECT CASE WHEN n IS NOT NULL THEN greatest(n, {int(r.least or 0)}) END FROM (SELECT {number} WHEN {t} = 'BOOLEAN' THEN CAST({x} = 'true' AS BIGINT) END AS n)) AS VARCHAR), '{r.default}')"


def _all_sql(j: str, keys: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"{{'key': '{k}', 'value': {_rule_sql(k, j)}}}" for k in keys) + "]"


def src_settings(spark: SparkSession, d: str) -> DataFrame:
    """Every setting of every document."""
    return G.normalised(_documents(spark, d), RULES).select("c_custkey", F.explode("settings").alias("key", "value"))


def src_seed(spark: SparkSession, d: str) -> DataFrame:
    """The known keys that a document has, as it has them."""
    return G.seeded(_documents(spark, d), RULES).select("c_custkey", F.explode("seed").alias("key", "value"))


def src_profile_norm(spark: SparkSession, d: str) -> DataFrame:
    """Checked values of the profiles of known models."""
    return G.profiles(_documents(spark, d), "c_custkey", RULES, MODELS).select("c_custkey", "model", F.explode("values").alias("key", "value"))


_START = {"batch_max_segments": "4", "local_gpu_device": "never taken"}


def prj_profile(spark: SparkSession, d: str) -> DataFrame:
    """What each document takes when model-1, which has a start preset, or model-0 is chosen instead of its own."""
    docs = _documents(spark, d)
    chosen = G.normalised(docs, RULES).select("c_custkey", "settings", F.when(F.col("c_custkey") % 2 == 0, "model-0").otherwise("model-1").alias("model"))
    starts = spark.createDataFrame([("model-1", _START)], "model string, start map<string,string>")
    return G.selected(chosen, G.profiles(docs, "c_custkey", RULES, MODELS), starts, "c_custkey").select("c_custkey", "model", F.explode("values").alias("key", "value"))


def prj_preset(spark: SparkSession, d: str) -> DataFrame:
    """Documents as presets of users: what a preset may set, of those for model-1."""
    docs = G.seeded(G.normalised(_documents(spark, d), {k: RULES[k] for k in G.PRESET_KEYS}), RULES)
    sent = F.map_filter("settings", lambda k, _: F.map_contains_key("seed", k) & ((k != "local_model") | (F.col("c_custkey") % 5 != 0)))
    p = docs.select(F.col("c_custkey").cast("string").alias("name"), F.lit(False).alias("built_in"), sent.alias("values"))
    return G.presets_for(p, "model-1").select("name", "model_id", F.size("values").cast("bigint").alias("keys"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (src_settings, src_seed, src_profile_norm, prj_profile, prj_preset)}

_SENT = "json_keys(body)"
_PROFILES = f"""pr AS (SELECT c_custkey, m.model, json_extract(body, '$.model_profiles."' || m.model || '"') AS b FROM doc, (VALUES ('model-0'), ('model-1')) m(model)),
pv AS (SELECT c_custkey, model, x.key AS key, x.value AS value FROM (SELECT c_custkey, model, b, unnest({_all_sql("b", G.TUNED_KEYS)}) AS x FROM pr WHERE b IS NOT NULL) WHERE list_contains(json_keys(b), x.key))"""
ORACLE_SQL: dict[str, str] = {
    "src_settings": f"WITH {_DOC} SELECT c_custkey, x.key AS key, x.value AS value FROM (SELECT c_custkey, unnest({_all_sql('body', tuple(RULES))}) AS x FROM doc)",
    "src_seed": f"WITH {_DOC} SELECT c_custkey, k.key AS key, json_extract_string(body, '$.' || k.key) AS value FROM (SELECT c_custkey, body, {{'key': unnest(json_keys(body))}} AS k FROM doc) WHERE k.key IN ({', '.join(repr(k) for k in RULES)})",
    "src_profile_norm": f"WITH {_DOC}, {_PROFILES} SELECT * FROM pv",
    "prj_profile": f"""WITH {_DOC}, {_PROFILES}, ch AS (SELECT c_custkey, body, CASE WHEN c_custkey % 2 = 0 THEN 'model-0' ELSE 'model-1' END AS model FROM doc),
v AS (SELECT ch.c_custkey, ch.model, pv.key, pv.value FROM ch JOIN pv USING (c_custkey, model) UNION ALL SELECT c_custkey, model, 'batch_max_segments', '4' FROM ch WHERE model = 'model-1' AND NOT EXISTS (SELECT 1 FROM pv WHERE pv.c_custkey = ch.c_custkey AND pv.model = ch.model))
SELECT * FROM v UNION ALL SELECT c_custkey, model, 'transcription_language', {_rule_sql('transcription_language', 'body')} FROM ch WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.c_custkey = ch.c_custkey AND v.key = 'transcription_language')""",
    "prj_preset": f"""WITH {_DOC}, s AS (SELECT c_custkey, count(*) AS n, CASE WHEN c_custkey % 5 <> 0 THEN any_value({_rule_sql('local_model', 'body')}) FILTER (k IN ('local_model')) END AS model_id FROM (SELECT c_custkey, body, unnest(json_keys(body)) AS k FROM doc) WHERE k IN ({', '.join(repr(k) for k in G.PRESET_KEYS)}) AND (k <> 'local_model' OR c_custkey % 5 <> 0) GROUP BY c_custkey
UNION ALL SELECT c_custkey, 0, NULL FROM doc WHERE body = '{{}}') SELECT CAST(c_custkey AS VARCHAR) AS name, model_id, n AS keys FROM s WHERE model_id IS NULL OR model_id = 'model-1'""",
}
