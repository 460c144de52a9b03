"""Registered queries that SQL does not express well: clouds, matching, folded text; and streams checked by batch SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import repetition as P
from tidemark.operators import aggregates as A
from tidemark.operators import clouds as C
from tidemark.sources import views as V
from tidemark.sources.views import table


def agg_cloud(spark: SparkSession, d: str) -> DataFrame:
    c = C.clouds(V.sample(spark, d))
    return c.select("recording_id", "speaker_id", "status", F.round("purity", 6).alias("purity"), "candidates", "kept", "discarded", F.size("prototype").cast("bigint").alias("dim"))


def agg_components(spark: SparkSession, d: str) -> DataFrame:
    """The component of each sample among all of its recording."""
    c = C.labelled(V.sample(spark, d).withColumn("speaker_id", F.lit("ALL")))
    return c.select("recording_id", "sample_idx", "place", "component")


def agg_inliers(spark: SparkSession, d: str) -> DataFrame:
    return C.clouds(V.sample(spark, d)).select("recording_id", "speaker_id", F.explode("ids").alias("sample_idx"))


def mt_match(spark: SparkSession, d: str) -> DataFrame:
    s = V.sample(spark, d)
    # a profile is the weighted mean of all samples of a speaker in a recording
    p = A.weighted_mean_vector(s, ["recording_id", "speaker_id"]).select("recording_id", F.concat(F.lit("profile-"), "speaker_id").alias("profile_id"), F.col("prototype").alias("profile_vector")).where("profile_vector is not null")
    return C.matches(s, p).select("recording_id", "profile_id", "speaker_id", "accepted", *[F.round(c, 6).alias(c) for c in ("cosine", "support", "margin")])


def top_public(spark: SparkSession, d: str) -> DataFrame:
    return C.public_vectors(V.sample(spark, d))


def txt_repetition(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", "text", P.fold_repeats("text").alias("folded"))
    return t.select("doc_id", F.length("text").cast("bigint").alias("before"), F.length("folded").cast("bigint").alias("after"), F.sha2("folded", 256).alias("folded_sha256"))


def txt_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", P.clean_segment(F.col("text")).alias("cleaned"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (agg_cloud, agg_components, agg_inliers, mt_match, top_public, txt_repetition, txt_clean)}


def _clean_sql() -> str:
    e = "coalesce(text, '')"
    for pattern, to in P.CLEAN:
        e = f"regexp_replace({e}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return f"SELECT conv_id, turn, trim({e}) AS cleaned FROM conversations"


ORACLE_SQL = {"txt_clean": _clean_sql()}
