"""Snapshots of models on disk against the files that each model needs, and diagnostics of a request's chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GIB = float(1 << 30)


def complete_snapshots(files: DataFrame, required: DataFrame) -> DataFrame:
    """model_id, revision, bytes, complete of each snapshot in files (model_id, revision, path, bytes).

    required: model_id, all_of (array), any_of (array of arrays). A snapshot is complete if it has every file of all_of and one at least of each group of any_of.
    """
    s = files.groupBy("model_id", "revision").agg(F.collect_set("path").alias("_paths"), F.sum("bytes").alias("bytes")).join(required, "model_id")
    whole = (F.size(F.array_except("all_of", "_paths")) == 0) & F.forall("any_of", lambda group: F.arrays_overlap(group, F.col("_paths")))
    return s.select("model_id", "revision", "bytes", whole.alias("complete"))


def model_statuses(required: DataFrame, files: DataFrame, mains: DataFrame, jobs: DataFrame) -> DataFrame:
    """model_id, status, revision, gb, error of each model in required.

    downloading while a job says so; else ready with a complete snapshot (the main revision's if that is complete, else the first by name); else error if a job failed; else partial where there are
    files, missing where there are none. gb: the snapshot's size, or that of all files. mains: model_id, main; jobs: model_id, job, error.
    """
    s = complete_snapshots(files, required).join(mains, "model_id", "left")
    rank = F.struct((~F.col("revision").eqNullSafe(F.col("main"))).alias("a"), F.col("revision"))
    s = s.groupBy("model_id").agg(F.sum("bytes").alias("_all"), F.min(F.when(F.col("complete"), F.struct(rank.alias("r"), "revision", "bytes"))).alias("_best"))
    r = required.select("model_id").join(s, "model_id", "left").join(jobs, "model_id", "left")
    status = (
        F.when(F.col("job") == "downloading", "downloading").when(F.col("_best").isNotNull(), "ready").when(F.col("job") == "error", "error").when(F.col("_all").isNotNull(), "partial").otherwise("missing")
    )
    gb = F.bround(F.coalesce("_best.bytes", "_all") / GIB, 2)
    return r.select("model_id", status.alias("status"), F.col("_best.revision").alias("revision"), gb.alias("gb"), F.when(F.col("job") == "error", F.col("error")).alias("error"))


def chunk_diagnostics(regions: DataFrame, chunks: DataFrame, words: DataFrame) -> DataFrame:
    """recording_id, speech_regions, speech_seconds, superchunks, superchunk_languages (array of language and count), words_aligned.

    regions: recording_id, start_ms, end_ms; chunks: recording_id, language (null where none was asked for); words: recording_id. Recordings without speech have no row.
    """
    a = regions.groupBy("recording_id").agg(F.count("*").alias("speech_regions"), F.bround(F.sum(F.col("end_ms") - F.col("start_ms")) / 1000, 1).alias("speech_seconds"))
    by = chunks.groupBy("recording_id", "language").agg(F.count("*").alias("n"))
    b = by.groupBy("recording_id").agg(F.sum("n").alias("superchunks"), F.sort_array(F.collect_list(F.when(F.col("language").isNotNull(), F.struct("language", "n")))).alias("superchunk_languages"))
    c = words.groupBy("recording_id").agg(F.count("*").alias("words_aligned"))
    rows = a.join(b, "recording_id", "left").join(c, "recording_id", "left").fillna(0, ["superchunks", "words_aligned"])
    return rows.withColumn("superchunk_languages", F.coalesce("superchunk_languages", F.array()))
