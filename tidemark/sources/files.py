"""Files in and out: PCM audio, request documents, append-only logs."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.audio import resampled

RATE = 16_000
MOST_REQUEST_BYTES = 16 << 20


def decode_wav(content: bytes, rate: int = RATE) -> np.ndarray:
    """Mono float32 samples at a rate: channels averaged, amplitude as it is, resampled by a windowed sinc."""
    with wave.open(io.BytesIO(content)) as f:
        width, channels, own = f.getsampwidth(), f.getnchannels(), f.getframerate()
        raw = f.readframes(f.getnframes())
    if width not in (1, 2, 4):
        raise ValueError(f"{8 * width}-bit audio is not supported")
    x = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float32)
    x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    x = x.reshape(-1, channels).mean(axis=1)
    return resampled(x, own, rate)


def read_audio(spark: SparkSession, path: str, rate: int = RATE) -> DataFrame:
    """path, samples, seconds, error of WAV files; one that can't be read, or is empty, has an error and no samples."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for name, content in zip(p["path"], p["content"]):
                try:
                    x = decode_wav(bytes(content), rate)
                    rows.append((name, x.tolist(), x.size / rate, None) if x.size else (name, None, 0.0, "empty"))
                except (wave.Error, EOFError, ValueError) as e:
                    rows.append((name, None, 0.0, str(e) or "unreadable"))
            yield pd.DataFrame(rows, columns=["path", "samples", "seconds", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, samples array<float>, seconds double, error string")


def folder_size(spark: SparkSession, path: str) -> DataFrame:
    """Bytes under a folder in 1024**3, to two places; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.bround(F.coalesce(F.sum("length"), F.lit(0)) / float(1 << 30), 2).alias("gb"))


REQUEST = T.StructType(
    [
        T.StructField("mode", T.StringType()),
        T.StructField("expected_speakers", T.IntegerType()),
        T.StructField("language", T.StringType()),
        T.StructField("known_speakers", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("embeddings", T.ArrayType(T.ArrayType(T.DoubleType())))]))),
    ]
)


def parse_requests(raw: DataFrame, dimension: int = 192) -> DataFrame:
    """raw (request_id, body) with the parsed request and the list of what is wrong with it (empty: sound)."""
    keys = F.json_object_keys("body")
    ids = F.col("request.known_speakers.id")
    vectors = F.flatten(F.col("request.known_speakers.embeddings"))
    count = F.coalesce(F.size("request.known_speakers"), F.lit(0))
    zero = F.exists(vectors, lambda v: ~F.exists(v, lambda x: x != 0))
    checks = [
        (F.octet_length("body") > MOST_REQUEST_BYTES, "too large"),
        (keys.isNull(), "no JSON object"),
        (F.size(F.array_except(keys, F.array(*[F.lit(f.name) for f in REQUEST.fields]))) > 0, "unknown field"),
        (~F.coalesce(F.col("request.mode").isin("diarization", "transcript"), F.lit(False)), "mode"),
        (~F.col("request.expected_speakers").between(1, 64), "expected_speakers"),
        (count > 64, "too many known speakers"),
        ((count > 0) & F.exists(ids, lambda i: i.isNull() | ~F.octet_length(i).between(1, 128)), "speaker id"),
        ((count > 0) & (F.size(F.array_distinct(ids)) < F.size(ids)), "duplicate speaker id"),
        ((count > 0) & F.exists("request.known_speakers", lambda s: F.coalesce(F.size(s["embeddings"]), F.lit(0)) < 1), "no embedding"),
        ((count > 0) & (F.exists(vectors, lambda v: (F.size(v) != dimension) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))) | zero), "embedding"),
    ]
    wrong = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in checks]))
    return raw.withColumn("request", F.from_json("body", REQUEST)).withColumn("violations", wrong)


def append_log(rows: DataFrame, path: str) -> None:
    """One JSON object a line, added to what is there."""
    rows.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A log by an explicit schema; lines that are no such object are kept in _corrupt_record."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])).option("mode", "PERMISSIVE").json(path)


def envelope(rows: DataFrame, warnings: str = "warnings") -> DataFrame:
    """status (partial if there are warnings, else success) and the row as a JSON response."""
    status = F.when(F.coalesce(F.size(warnings), F.lit(0)) > 0, "partial").otherwise("success")
    return rows.withColumn("status", status).withColumn("response", F.to_json(F.struct("status", *rows.columns)))
