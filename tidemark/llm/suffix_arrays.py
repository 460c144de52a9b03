"""Suffix-array deduplication of repeated byte strings by prefix-free parsing.

A rolling hash of 32 bytes triggers a phrase's end where it is the smallest of a window; phrases overlap by their trigger, so that
no phrase is a prefix of another. The dictionary holds the distinct phrases, sorted by their reversed bytes, with the length that
neighbours have in common at the end: the suffixes of phrases, in classes. The parse holds what follows each trigger,
sorted, with the length that neighbours have in common: the suffixes of the text at phrase starts. A suffix of the text that starts `t` bytes before a trigger
is a pair of a suffix of a phrase (t long) and a parse suffix; so the two orders combine to the order of all suffixes,
and those that agree for `window` bytes are the pairs that agree in the class of their phrase's suffix at t and in the class of the parse
suffix at window - t. The trigger is a minimum in each window rather than a residue, so that any window holds
one; grouping by trigger, which equal strings share, spreads dictionary and parse over the tasks (see `repeats`).

Defined results: a null or empty text has 0 bytes and nothing to remove; texts shorter than the window keep all; copies and
repeated rows lose all that windows cover (so all of it, from the window's length on); matches never cross texts; rows may
lack a doc_id; an empty table gives an empty result; other columns are not read. Equal texts are told by two 64-bit hashes, equal segments likewise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.kernels import as_bytes, byte_grams
from tidemark.llm.repeats import KEY, Units, classes, covered, ranges, repeated, twice

WINDOW, TRIGGER = 400, 32


def _sorted(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of strings, and by place in it the length of what each has in common with the one before (-1 for the first)."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    common = np.full(len(strings), -1, np.int64)
    step = 4000
    for lo in range(0, len(order), step):
        some = [strings[i] for i in order[max(0, lo - 1) : lo + step]]
        m = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in some), np.uint8).reshape(len(some), width)
        sizes = np.array([len(s) for s in some])
        differ = m[1:] != m[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        common[max(1, lo) : lo + step] = np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))
    return np.array(order, np.int64), common


def _repeats(window: int):  # noqa: ANN202
    def repeats(left: list[bytes], right: list[bytes], t1: np.ndarray, t2: np.ndarray, copies: np.ndarray, ta: np.ndarray, tb: np.ndarray) -> list[list[tuple[int, int]]]:
        phrases, phrase = np.unique(np.array(left, object), return_inverse=True)
        dictionary = _sorted([x[::-1] for x in phrases], window)
        parse = _sorted(right, window)
        t1, t2 = np.maximum(t1, ta), np.minimum(t2, tb)
        marks = []
        for t in range(int(t1.min()), int(t2.max()) + 1):
            who = np.flatnonzero((t1 <= t) & (t <= t2))
            if who.size:
                key = classes(*dictionary, t)[phrase[who]] * (len(right) + 1) + classes(*parse, window - t)[who]
                marks.append((t, who[twice(key, copies[who])]))
        return ranges(marks, len(left))

    return repeats


def _shared(left: bytes, right: bytes, ta: int, ahead: int) -> int:
    x = hashlib.blake2b((left[len(left) - ta :] if ta else b"") + right[:ahead], digest_size=8, salt=ta.to_bytes(2, "big") + ahead.to_bytes(2, "big")).digest()
    return int.from_bytes(x, "big", signed=True)


def byte_units(window: int = WINDOW, trigger: int = TRIGGER) -> Units:
    def grams(t: bytes) -> tuple[bytes, np.ndarray]:
        return t, byte_grams(np.frombuffer(t, np.uint8), trigger)

    return Units(window, trigger, grams, lambda t, lo, hi: t[lo:hi], _repeats(window), _shared)


def _apply(window: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, spans in zip(as_bytes(b.column("text")), b.column("spans").to_pylist()):
                t = t or b""
                if not spans:
                    out.append((len(t), 0, 0, t))
                    continue
                gone = covered(spans, window, len(t))
                out.append((len(t), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), np.frombuffer(t, np.uint8)[~gone].tobytes()))
            cols = [pa.array([r[i] for r in out], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols, pa.array([r[3] for r in out], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def without_repeated_bytes(docs: DataFrame, window: int = WINDOW, trigger: int = TRIGGER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left) of each row of docs (doc_id, text, ...)."""
    keyed, spans = repeated(docs.select("doc_id", "text"), byte_units(window, trigger))
    rows = keyed.join(spans, KEY, "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_apply(window), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n_kept, kept = F.col("n_bytes") - F.col("n_removed"), F.make_valid_utf8(F.col("kept").cast("string"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), n_kept.alias("n_kept"), (F.col("n_removed") > 0).alias("repeats"), kept.alias("kept"))
