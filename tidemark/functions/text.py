"""Scalar expressions on text, time and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_empty_content(text: Column) -> Column:
    """No letter, digit or underscore."""
    return text.isNull() | ~text.rlike(r"[\p{L}\p{N}_]")


def disposition(text: Column, length_ms: Column, least: int = 1000) -> Column:
    """keep; for empty content asr_failure from a second on, else drop."""
    return F.when(~is_empty_content(text), "keep").when(length_ms >= least, "asr_failure").otherwise("drop")


def alignable(word: Column) -> Column:
    """The a-z of a word in lower case, umlauts and sharp s as plain letters; null if nothing is left."""
    w = F.replace(F.translate(F.lower(word), "äöü", "aou"), F.lit("ß"), F.lit("ss"))
    w = F.regexp_replace(w, "[^a-z]", "")
    return F.when(w != "", w)


def timecode(ms: Column) -> Column:
    """HH:MM:SS.mmm of milliseconds."""
    part = lambda x, n: F.lpad(F.floor(x).cast("string"), n, "0")
    return F.concat(part(ms / 3_600_000, 2), F.lit(":"), part(F.pmod(F.floor(ms / 60_000), F.lit(60)), 2), F.lit(":"), part(F.pmod(F.floor(ms / 1000), F.lit(60)), 2), F.lit("."), part(F.pmod(ms, F.lit(1000)), 3))


def nice_scale(x: Column) -> Column:
    """The next of 1, 2, 5 and 10 times a power of ten."""
    base = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    r = x / base
    return F.when(x > 0, F.when(r <= 1, 1).when(r <= 2, 2).when(r <= 5, 5).otherwise(10) * base).otherwise(1.0)


def queue_scale(x: Column) -> Column:
    """The next of 4, 8, 16, 32, 64, then the next multiple of 32."""
    return F.when(x <= 4, 4).when(x <= 8, 8).when(x <= 16, 16).when(x <= 32, 32).when(x <= 64, 64).otherwise(F.ceil(x / 32) * 32).cast("bigint")


def rtf_label(x: Column) -> Column:
    """No decimals from 10 on, one from 1 on, else two."""
    return F.when(x >= 10, F.format_string("%.0f", x)).when(x >= 1, F.format_string("%.1f", x)).otherwise(F.format_string("%.2f", x))


def language_override(code: Column, probability: Column, seconds: Column, prior: Column, least_s: float = 1.5, least_p: float = 0.85) -> Column:
    """A turn's own language where it is sure, long enough and not its speaker's; else the speaker's."""
    return F.when(code.isNotNull() & (seconds >= least_s) & (probability >= least_p) & (prior.isNull() | (code != prior)), code).otherwise(prior)


def batch_bucket(n: Column, most: int = 8) -> Column:
    """The next power of two, at most `most`."""
    return F.least(F.lit(most), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(n, F.lit(1)))))).cast("bigint")


def frame_bucket(n: Column, step: int = 128) -> Column:
    return (F.ceil(n / step) * step).cast("bigint")
