"""Audio as tables: regions cut at their quietest moments, resampling with state, and listening samples cut out of chunks of PCM.

A recording's audio is a table of chunks (recording_id, chunk_idx, samples), so that no row holds a whole recording; what is cut meets only the chunks that it
touches, by an equi-join on their numbers.
"""

from __future__ import annotations

import base64
import io
import math
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Samples a second; seconds of the longest piece, of the search around a planned cut and of a frame; milliseconds of a fade.
RATE, MOST_S, SEARCH_S, FRAME_S, FADE_MS = 16_000, 30.0, 1.0, 0.02, 10
#: Zero crossings of the filter on either side, its Kaiser window, and the part of the lower Nyquist frequency that it passes.
CROSSINGS, KAISER, PASSED = 48, 12.0, 0.95


def quiet_pieces(regions: DataFrame, frames: DataFrame, key: str, most: float = MOST_S, search: float = SEARCH_S, frame: float = FRAME_S, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """recording_id, key, piece, start, end: each region whole, or in parts of at most `most`, each cut at the centre of the quietest frame within `search` of its even place.

    frames: recording_id, frame_idx, energy; frame i lies between i and i + 1 times `frame`. The nearest to the even place counts among equals, the earlier of two as near;
    a cut without a whole frame around it stays. Parts are planned shorter by twice the search. Each cut meets the numbers of its frames only.
    """
    search = search if most > 4 * search else 0.0
    length = F.col(end) - F.col(start)
    n = F.when(length <= most, 1).otherwise(F.greatest(F.lit(1), F.ceil(length / (most - 2 * search) - 1e-9))).cast("bigint")
    r = regions.where(length > 0).select("recording_id", key, F.col(start).cast("double").alias(start), F.col(end).cast("double").alias(end)).withColumn("_n", n)
    cuts = r.where("_n > 1").withColumn("_k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n") - 1)))
    cuts = cuts.withColumn("_even", F.col(start) + F.col("_k") * (F.col(end) - F.col(start)) / F.col("_n")).select("recording_id", key, "_k", "_even")
    if search:
        first, last = F.ceil((F.col("_even") - search) / frame - 1e-9), F.floor((F.col("_even") + search) / frame + 1e-9) - 1
        near = cuts.where(last >= first).withColumn("frame_idx", F.explode(F.sequence(first, last)))
        near = near.join(frames.select("recording_id", "frame_idx", "energy"), ["recording_id", "frame_idx"]).withColumn("_at", (F.col("frame_idx") + 0.5) * frame)
        # distances are compared to a millionth, so that both sides of the middle are as near
        best = near.groupBy("recording_id", key, "_k").agg(F.min_by("_at", F.struct("energy", F.round(F.abs(F.col("_at") - F.col("_even")), 6).alias("d"), "frame_idx")).alias("_cut"))
        cuts = cuts.join(best, ["recording_id", key, "_k"], "left")
    else:
        cuts = cuts.withColumn("_cut", F.lit(None).cast("double"))
    at = cuts.groupBy("recording_id", key).agg(F.sort_array(F.collect_list(F.struct("_k", F.coalesce("_cut", "_even").alias("t")))).alias("_cuts"))
    edges = F.concat(F.array(start), F.coalesce(F.transform("_cuts", lambda c: c["t"]), F.array().cast("array<double>")), F.array(end))
    r = r.join(at, ["recording_id", key], "left").withColumn("_e", edges).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    place = F.col("piece").cast("int")
    return r.select("recording_id", key, "piece", F.get("_e", place).alias(start), F.get("_e", place + 1).alias(end))


class Resampler:
    """A windowed-sinc filter between two rates that takes samples in parts of any size; together its results are those of one call."""

    def __init__(self, own: int, rate: int) -> None:
        self.own, self.rate = own, rate
        common = math.gcd(own, rate)
        self.up, self.down = rate // common, own // common
        low = min(1.0, rate / own) * PASSED
        self.half = math.ceil(CROSSINGS / low)
        # a row of weights for each phase of an output between two inputs
        k = np.arange(-self.half + 1, self.half + 1)
        t = np.arange(self.up)[:, None] / self.up - k[None, :]
        window = np.i0(KAISER * np.sqrt(np.maximum(0, 1 - (t / self.half) ** 2))) / np.i0(KAISER)
        self.weights = np.where(np.abs(t) <= self.half, low * np.sinc(low * t) * window, 0.0)
        self.weights /= self.weights.sum(axis=1, keepdims=True)
        self.held, self.before = np.zeros(self.half - 1), self.half - 1  # samples at hand, and how many of them stand before the sample of the next output
        self.next, self.seen = 0, 0

    def _ready(self, last: int) -> np.ndarray:
        """Outputs from the next one up to `last`, for which all samples are at hand; those that no longer count are dropped."""
        if last <= self.next:
            return np.empty(0)
        n = np.arange(self.next, last)
        base = n * self.down // self.up
        first = self.next * self.down // self.up
        out = np.empty(n.size)
        width = 2 * self.half
        for a in range(0, n.size, 8192):
            at = (base[a : a + 8192] - first)[:, None] + np.arange(width)[None, :]
            out[a : a + 8192] = (self.held[at] * self.weights[n[a : a + 8192] * self.down % self.up]).sum(axis=1)
        self.next = last
        self.held = self.held[last * self.down // self.up - first :]
        return out

    def process(self, samples: np.ndarray) -> np.ndarray:
        self.held = np.concatenate([self.held, np.asarray(samples, np.float64)])
        self.seen += len(samples)
        # output n needs samples up to floor(n * down / up) + half
        return self._ready(max(self.next, ((self.seen - self.half) * self.up - 1) // self.down + 1) if self.seen > self.half else self.next)

    def finish(self) -> np.ndarray:
        """The rest, up to round(samples * rate / own) in all."""
        self.held = np.concatenate([self.held, np.zeros(2 * self.half + self.down)])
        return self._ready(round(self.seen * self.rate / self.own))


def resampled(samples: np.ndarray, own: int, rate: int, part_s: float = 0.2) -> np.ndarray:
    """Samples at another rate, float32; worked on in parts so that no large matrix is made."""
    if own == rate or not len(samples):
        return np.asarray(samples, np.float32)
    r, size = Resampler(own, rate), max(1, int(part_s * own))
    parts = [r.process(samples[a : a + size]) for a in range(0, len(samples), size)]
    return np.concatenate([*parts, r.finish()]).astype(np.float32)


def audio_chunks(audio: DataFrame, size: int = 10 * RATE, key: str = "recording_id") -> DataFrame:
    """key, chunk_idx, samples of audio (key, samples), so many samples a chunk."""
    last = F.ceil(F.size("samples") / size) - 1
    rows = audio.where(F.size("samples") > 0).withColumn("chunk_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return rows.select(key, "chunk_idx", F.slice("samples", (F.col("chunk_idx") * size + 1).cast("int"), size).alias("samples"))


def _wav(rate: float):  # noqa: ANN202
    fade = round(FADE_MS * rate / 1000)

    @F.pandas_udf("bytes long, samples long, data string")
    def encode(pieces: pd.Series) -> pd.DataFrame:
        rows = []
        for ps in pieces:
            out = []
            for p in ps:
                x = np.clip(np.asarray(p, np.float32), -1.0, 1.0)
                if not np.isfinite(x).all():
                    raise ValueError("samples that are not finite")
                k = min(fade, x.size // 2)
                if k:
                    ramp = np.linspace(0.0, 1.0, k, dtype=np.float32)
                    x[:k] *= ramp
                    x[-k:] *= ramp[::-1]
                out.append(x)
            pcm = np.rint(np.concatenate(out) * 32767.0).astype("<i2") if out else np.empty(0, "<i2")
            with io.BytesIO() as f:
                with wave.open(f, "wb") as w:
                    w.setnchannels(1)
                    w.setsampwidth(2)
                    w.setframerate(max(1, round(rate)))
                    w.writeframes(pcm.tobytes())
                content = f.getvalue()
            rows.append((len(content), pcm.size, base64.b64encode(content).decode()))
        return pd.DataFrame(rows, columns=["bytes", "samples", "data"])

    return encode


def listening_assets(pieces: DataFrame, chunks: DataFrame, size: int = 10 * RATE, rate: float = RATE) -> DataFrame:
    """recording_id, speaker_id, quality_tier, duration_ms, snippets, mime_type, encoding, data of each speaker's listening sample.

    pieces: recording_id, speaker_id, tier, start_ms, end_ms, centrality (`listening.samples` bounds them to 30 s a speaker); chunks as audio_chunks makes them. Pieces are clipped to the audio, faded at both
    ends and put one after the other as WAV in base64. Speakers of whom no sample is left have no row.
    """
    who = ["recording_id", "speaker_id"]
    sample: Column = lambda c: F.round(F.col(c) * (rate / 1000)).cast("bigint")
    p = pieces.withColumns({"_a": F.greatest(sample("start_ms"), F.lit(0)), "_b": sample("end_ms")}).where("_b > _a")
    met = p.withColumn("chunk_idx", F.explode(F.sequence(F.floor(F.col("_a") / size), F.floor((F.col("_b") - 1) / size)))).join(chunks, ["recording_id", "chunk_idx"])
    base = F.col("chunk_idx") * size
    first, last = F.greatest(F.col("_a") - base, F.lit(0)), F.least(F.col("_b") - base, F.size("samples"))
    met = met.where(last > first).withColumn("part", F.slice("samples", (first + 1).cast("int"), (last - first).cast("int")))
    own = ["tier", "start_ms", "end_ms", "centrality"]
    whole = met.groupBy(*who, *own).agg(F.sort_array(F.collect_list(F.struct("chunk_idx", "part"))).alias("_x"))
    whole = whole.withColumn("x", F.flatten(F.transform("_x", lambda e: e["part"])))
    item = F.struct("start_ms", "end_ms", F.round("centrality", 6).alias("centrality"), "x")
    each = whole.groupBy(*who).agg(F.min("tier").alias("quality_tier"), F.sort_array(F.collect_list(item)).alias("_p"))
    each = each.withColumn("_wav", _wav(rate)(F.transform("_p", lambda e: e["x"])))
    snippets = F.transform("_p", lambda e: F.struct(e["start_ms"].alias("start_ms"), e["end_ms"].alias("end_ms"), (e["end_ms"] - e["start_ms"]).alias("duration_ms"), e["centrality"].alias("centrality")))
    return each.select(*who, "quality_tier", F.round(F.col("_wav.samples") * 1000 / rate).cast("bigint").alias("duration_ms"), snippets.alias("snippets"), F.lit("audio/wav").alias("mime_type"), F.lit("base64").alias("encoding"), F.col("_wav.data").alias("data"))


def chunked_by_rows(rows: DataFrame, order: str, samples: str, size: int, key: str = "recording_id") -> DataFrame:
    """Chunks of audio that comes as rows of `size` samples each, in order within key."""
    place = F.row_number().over(W.partitionBy(key).orderBy(order)) - 1
    return rows.where(F.size(samples) == size).select(key, place.cast("bigint").alias("chunk_idx"), F.col(samples).alias("samples"))
