"""Cuts, resampling and listening samples against plain loops and ideal signals."""

import base64
import io
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import audio as U
from tidemark.sources import files


def plain_pieces(regions, energy, most, search, frame):
    out = []
    search = search if most > 4 * search else 0
    for r, key, a, b in regions:
        n = 1 if b - a <= most else max(1, int(np.ceil((b - a) / (most - 2 * search) - 1e-9)))
        cuts = []
        for k in range(1, n):
            even = a + k * (b - a) / n
            near = [(e, round(abs((i + 0.5) * frame - even), 6), i) for (rec, i), e in energy.items() if rec == r and i * frame >= even - search - 1e-7 and (i + 1) * frame <= even + search + 1e-7]
            cuts.append((min(near)[2] + 0.5) * frame if near and search else even)
        edges = [a, *cuts, b]
        out += [(r, key, k, round(x, 6), round(y, 6)) for k, (x, y) in enumerate(zip(edges, edges[1:]))]
    return sorted(out)


@pytest.mark.parametrize(("most", "search"), [(30.0, 1.0), (30.0, 8.0), (5.0, 1.0)])
def test_quiet_pieces(spark, most, search):
    r = random.Random(int(most + search))
    regions = [(f"r{k % 3}", k, round(a := r.random() * 50, 2), round(a + r.choice([3, 29.9, 30, 31, 95.5, 200]), 2)) for k in range(12)]
    # few energies, so that equals are as quiet; r2 has no frames
    energy = {(f"r{k}", i): float(r.randrange(3)) for k in range(2) for i in range(0, 14_000) if r.random() < 0.9}
    rows = spark.createDataFrame(regions, "recording_id string, region int, start_s double, end_s double")
    frames = spark.createDataFrame([(*k, e) for k, e in energy.items()], "recording_id string, frame_idx bigint, energy double")
    got = U.quiet_pieces(rows, frames, "region", most, search)
    got = sorted((x[0], x[1], x[2], round(x[3], 6), round(x[4], 6)) for x in got.collect())
    assert got == plain_pieces(regions, energy, most, search, U.FRAME_S)
    assert all(y - x <= most + 1e-6 for *_, x, y in got)
    assert U.quiet_pieces(rows.limit(0), frames, "region").count() == 0


@pytest.mark.parametrize(("own", "rate"), [(44_100, 16_000), (48_000, 16_000), (8000, 16_000), (22_050, 16_000), (11_025, 16_000), (16_001, 16_000)])
def test_resampling(own, rate):
    t = np.arange(own) / own
    x = 0.5 * np.sin(2 * np.pi * 440 * t) + 0.3 * np.sin(2 * np.pi * 2500 * t + 1)
    whole = U.resampled(x, own, rate, part_s=10)
    assert whole.size == round(x.size * rate / own)
    for part in (0.2, 0.0137, 1 / own):
        if part > 0.001 or own < 9000:
            assert (U.resampled(x, own, rate, part) == whole).all()
    at = np.arange(whole.size) / rate
    ideal = 0.5 * np.sin(2 * np.pi * 440 * at) + 0.3 * np.sin(2 * np.pi * 2500 * at + 1)
    edge = 200
    assert np.abs(whole - ideal)[edge:-edge].max() < 1e-4
    if own > rate * 1.3:  # what the lower rate cannot hold is gone
        assert np.abs(U.resampled(np.sin(2 * np.pi * 9000 * t), own, rate))[edge:-edge].max() < 1e-4
    for n in (0, 1, 7, 500):
        assert U.resampled(x[:n], own, rate).size == round(n * rate / own)


def wav(samples, rate, channels=1):
    f = io.BytesIO()
    with wave.open(f, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.rint(np.asarray(samples) * 32767).astype("<i2").tobytes())
    return f.getvalue()


def test_decoded_wav_is_resampled():
    t = np.arange(44_100) / 44_100
    x = files.decode_wav(wav(0.5 * np.sin(2 * np.pi * 1000 * t), 44_100))
    assert x.size == 16_000 and np.abs(x - 0.5 * np.sin(2 * np.pi * 1000 * np.arange(16_000) / 16_000))[200:-200].max() < 2e-4


def test_listening_assets(spark):
    rng = np.random.default_rng(1)
    audio = {"r": rng.uniform(-1.2, 1.2, 16_000 * 7 + 123), "q": rng.uniform(-0.5, 0.5, 16_000)}
    pieces = [("r", "A", "clean", 1000, 3500, 0.5), ("r", "A", "clean", 6000, 9000, 0.25), ("r", "B", "relaxed", 0, 5, 0.1), ("r", "C", "clean", 8000, 9000, 0.1), ("q", "A", "turns_fallback", 250, 751, 0.0)]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in audio.items()], "recording_id string, samples array<float>")
    chunks = U.audio_chunks(df, 5000)
    assert chunks.select(F.max(F.size("samples"))).first()[0] == 5000
    p = spark.createDataFrame(pieces, "recording_id string, speaker_id string, tier string, start_ms bigint, end_ms bigint, centrality double")
    got = {(r.recording_id, r.speaker_id): r for r in U.listening_assets(p, chunks, 5000).collect()}
    assert set(got) == {("r", "A"), ("r", "B"), ("q", "A")}  # C starts behind the end
    for who, r in got.items():
        expected = []
        for rec, s, _, a, b, _ in pieces:
            if (rec, s) == who:
                x = np.clip(audio[rec].astype(np.float32)[a * 16 : b * 16], -1, 1)
                k = min(160, x.size // 2)
                ramp = np.linspace(0, 1, k, dtype=np.float32)
                x[:k] *= ramp
                x[x.size - k :] *= ramp[::-1]
                expected.append(x)
        expected = np.rint(np.concatenate(expected) * 32767).astype("<i2")
        with wave.open(io.BytesIO(base64.b64decode(r.data))) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 2, 16_000)
            assert (np.frombuffer(w.readframes(w.getnframes()), "<i2") == expected).all()
        assert r.duration_ms == round(expected.size / 16) and (r.mime_type, r.encoding) == ("audio/wav", "base64")
    assert got["r", "A"].quality_tier == "clean" and [(s.start_ms, s.duration_ms, s.centrality) for s in got["r", "A"].snippets] == [(1000, 2500, 0.5), (6000, 3000, 0.25)]
    assert U.listening_assets(p.limit(0), chunks).count() == 0
