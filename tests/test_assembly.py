"""Payload checks, public names, listening samples, verification and chunks of one language."""

import random

import numpy as np

from tidemark.operators import assembly, languages, listening, verification

CODES = {"de": 1, "en": 2, "fr": 3, "it": 4}


def items(spark, rows, recording="r"):
    made = [(recording, i, float(s), CODES.get(c), p, float(a), float(b)) for i, (c, p, s, a, b) in enumerate(rows)]
    return spark.createDataFrame(made, "recording_id string, item_idx bigint, seconds double, code_idx bigint, probability double, start_s double, end_s double")


def in_order(df, *columns):
    names = {v: k for k, v in CODES.items()}
    return [tuple(names.get(r[c], r[c]) for c in columns) if len(columns) > 1 else names.get(r[columns[0]], r[columns[0]]) for r in df.orderBy("item_idx").collect()]


def test_smoothed_chunks(spark):
    got = lambda rows: in_order(languages.smoothed_chunks(items(spark, [(*r, 0, 0) for r in rows])), "smoothed")
    assert got([("en", 0.95, 25), ("fr", 0.4, 25), ("de", 0.9, 10), ("de", 0.92, 10), (None, None, 0.5)]) == ["en", "en", "de", "de", "en"]
    assert got([("en", 0.4, 10), ("fr", 0.45, 15), ("en", 0.3, 10)]) == ["en", "en", "en"]
    assert got([(None, None, 5), ("en", 0.99, 0.5)]) == ["de", "de"]
    assert got([("fr", 0.4, 40), ("en", 0.95, 25)]) == ["en", "en"]


def test_speaker_languages(spark):
    got = lambda rows: in_order(languages.speaker_languages(items(spark, [(*r, 0, 0) for r in rows])), "resolved", "source")
    assert got([("en", 0.97, 120), ("de", 0.9, 40), ("fr", 0.3, 30), (None, None, 0.4)]) == [("en", "detected"), ("de", "detected"), ("en", "majority"), ("en", "majority")]
    assert got([("en", 0.3, 30), (None, None, 9)]) == [("de", "fallback")] * 2


def test_smoothed_pieces(spark):
    def got(codes, spans):
        return in_order(languages.smoothed_pieces(items(spark, [(c, p, b - a, a, b) for (c, p), (a, b) in zip(codes, spans)])), "smoothed")

    spans = [(0.0, 10.0), (10.5, 12.0), (12.5, 13.5), (14.0, 24.0)]
    assert got([("de", 0.97), ("en", 0.3), (None, None), ("en", 0.95)], spans) == ["de", "de", "en", "en"]
    three = [(0.0, 20.0), (20.5, 24.0), (24.5, 40.0)]
    assert got([("de", 0.97), ("en", 0.80), ("de", 0.97)], three) == ["de", "de", "de"]
    assert got([("de", 0.97), ("en", 0.85), ("de", 0.97)], three) == ["de", "en", "de"]
    assert got([("fr", 0.3), ("fr", 0.4), (None, None), ("it", 0.2)], spans) == ["fr"] * 4
    assert got([(None, None)] * 4, spans) == ["de"] * 4


def test_public_names():
    assert assembly.public_names(["B", "A"], set()) == {"A": "A", "B": "B"}
    assert assembly.public_names(["A", "unknown-A"], {"A"}) == {"A": "unknown-A", "unknown-A": "unknown-unknown-A"}
    assert assembly.public_names(["A"], {"A", "unknown-A", "unknown-A-1"}) == {"A": "unknown-A-2"}


def test_profile_violations(spark):
    rows = [("a", [[1.0, 0.0]]), (" a ", [[0.0, 0.0]]), (" ", None), ("b" * 129, []), ("c", [[1.0], [1.0, float("nan")]]), ("d", [None])]
    got = [r.violations for r in assembly.profile_violations(spark.createDataFrame(rows, "profile_id string, vectors array<array<double>>"), 2).orderBy("profile_id").collect()]
    want = [["id", "no vector"], ["duplicate", "vector"], ["duplicate"], ["id", "no vector"], ["vector"], ["vector"]]
    assert got == want


def test_language_chunks():
    f = assembly.language_chunks
    regions = [(0.0, 9.0), (9.4, 40.0)]
    assert f(regions, []) == [(0.0, 9.0, None), (9.4, 40.0, None)]
    spans = [(0.0, 4.0, "de"), (4.0, 20.0, "en"), (20.0, 40.0, "de")]
    assert f(regions, spans) == [(0.0, 4.0, "de"), (4.0, 20.0, "en"), (20.0, 40.0, "de")]
    assert f([(0.0, 10.0)], [(0.0, 5.0, "de"), (5.0, 5.2, "en"), (5.2, 8.0, "de")]) == [(0.0, 10.0, "de")]
    assert f([(0.0, 12.0), (12.4, 12.75), (13.1, 20.0)], [(0.0, 12.0, "de"), (12.4, 12.75, "en"), (13.1, 20.0, "de")]) == [(0.0, 20.0, "de")]
    many = [(float(i), i + 0.8) for i in range(60)]
    one = f(many, [(0.0, 60.0, "fr")])
    assert [c[:2] for c in one] == [c[:2] for c in f(many, [])] and all(b - a <= 25 for a, b, _ in one)


def test_slices_against_all_starts():
    r = random.Random(3)
    for _ in range(60):
        s = np.sort([r.randrange(0, 60) for _ in range(6)])
        e = s + np.array([r.randrange(5, 30) for _ in range(6)])
        c, q = np.array([r.random() for _ in range(6)]), np.array([r.random() for _ in range(6)])
        first, last = int(s[0]), int(e.max())
        length = r.randrange(3, last - first + 1)
        best, quality, at = listening.slices(s, e, c, q, first, last, length)

        def score(x):
            w = np.clip(np.minimum(x + length, e) - np.maximum(x, s), 0, None)
            return (w * q) @ c / (w * q).sum() if (w * q).sum() > 0 else -1.0

        assert first <= at <= last - length and abs(score(at) - best) < 1e-12
        assert best >= max(score(x) for x in {first, last - length, *np.clip(s, first, last - length).tolist()}) - 1e-12
        assert 0 <= quality <= 1


def test_chosen():
    s = np.array([0, 3000, 20_000, 60_000])
    e = s + np.array([3000, 4000, 26_000, 4000])
    assert listening.chosen(s, e, np.array([0.5, 0.5, 0.9, 1.0]), np.ones(4)) == [(20_000, 46_000, 0.9)]
    assert [x[:2] for x in listening.chosen(s, e, np.array([0.5, 0.5, 0.4, 1.0]), np.ones(4), least=2000)] == [(0, 7000), (20_000, 39_000), (60_000, 64_000)]
    assert listening.chosen(s[:0], e[:0], np.empty(0), np.empty(0)) == []


def test_tiers(spark):
    w = [("r", "a", 0, 9000, 0.9, 0.9), ("r", "b", 0, 3000, 0.9, 0.5), ("r", "c", 0, 3000, 0.9, 0.1)]
    t = [("r", x, i, 0, n) for x in "abcd" for i, n in enumerate((9000, 600, 8000))]
    windows = spark.createDataFrame(w, "recording_id string, speaker_id string, start_ms bigint, end_ms bigint, centrality double, quality double")
    turns = spark.createDataFrame(t, "recording_id string, speaker_id string, turn_idx bigint, start_ms bigint, end_ms bigint")
    got = sorted((r.speaker_id, r.tier, r.end_ms - r.start_ms) for r in listening.samples(windows, turns).collect())
    assert got == [("a", "clean", 9000), ("b", "relaxed", 3000), *((x, "turns_fallback", n) for x in "cd" for n in (6000, 9000))]


def test_verified():
    r = np.random.default_rng(5)
    e = np.eye(16)
    v = np.array([e[i % 2] + 0.02 * r.standard_normal(16) for i in range(20)])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    names = np.array(["AB"[i % 2] for i in range(20)])
    wrong = names.copy()
    wrong[4], wrong[7], wrong[10] = "B", "A", "B"
    seconds, clean = np.full(20, 3.0), np.ones(20, bool)
    seconds[7], clean[10] = 1.2, False
    now, hint = verification.verified(v, wrong, seconds, clean)
    assert now[4] == "A" and now[7] == "A" and now[10] == "B"
    assert [h for i, h in enumerate(hint) if h] == ["B", "A"] and hint[7] == "B" and hint[10] == "A"
    assert verification.verified(v[:2], names[:2], seconds[:2], clean[:2])[1] == [None, None]
