"""Refinement of turns: fixed cases with known outcomes, corrupted labels at known rates, and every case in one recording of one table."""

import numpy as np
import pytest

from tidemark.operators import refinement as N

VOICE = {"A": (0, 1.0), "B": (1, 1.0)}


def vector(*parts):
    v = np.zeros(8)
    for i, x in parts:
        v[i] = x
    return (v / np.linalg.norm(v)).tolist()


A, B = vector((0, 1.0)), vector((1, 1.0))
#: Voices between A and B, nearer to B.
DOUBTFUL, CLEAR = vector((0, 0.30), (1, 0.80), (2, 0.27**0.5)), vector((0, 0.20), (1, 0.80), (2, 0.32**0.5))


class Case:
    """Turns (start, end, speaker), samples by speaker (vector, start, end), inliers by speaker."""

    def __init__(self, turns, samples, inliers, standard=None, overlaps=(), purity=None, prototypes=None, stitched=()):
        self.turns, self.samples, self.inliers, self.overlaps, self.stitched = turns, samples, inliers, overlaps, stitched
        self.standard = [*turns, *(standard or [])]
        self.purity, self.prototypes = purity or {}, {"A": A, "B": B} | (prototypes or {})


def three(v, at):
    return [(v, at + 3000 * i, at + 3000 * i + 3000) for i in range(3)]


def regular(**more):
    turns = [(0, 30_000, "A"), (32_000, 38_000, "A"), (40_000, 70_000, "B")]
    samples = {"A": [*three(A, 200), (DOUBTFUL, 32_200, 35_200), (DOUBTFUL, 35_200, 37_800)], "B": three(B, 40_200)}
    inliers = {"A": [0, 1, 2], "B": [0, 1, 2]}
    for k in ("A", "B"):
        samples[k] = samples[k] + more.pop(f"more_{k}", [])
        inliers[k] = more.pop(f"inliers_{k}", inliers[k])
    return Case(turns, samples, inliers, **more)


def corrupted(seed, share):
    truth = ["AB"[i % 2] for i in range(100)]
    wrong = set(np.random.default_rng(seed).choice(100, size=round(100 * share), replace=False).tolist())
    heard = ["BA"[i % 2] if i in wrong else t for i, t in enumerate(truth)]
    samples, inliers = {"A": [], "B": []}, {"A": [], "B": []}
    for i, (t, h) in enumerate(zip(truth, heard, strict=True)):
        if t == h:
            inliers[h].append(len(samples[h]))
        samples[h].append(({"A": A, "B": B}[t], i * 4000 + 200, i * 4000 + 2800))
    return Case([(i * 4000, i * 4000 + 3000, h) for i, h in enumerate(heard)], samples, inliers, purity={"A": 1 - share, "B": 1 - share}), wrong


def cases():
    out = {
        "regular": regular(),
        "compact": Case([(0, 9000, "A"), (10_000, 16_000, "A"), (17_000, 26_000, "B")], {"A": [*three(A, 200), (DOUBTFUL, 10_200, 13_200), (DOUBTFUL, 13_200, 15_800)], "B": three(B, 17_200)}, {"A": [0, 1, 2], "B": [0, 1, 2]}),
        "active": regular(standard=[(34_000, 35_000, "B")]),
        "overlap": regular(overlaps=[(32_000, 38_000)]),
        "veto": regular(more_A=[(A, 35_000, 37_500)]),
        "stitched": regular(stitched=[("A", 3), ("A", 4)]),
        "contaminated": regular(more_B=[(A, None, None)], stitched=[("B", 3)], prototypes={"B": A}),
        "lost": regular(inliers_A=[0, 1, 3]),
        "short": Case([(0, 30_000, "A"), (32_000, 34_600, "A"), (40_000, 70_000, "B")], {"A": [*three(A, 200), (CLEAR, 32_200, 34_400)], "B": three(B, 40_200)}, {"A": [0, 1, 2], "B": [0, 1, 2]}),
        "gone": Case([(0, 2600, "A"), (3000, 50_000, "B")], {"A": [(CLEAR, 200, 2400), *three(A, 51_000)], "B": three(B, 3200)}, {"A": [1, 2, 3], "B": [0, 1, 2]}),
        "broken seed": regular(more_B=[([0.0] * 8, 49_200, 52_200)], inliers_B=[0, 1, 2, 3]),
        "alone": Case([(0, 9000, "A")], {"A": three(A, 0)}, {"A": [0, 1, 2]}),
    }
    unrelated = vector((3, 1.0))
    mixed = regular(purity={"A": 0.65})
    mixed.samples["A"][3:3] = three(unrelated, 10_000)
    out["mixed"] = mixed
    at, turns, samples = 32_000, [(0, 30_000, "A")], three(A, 200)
    for _ in range(101):
        turns.append((at, at + 2600, "A"))
        samples.append((CLEAR, at + 200, at + 2400))
        at += 3000
    out["many"] = Case([*turns, (at + 1000, at + 31_000, "B")], {"A": samples, "B": three(B, at + 1200)}, {"A": [0, 1, 2], "B": [0, 1, 2]})
    return out


def tables(spark, all_cases):
    turns, standard, overlaps, samples, clouds = [], [], [], [], []
    for r, c in all_cases.items():
        turns += [(r, i, a, b, s) for i, (a, b, s) in enumerate(c.turns)]
        standard += [(r, s, a, b) for a, b, s in c.standard]
        overlaps += [(r, a, b) for a, b in c.overlaps]
        for s, rows in c.samples.items():
            base = 1000 * ord(s)
            for i, (v, a, b) in enumerate(rows):
                seconds = 3.0 if a is None else (b - a) / 1000
                samples.append((r, s, base + i, a, b, seconds, 1.0, seconds, (s, i) in c.stitched, v))
            clouds.append((r, s, "ready", c.purity.get(s, 0.9), c.prototypes[s], [base + i for i in c.inliers[s]]))
    return (
        spark.createDataFrame(turns, "recording_id string, turn_idx bigint, start_ms bigint, end_ms bigint, speaker_id string").repartition(4),
        spark.createDataFrame(standard, "recording_id string, speaker_id string, start_ms bigint, end_ms bigint"),
        spark.createDataFrame(overlaps, "recording_id string, start_ms bigint, end_ms bigint"),
        spark.createDataFrame(samples, "recording_id string, speaker_id string, sample_idx bigint, start_ms bigint, end_ms bigint, seconds double, quality double, weight double, stitched boolean, vector array<double>").repartition(4),
        spark.createDataFrame(clouds, "recording_id string, speaker_id string, status string, purity double, prototype array<double>, ids array<bigint>"),
    )


@pytest.fixture(scope="module")
def refined(spark):
    all_cases, wrong = cases(), {}
    for share in (0.0, 0.05, 0.10):
        for seed in range(10):
            all_cases[f"{share}-{seed}"], wrong[f"{share}-{seed}"] = corrupted(seed, share)
    t, standard, overlaps, s, c = tables(spark, all_cases)
    windows = N.evidence(t, standard, overlaps, s, c).cache()
    changes = N.proposals(t, windows).cache()
    new = N.rebuilt(t, s, c, changes).cache()
    reasons = N.checked(t, standard, s, c, changes, new).cache()
    report = {r.recording_id: r for r in N.report(t, windows, changes, reasons).collect()}
    after = {}
    for r in N.applied(t, changes, reasons).collect():
        after.setdefault(r.recording_id, {})[r.turn_idx] = (r.original_speaker_id, r.speaker_id)
    return all_cases, wrong, (t, windows, changes, reasons, c, new), report, after


def test_outcomes(refined):
    _, _, _, report, after = refined
    got = {k: (r.status, r.rollback_reason) for k, r in report.items() if "-" not in k}
    assert got == {
        "regular": ("applied", None), "compact": ("rejected", "reassigned_speech_exceeds_10_percent"), "active": ("not_needed", None), "overlap": ("not_needed", None), "veto": ("not_needed", None), "stitched": ("not_needed", None),
        "contaminated": ("applied", None), "lost": ("rejected", "seed_core_lost"), "short": ("applied", None), "gone": ("rejected", "speaker_count_changed"), "mixed": ("rejected", "ready_cloud_became_mixed_cluster"),
        "many": ("rejected", "reassigned_speech_exceeds_10_percent"), "broken seed": ("not_needed", None), "alone": ("not_needed", None),
    }
    assert after["regular"] == {0: ("A", "A"), 1: ("A", "B"), 2: ("B", "B")} and after["compact"][1] == ("A", "A")
    r = report["regular"]
    assert (r.proposed_turns, r.applied_turns, r.reassigned_duration_ms, r.changes_truncated) == (1, 1, 6000, False)
    assert r.eligible_windows == 8 and report["overlap"].eligible_windows == 6
    change = r.changes[0]
    assert (change.from_speaker_id, change.to_speaker_id, change.supporting_windows, change.evidence_duration_ms, change.short_turn_exception) == ("A", "B", 2, 5600, False)
    assert (change.evidence_coverage, change.weighted_vote_share, change.target_cosine, change.own_cosine, change.similarity_gain, change.runner_up_margin) == (0.933333, 1.0, 0.8, 0.3, 0.5, 1.8)
    assert report["short"].changes[0].short_turn_exception and report["contaminated"].changes[0].to_speaker_id == "B"
    many = report["many"]
    assert (many.proposed_turns, len(many.changes), many.changes_truncated, many.applied_turns, many.reassigned_duration_ms) == (101, 100, True, 0, 0)
    assert [c.start_ms for c in many.changes] == sorted(c.start_ms for c in many.changes)


def test_corrupted_labels(refined):
    """At 0, 5 and 10 % of wrong labels exactly those are changed, and changed back to the truth."""
    all_cases, wrong, _, report, after = refined
    for k, bad in wrong.items():
        changed = {i for i, (old, new) in after[k].items() if old != new}
        assert changed == bad and all(after[k][i][1] == "AB"[i % 2] for i in range(100)), k
        assert report[k].status == ("applied" if bad else "not_needed")


def test_modes_and_clouds(spark, refined):
    _, _, (t, windows, changes, reasons, c, new), report, _ = refined
    shadow = {r.recording_id: r for r in N.report(t, windows, changes, reasons, "shadow").collect()}
    assert shadow["regular"].status == shadow["compact"].status == "shadow" and shadow["veto"].status == "not_needed"
    assert (shadow["regular"].proposed_turns, shadow["regular"].applied_turns, shadow["compact"].rollback_reason) == (1, 0, None)
    off = {r.recording_id: r for r in N.report(t, windows, changes, None, "off").collect()}
    assert {(r.status, r.eligible_windows, len(r.changes)) for r in off.values()} == {("disabled", 0, 0)} and off.keys() == report.keys()
    with pytest.raises(ValueError, match="refinement"):
        N.report(t, windows, changes, reasons, "aggressive")
    effective = {(r.recording_id, r.speaker_id): r for r in N.effective_clouds(c, new, reasons).collect()}
    assert (effective["regular", "A"].candidates, effective["regular", "B"].candidates) == (3, 5)  # both doubtful samples moved
    assert effective["compact", "A"].ids == [65_000, 65_001, 65_002]


def test_nothing_to_refine(spark):
    t, standard, overlaps, s, c = tables(spark, {"regular": regular()})
    none = lambda df: df.limit(0)
    windows = N.evidence(t, standard, overlaps, none(s), none(c))
    assert windows.count() == 0 and N.proposals(t, windows).count() == 0
    assert [r.status for r in N.report(t, windows, N.proposals(t, windows), None).collect()] == ["not_needed"]
