"""License scans against common subsequences, and the quality model against plain loops."""

import math
import random
import struct
from collections import Counter

import pytest
import xxhash

from tidemark.llm import licenses, quality


def common(x, y):
    """Length of the longest common subsequence."""
    row = [0] * (len(y) + 1)
    for a in x:
        last = 0
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], last + 1 if a == b else max(row[j], row[j - 1])
    return row[-1]


def test_licenses_against_common_subsequences():
    """What covers enough of a template is found where it stands, and nothing is reported that does not."""
    r = random.Random(5)
    templates = {f"t{k}": " ".join(f"v{r.randrange(60)}" for _ in range(n)) for k, n in enumerate((6, 9, 25, 60))}
    index = licenses.Index(templates, 0.8)
    planted = missed = 0
    for _ in range(150):
        name = r.choice(sorted(templates))
        x = templates[name].split()
        y, lost = list(x), r.randrange(0, len(x) // 3 + 1)
        for _ in range(lost):
            i, how = r.randrange(len(y)), r.randrange(3)
            y[i : i + 1] = [f"n{r.randrange(9)}"] if how == 0 else [] if how == 1 else [f"n{r.randrange(9)}", y[i]]
        before, after = ([f"n{r.randrange(9)}" for _ in range(r.randrange(30))] for _ in range(2))
        text = " ".join(before + y + after)
        found = index.matches(text.encode())
        for m in found:
            inside = text[m["start"] : m["stop"]].split()
            whole = templates[m["license"]].split()
            assert m["matched"] <= common(whole, inside) and m["matched"] >= math.ceil(0.8 * len(whole) - 1e-9) and abs(m["coverage"] - m["matched"] / len(whole)) < 1e-12
        need = math.ceil(0.8 * len(x) - 1e-9)
        if common(x, y) < need:
            assert name not in {m["license"] for m in found}
        elif lost <= len(x) - need:
            planted += 1
            missed += not any(m["license"] == name and len(before) <= len(text[: m["start"]].split()) <= len(before) + len(y) for m in found)
    assert planted > 60 and not missed


def drawn(doc_id, seed=1):
    """The Gumbel noise of a doc_id: a 64-bit hash of the seed and the id as a number between 0 and 1."""
    h = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed=xxhash.xxh64_intdigest(struct.pack("<i", seed), seed=42))
    return -math.log(-math.log((h % 2**52 + 0.5) / 2**52))


def loops(texts, labels, noise):
    """The model of quality_scores by dictionaries: log weights, keys, and who is kept."""
    half = quality.BUCKETS // 2
    places = {i: [(h % half, (h >> 32) % half + half) for h in sorted({int(x) for x in quality.features((t or "").encode())})] for i, t in texts.items()}
    good = {i for i, (q, t) in labels.items() if q == 1 and t == 0}

    def weight(i, raw, target, n_raw, n_target):
        def ratio(b):
            expected = raw[b] * n_target / n_raw
            z = (abs(target[b] - expected) / math.sqrt(expected + 1)) ** 8
            return math.log((target[b] + 1) / (expected + 1)) * z / (z + 3.0**8)

        w = 0.0
        for a, b in places[i]:
            x, y = ratio(a), ratio(b)
            if x * y > 0:
                w += min(x, y, key=abs)
        return w

    def counts(ids):
        c = Counter()
        for i in ids:
            for p in places[i]:
                c.update(p)
        return c

    raw, target = counts(places), counts(good)
    weights = {i: weight(i, raw, target, len(texts), len(good)) for i in texts}
    held = {}
    for i in labels:
        own = counts([i])
        less = raw.copy()
        less.subtract(own)
        rest = target.copy()
        rest.subtract(own if i in good else Counter())
        held[i] = weight(i, less, rest, len(texts) - 1, len(good) - (i in good))
    known = sorted(set(held.values()))
    cuts = [known[0], *((a + b) / 2 for a, b in zip(known, known[1:]))]
    bad = set(labels) - good
    score = lambda c: sum(held[i] < c for i in bad) / len(bad) - sum(held[i] < c for i in good) / len(good)
    best = max(score(c) for c in cuts)
    cut = next(c for c in cuts if score(c) > best - 1e-12)
    k = sum(w >= cut for w in weights.values())
    keys = {i: w + noise * drawn(i) for i, w in weights.items()}
    least = sorted(keys.values(), reverse=True)[k - 1]
    return weights, keys, {i for i, x in keys.items() if x >= least}, {i for i, w in weights.items() if w >= cut}


@pytest.mark.parametrize("noise", [quality.NOISE, 2.0])
def test_quality_against_loops(spark, noise):
    r = random.Random(7)
    texts, labels = {}, {}
    for i in range(400):
        w = [f"w{r.randrange(120)}" for _ in range(40)]
        if i % 5 == 0:
            for _ in range(r.randrange(1, 5)):
                w[r.randrange(40)] = r.choice(["nasty", "horrid"])
        texts[i] = " ".join(w)
        if i % 2:
            labels[i] = (1, int(i % 5 == 0))
    texts |= {400: None, 401: "", 402: texts[0]}
    table = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    marks = spark.createDataFrame([(i, *x) for i, x in labels.items()], "doc_id bigint, quality int, toxic int")
    got = {x.doc_id: x for x in quality.quality_scores(table, marks, noise=noise).collect()}
    weights, keys, kept, above = loops(texts, labels, noise)
    assert {i: x.log_weight for i, x in got.items()} == pytest.approx(weights, abs=1e-4)
    assert {i: x.key for i, x in got.items()} == pytest.approx(keys, abs=1e-4)
    assert {i for i, x in got.items() if x.kept} == kept and 0 < len(kept) < len(texts) and min(weights.values()) < 0
    assert len(kept) == len(above) and (noise < 1 or kept != above)  # the draw decides near the cut
