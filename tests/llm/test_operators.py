"""The ten operators against brute-force versions on small tables with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import components, decontaminate, embeddings, jaccard, licenses, mixing, packing, quality, suffix_arrays, suffix_trees, token_counts
from tidemark.llm.repeats import repeated

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, source string, component_id string, label string, n_hit string, k1 string"


def lower(b):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in b)


def words(text):
    return WORD.findall((text or "").encode())


def made_texts(seed, n=60, vocabulary=400):
    r = random.Random(seed)
    some = lambda k: [f"w{r.randrange(vocabulary)}" for _ in range(k)]
    passage, base = some(60), some(120)
    out = [None, "", " \n\t ", "one", "One", "one two", "one two", "ï ï x", "x" * 3000, "y " * 900]
    for i in range(n):
        w = some(r.choice([5, 30, 100, 200]))
        if i % 4 == 0:
            w = list(base)
            for _ in range(r.randrange(0, 6)):
                w[r.randrange(len(w))] = some(1)[0]
        elif i % 4 == 1:
            at = r.randrange(len(w))
            w[at:at] = passage[r.randrange(10) :]
        out.append(" ".join(w) if i % 7 else "\n".join(w).upper())
    return out + [out[14], out[14]]


def docs(spark, texts):
    rows = [(i, t, f"s{i % 3}" if i % 5 else None, "a", "b", "c", "d") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def groups_of(n, links):
    at = list(range(n))
    for _ in range(n):
        for a, b in links:
            at[a] = at[b] = min(at[a], at[b])
    return at


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 230)]
    got = {x.id: x.component for x in components.connected_components(spark.createDataFrame(edges + edges[:5] + [(None, 3)], "u bigint, v bigint")).collect()}
    want = groups_of(230, edges)
    assert got == {i: want[i] for e in edges if e[0] != e[1] for i in e}
    assert components.connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def shingles(text, k):
    w = WORD.findall(lower((text or "").encode()))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_jaccard(spark, width, percent):
    texts = made_texts(1)
    sets = [shingles(t, width) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    table = docs(spark, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(table, width, percent).collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, groups_of(len(texts), links)))}
    found, member = jaccard.jaccard_links(table, width, percent)
    of = {r.doc_id: r.s for r in member.collect()}
    assert {frozenset((r.a, r.b)) for r in found.collect()} == {frozenset((of[a], of[b])) for a, b in links if of[a] != of[b]}
    kept = jaccard.one_of_each(table, width, percent)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {c for _, c in got.values()}


def test_jaccard_edges(spark):
    assert jaccard.jaccard_groups(empty(spark)).count() == 0
    rows = [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, None)]
    got = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 0, 0), (0, 2, 7), (7, 2, 7), (7, 2, 7)]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sum(r.doc_id == 7 for r in kept) == 1


def test_token_counts(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(5)
    parts = [*"ab \n\té漢😀", "<s>", "</s>", "<0x0A>", "<unk>", "  ", "▁", "the", " ", "ing"]
    texts = made_texts(2, 10) + ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(300)]
    rows = {x.doc_id: x for x in token_counts.token_counts(docs(spark, texts), path, over=50).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or ""))
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len((t or "").encode()), n, n > 50), t
    assert token_counts.token_counts(empty(spark), path).count() == 0


def test_token_counts_of_rank_file(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    import base64

    import tiktoken

    path = tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", "Hello  world's 123", "<|endoftext|> é漢\n\n x"] + [t for t in made_texts(3, 8) if t]
    got = {x.doc_id: x.n_tokens for x in token_counts.token_counts(docs(spark, texts), path, tokenizers.PATTERN).collect()}
    assert got == {i: len(e.encode_ordinary(t)) for i, t in enumerate(texts)}


def test_licenses(spark):
    mit, notice = licenses.TEMPLATES["mit"], licenses.TEMPLATES["gpl-3.0-notice"]
    altered = mit.replace("without restriction", "with no restriction").replace("Software", "program", 1)
    texts = [None, "", "no license here at all", f"é {notice}", f"a b c\n{altered} d", f"{notice} x {mit.upper()} y {notice}", " ".join(mit.split()[:40]), "Released under the MIT license"]
    rows = {r.doc_id: r.matches for r in licenses.license_matches(docs(spark, texts)).collect()}
    assert [[m.license for m in rows[i]] for i in range(len(texts))] == [[], [], [], ["gpl-3.0-notice"], ["mit"], ["gpl-3.0-notice", "mit", "gpl-3.0-notice"], [], ["mit-notice"]]
    assert texts[3][rows[3][0].start : rows[3][0].stop] == notice.rstrip(".")
    assert 0.95 < rows[4][0].coverage < 1 and texts[4][rows[4][0].start :].startswith("Permission is hereby")
    assert licenses.license_matches(empty(spark)).count() == 0


def test_license_repeats_and_changed_words():
    index = licenses.Index(licenses.TEMPLATES, licenses.COVERAGE)
    names = lambda text: [m["license"] for m in index.matches(text.encode())]
    for name, text in licenses.TEMPLATES.items():
        assert names(f"{text} {text}") == [name] * 2
        assert names(" qqq zzz ".join([text] * 3)) == [name] * 3
        w = text.split()
        if name.endswith("notice"):
            assert names(" ".join([text] * 1000)) == [name] * 1000
            for i, x in enumerate(w):
                if len(licenses.words(x.encode())[0]) == 1:
                    assert names(" ".join(["a b c", *w[:i], "qqq", *w[i + 1 :], "d e"])) == [name], (name, x)
        else:
            assert names(" ".join("qqq" if i % 6 == 4 and x.isalpha() else x for i, x in enumerate(w))) == [name]


def test_license_alignment():
    r = random.Random(7)
    for _ in range(60):
        x = [r.randrange(6) for _ in range(12)]
        y = [w for w in x if r.random() < 0.9] + [r.randrange(6)]
        y[3:3] = [9] * r.randrange(2)
        best = np.zeros((len(x) + 1, len(y) + 1))
        for i, j in itertools.product(range(len(x)), range(len(y))):
            best[i + 1, j + 1] = max(0, best[i, j] + (2 if x[i] == y[j] else -1), best[i, j + 1] - 1, best[i + 1, j] - 1)
        n, first, last = licenses.align(x, y, 0, 30)
        assert 2 * n - (max(last - first, n) - n) * 1 >= best.max() - len(x) and 0 <= first < last <= len(y)


def test_embeddings(spark):
    r = np.random.default_rng(4)
    base = r.standard_normal((12, 16))
    v = [(base[i % 12] + r.standard_normal(16) * 0.08 * (i % 5)).tolist() for i in range(200)]
    v += [v[0], v[0], v[1], None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] * 16, [1.0, 2.0]]
    rows = [(i, x, "a", 1) for i, x in enumerate(v)] + [(None, v[0], "a", 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, component_id string, label int").repartition(3)
    m = np.array(v[:203], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = [(a, b) for a, b in itertools.combinations(range(203), 2) if m[a] @ m[b] >= 0.95]
    for cell in (1024, 7):
        got = {x.vec_id: x for x in embeddings.embedding_groups(table, recall=0.999999, cell=cell).collect()}
        at, n = groups_of(len(v), near), Counter(itertools.chain(*near))
        assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(len(v))] == [(n[i], at[i], at[i] == i) for i in range(len(v))]
        assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, None)
    assert embeddings.embedding_groups(table.limit(0)).count() == 0


def test_embedding_recall(spark):
    """Pairs just above the least cosine are found as often as asked for."""
    r = np.random.default_rng(6)
    x = r.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.standard_normal((1500, 64))
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    pairs = np.concatenate([x, 0.951 * x + np.sqrt(1 - 0.951**2) * y])
    table = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pairs)], "vec_id bigint, embedding array<double>")
    got = embeddings.embedding_groups(table).where("n_links = 1").count()
    assert got >= 0.98 * 3000


def test_targets():
    for sizes in ([100, 100, 100], [1000, 10, 1, 0], [5], [0, 0], [3, 1000, 2, 1], []):
        t = mixing.targets(sizes)
        assert sum(t) == sum(sizes) and all(0 <= x <= 3 * s for x, s in zip(t, sizes))
        open_ = [x / (i % 3 + 1) for i, (x, s) in enumerate(zip(t, sizes)) if x < 3 * s]
        assert len(set(open_)) <= 1


def test_deal():
    d = mixing.deal([100, 7, 0, 53], 8, 1)
    assert d.sum(axis=0).tolist() == [100, 7, 0, 53] and d.sum(axis=1).tolist() == [20] * 8 and (d == mixing.deal([100, 7, 0, 53], 8, 1)).all()


def test_mixing(spark):
    r = random.Random(8)
    texts = [None, ""] + [" ".join(["w"] * r.choice([1, 2, 5, 30])) for _ in range(600)]
    table = docs(spark, texts)
    got = {x.doc_id: x for x in mixing.mix_plan(table, blocks=8, shards=4).collect()}
    sources = sorted({f"s{i % 3}" if i % 5 else None for i in range(len(texts))}, key=lambda s: (s is None, s))
    of = {i: f"s{i % 3}" if i % 5 else None for i in range(len(texts))}
    size = {s: sum(len(words(texts[i])) for i in of if of[i] == s) for s in sources}
    want = dict(zip(sources, map(float, mixing.targets([size[s] for s in sources]))))
    for i, t in enumerate(texts):
        assert (got[i].size, got[i].source_size) == (len(words(t)), size[of[i]]) and got[i].target == pytest.approx(want[of[i]]) and got[i].taken == got[i].size * got[i].times <= 3 * got[i].size
    for s in sources:
        assert abs(sum(got[i].taken for i in of if of[i] == s) - want[s]) <= 30
    rows = mixing.mixed(table, blocks=8, shards=4)
    assert rows.columns == table.columns and Counter(x.doc_id for x in rows.collect()) == Counter({i: x.times for i, x in got.items() if x.times})
    assert [x.doc_id for x in rows.collect()] == [x.doc_id for x in mixing.mixed(table, blocks=8, shards=4).collect()]
    assert mixing.mix_plan(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0


def test_mixing_fills_past_long_documents(spark):
    """No document below the room left stays out, also where a very long one takes most of its block."""
    r = random.Random(21)
    texts = {i: " ".join(["w"] * r.choice([2, 3, 7, 40])) for i in range(1200)}
    texts |= {0: "w " * 9000, 1: "w " * 5000, 2: "w " * 3000}
    table = spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in texts.items()], "doc_id bigint, text string, source string")
    for seed in (1, 2, 3):
        got = mixing.mix_plan(table, blocks=8, shards=4, seed=seed).collect()
        for s in range(3):
            own = [x for x in got if x.doc_id % 3 == s]
            left, whole = own[0].target - sum(x.taken for x in own), own[0].target // own[0].source_size
            assert 0 <= left < min(x.size for x in own if x.times == whole), (seed, s)
        assert Counter(x.doc_id for x in mixing.mixed(table, blocks=8, shards=4, seed=seed).collect()) == Counter({x.doc_id: x.times for x in got if x.times})


def test_mixing_draws_again_to_fill(spark):
    """What is left is below every document that could be drawn again, none is drawn more than three times, and reruns agree."""
    r = random.Random(5)
    texts = {i: " ".join(["w"] * r.choice([3, 20, 700, 900])) for i in range(150)}
    table = spark.createDataFrame([(i, t, f"s{i % 5}") for i, t in texts.items()], "doc_id bigint, text string, source string")
    again = 0
    for seed in (1, 2):
        got = mixing.mix_plan(table, seed=seed).collect()
        for s in range(5):
            own = [x for x in got if x.doc_id % 5 == s]
            left, whole = own[0].target - sum(x.taken for x in own), int(own[0].target // own[0].source_size)
            again += sum(x.times == whole + 2 for x in own)
            assert 0 <= left and max(x.times for x in own) <= 3
            assert left < 1 or left < min([x.size for x in own if x.times < min(3, whole + 2)], default=math.inf)
        assert Counter(x.doc_id for x in mixing.mixed(table, seed=seed).collect()) == Counter({x.doc_id: x.times for x in got if x.times})
        assert got == mixing.mix_plan(table, seed=seed).collect() or sorted(got) == sorted(mixing.mix_plan(table, seed=seed).collect())
    assert again


def test_mix_plan_counts_dealt_draws(spark, monkeypatch):
    """Each block's draw lies in one shard, shards are of equal size, and the plan counts what the shards hold."""
    table = docs(spark, [" ".join(["w"] * (1 + i % 9)) for i in range(700)])
    m = mixing.Mix(table, blocks=8, shards=4)
    rows = m._placed(mixing.dealt(m, m.rows).select("_row", "_key", "doc_id", "_shard", "_draw")).collect()
    of = {}
    for x in rows:
        of.setdefault((x["_key"], x["_block"], x["_draw"]), set()).add(x["_shard"])
    assert all(len(s) == 1 for s in of.values())
    quota = Counter(s for (s,) in of.values())
    assert set(quota) == {0, 1, 2, 3} and max(quota.values()) - min(quota.values()) <= 1
    times = {x.doc_id: x.times for x in mixing.mix_plan(table, blocks=8, shards=4).collect()}
    assert Counter(x["doc_id"] for x in rows) == Counter({i: n for i, n in times.items() if n})
    every = mixing.dealt
    monkeypatch.setattr(mixing, "dealt", lambda m, rows: every(m, rows).where("_shard > 0"))
    times = {x.doc_id: x.times for x in mixing.mix_plan(table, blocks=8, shards=4).collect()}
    assert Counter(x["doc_id"] for x in rows if x["_shard"]) == Counter({i: n for i, n in times.items() if n})


def covered(units, window):
    c = Counter(u[i : i + window] for u in units for i in range(len(u) - window + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            if c[u[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        out.append(gone)
    return out


@pytest.mark.parametrize("seed", [11, 12])
def test_repeated_bytes(spark, seed):
    texts = made_texts(seed, 30, 60) + ["ab" * 300, "q" * 500 + "ab" * 250]
    units = [(t or "").encode() for t in texts]
    got = {r.doc_id: r for r in suffix_arrays.without_repeated_bytes(docs(spark, texts), 60, 12).collect()}
    for i, (u, gone) in enumerate(zip(units, covered(units, 60))):
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(u), sum(gone), spans, bytes(x for x, g in zip(u, gone) if not g)), i
    assert suffix_arrays.without_repeated_bytes(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", [13, 14])
def test_repeated_words(spark, seed):
    texts = made_texts(seed, 30, 60)
    units = [tuple(words(t)) for t in texts]
    got = {r.doc_id: r for r in suffix_trees.without_repeated_words(docs(spark, texts), 12, 4).collect()}
    for i, (u, gone) in enumerate(zip(units, covered(units, 12))):
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(u), sum(gone), b" ".join(x for x, g in zip(u, gone) if not g).decode()), i
    assert suffix_trees.without_repeated_words(empty(spark)).count() == 0


@pytest.mark.parametrize("make", [lambda: suffix_arrays.byte_units(60, 12), lambda: suffix_trees.word_units(12, 4)])
def test_heavy_groups_split(spark, make):
    table = docs(spark, made_texts(15, 30, 40))
    spans = [{(r.k1, r.k2): [range(s.lo, s.hi + 1) for s in r.spans] for r in repeated(table, make(), group)[1].collect()} for group in (50_000, 2)]
    flat = [{k: sorted({i for r in v for i in r}) for k, v in s.items()} for s in spans]
    assert flat[0] == flat[1] and any(flat[0].values())


def test_suffix_tree_nodes():
    r = np.random.default_rng(9)
    m = r.integers(1, 3, (40, 8)).astype(np.uint64)
    order, common = suffix_trees.suffix_tree(m)
    assert [m[i].tolist() for i in order] == sorted(x.tolist() for x in m)
    for depth, leaves in suffix_trees.maximal_repeats(order, common, 3):
        assert len({tuple(m[i][:depth]) for i in leaves}) == 1 and len(leaves) == sum((m[:, :depth] == m[leaves[0]][:depth]).all(axis=1))


def test_quality(spark):
    r = random.Random(10)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [(None, None, "a"), (-1, "", "a")], []
    for i in range(900):
        w = [r.choice(plain) for _ in range(60)]
        bad = i % 6 == 0
        if bad:
            w[r.randrange(60)] = "awful"
            w[r.randrange(60)] = "awful"
        rows.append((i, " ".join(w), "a"))
        if i % 2 or i % 12 == 0:
            labels.append((i, 1, int(bad)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, _log_weight string").repartition(4)
    marks = spark.createDataFrame(labels + labels[:3] + [(5000, None, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = {x.doc_id: x.kept for x in quality.quality_scores(table, marks).collect()}
    held_out = [i for i in range(900) if not (i % 2 or i % 12 == 0)]
    assert all(got[i] == (i % 6 != 0) for i in held_out if got[i] is not None)
    kept = quality.resampled(table, marks)
    assert kept.columns == table.columns
    assert {x.doc_id for x in kept.collect()} == {i for i, k in got.items() if k}
    nothing = quality.quality_scores(table, marks.limit(0))
    assert nothing.where("kept").count() == len(rows)
    assert quality.quality_scores(table.limit(0), marks).count() == 0


def test_kth_largest(spark):
    r = random.Random(11)
    x = [r.choice([0.0, 0.5, r.random(), r.gauss(0, 100)]) for _ in range(500)]
    keys = spark.createDataFrame([(v,) for v in x], "key double")
    for k in (1, 2, 57, 250, 499):
        assert quality.kth_largest(keys, k, 8) == sorted(x, reverse=True)[k - 1]


def test_decontamination(spark):
    r = random.Random(12)
    items = [(i, " ".join(f"t{r.randrange(500)}" for _ in range(r.choice([3, 13, 30])))) for i in range(30)] + [(100, None), (101, "..."), (102, "t1 t2"), (3, "t7, T8! t9"), (None, "z1 z2 z3")]
    texts = made_texts(16, 20)
    for i, t in items[:30]:
        w = t.split()
        texts.append(" ".join([f"w{k}" for k in range(r.choice([0, 30, 400]))]) + " - " + ", ".join(w).upper())
        texts.append(" ".join(w[1:]))
    texts += ["T7. t8; t9 z1 z2 z3", "t1 t2", "xt1 t2"]
    cut = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower((t or "").encode()))
    windows = {}
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    table, bench = docs(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")
    for block in (1 << 20, 13 * 300):
        got = {x.doc_id: x for x in decontaminate.contamination(table, bench, block_bytes=block).collect()}
        clean = set()
        for i, t in enumerate(texts):
            w, hit, who = cut(t), set(), set()
            for n in {len(k) for k in windows}:
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in windows:
                        hit.update(range(k, k + n))
                        who |= windows[tuple(w[k : k + n])]
            names = sorted(str(x) for x in who if x is not None)
            bad = bool(hit) and 20 * len(hit) >= len(w)
            clean |= set() if bad else {i}
            x = got[i]
            assert (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) == (len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bad)
        kept = decontaminate.decontaminated(table, bench, block_bytes=block)
        assert kept.columns == table.columns and {x.doc_id for x in kept.collect()} == clean
    span = next(s for x in decontaminate.contamination_spans(table, bench).collect() if x.doc_id == len(texts) - 3 for s in x._spans if s.item_id == 3)
    assert texts[-3][span.start : span.stop] == "T7. t8; t9"
    assert decontaminate.contamination(empty(spark), bench).count() == 0 and not decontaminate.contamination(table, bench.limit(0)).where("contaminated").count()


def test_best_fit_decreasing():
    r = np.random.default_rng(13)
    for _ in range(100):
        sizes = r.integers(1, 65, r.integers(0, 50))
        left = []
        for n in sorted(sizes.tolist(), reverse=True):
            fit = [x for x in left if x >= n]
            left.remove(min(fit)) if fit else None
            left.append((min(fit) if fit else 64) - n)
        bins = packing.best_fit_decreasing(sizes, 64)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and sorted(64 - int(sizes[b].sum()) for b in bins) == sorted(left)


def test_packing_round_trip(spark, tmp_path):
    tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = made_texts(17, 25) + [" ", "a ", "  a  b ", "▁x▁"]
    packing.write_packed(docs(spark, texts), path, str(tmp_path / "out"), 32_000, row=128, buffer=700)
    parts = {}
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        ids = np.frombuffer(r.ids, "<u2")
        assert ids.size == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 128 and r.resets == r.cu_seqlens[:-1] and not ids[r.n_tokens :].any()
        for doc, start, lo, hi in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            parts.setdefault(doc, []).append((start, ids[lo:hi].tolist()))
    back = {d: [i for _, x in sorted(p) for i in x] for d, p in parts.items()}
    assert back == {i: library.encode(t) for i, t in enumerate(texts) if t}
    assert packing.packed_rows(empty(spark), path, 32_000).count() == 0


def test_frequent_pieces_are_asked_for_once(monkeypatch):
    """A full table does not make a task ask the library again for pieces in use; ids are the library's, chunk by chunk."""
    tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        content = f.read()
    r = random.Random(9)
    texts = [None, "", " ", "  ", "▁", "a ", " a", *("".join(r.choice([" ", " ", "▁", "a", "the", "é", "中", "\n", "<s>", "\0"]) for _ in range(r.randrange(40))) for _ in range(300))]
    texts = [*texts, *(f"often w{i}" for i in range(300))]
    want, whole, asked = {i: library.encode(t) for i, t in enumerate(texts) if t}, sentencepiece.SentencePieceProcessor.encode, []
    monkeypatch.setattr(packing, "CACHE", 40)
    monkeypatch.setattr(packing, "CHUNK", 100, raising=False)
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "encode", lambda self, x, *a, **k: asked.extend([x] if isinstance(x, str) else x) or whole(self, x, *a, **k))
    parts = {}
    for b in packing._pack(content, path, None, "<u2", 64, 5000, 0)(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})])):
        for x in b.to_pylist():
            ids = np.frombuffer(x["ids"], "<u2").tolist()
            for doc, start, lo, hi in zip(x["doc_ids"], x["starts"], x["cu_seqlens"], x["cu_seqlens"][1:]):
                parts.setdefault(doc, []).append((start, ids[lo:hi]))
    assert {d: [i for _, x in sorted(p) for i in x] for d, p in parts.items()} == want
    assert asked.count("often") == 1
