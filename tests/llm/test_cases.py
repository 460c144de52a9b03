"""What the other tests leave open: families of near copies, columns with clashing names, ids of text, and texts above a megabyte."""

import hashlib
import itertools
import os
import random

import numpy as np
import pytest

from tidemark.llm import decontaminate, embeddings, jaccard, licenses, mixing, packing, quality, suffix_arrays, suffix_trees, token_counts

from .test_operators import DOCS, groups_of, shingles, words


def variants(seed, bases, each, length=60, edits=6):
    """Copies of some bases, which share a part, with up to so many changed words; from few words, so that changes meet too."""
    r = random.Random(seed)
    shared = [f"s{i}" for i in range(length // 2)]
    out = []
    for b in range(bases):
        base = [f"b{b}w{i}" for i in range(length)] + shared
        for _ in range(each):
            w = list(base)
            for _ in range(r.randrange(edits)):
                w[r.randrange(len(w))] = f"x{r.randrange(4)}"
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("direct", "levels"), [(1, 6), (2, 2)])
def test_families(spark, monkeypatch, direct, levels):
    """Large groups taken apart by differences link exactly as all pairs do, at any depth."""
    monkeypatch.setattr(jaccard, "DIRECT", direct)
    monkeypatch.setattr(jaccard, "LEVELS", levels)
    texts = variants(direct, 3, 25) + variants(9, 1, 20, 20, 3)
    sets = [shingles(t, 4) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(table).collect()}
    want = groups_of(len(texts), links)
    assert got == dict(enumerate(want)) and len(set(want)) > 5


CLASHING = ["place", "more", "last", "whole", "_n", "_key", "_shard", "_draw", "_order", "_block", "_o", "_row", "_also", "_n_words", "_spans", "n_words", "hits", "items", "_log_weight", "k1", "spans", "s", "n"]


def clashing(spark, n=60):
    r = random.Random(4)
    rows = [(f"d{i:03}", " ".join(f"w{r.randrange(30)}" for _ in range(r.randrange(1, 30))), f"s{i % 3}", *[f"{c}{i}" for c in CLASHING]) for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(["doc_id string", "text string", "source string", *[f"`{c}` string" for c in CLASHING]])).repartition(3)


def test_clashing_columns_and_text_ids(spark):
    table = clashing(spark)
    whole = {r.doc_id: r for r in table.collect()}
    bench = spark.createDataFrame([("q1", whole["d005"].text), ("q2", None)], "item_id string, text string")
    marks = spark.createDataFrame([(f"d{i:03}", i % 2, 0) for i in range(20)], "doc_id string, quality int, toxic int")
    for kept in (mixing.mixed(table), decontaminate.decontaminated(table, bench), quality.resampled(table, marks), jaccard.one_of_each(table)):
        rows = kept.collect()
        assert rows and kept.columns == table.columns and all(r == whole[r.doc_id] for r in rows)
    assert "d005" not in {r.doc_id for r in decontaminate.decontaminated(table, bench).collect()}
    found = next(r for r in decontaminate.contamination(table, bench).collect() if r.doc_id == "d005")
    assert found.contaminated and found.items_sha256 == hashlib.sha256(b"q1").hexdigest()
    assert {s.item_id for r in decontaminate.contamination_spans(table, bench).collect() for s in r._spans} == {"q1"}
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_groups(table).collect()}.keys() == whole.keys()
    for f in (suffix_arrays.without_repeated_bytes, suffix_trees.without_repeated_words, mixing.mix_plan, licenses.license_matches):
        assert {r.doc_id for r in f(table).collect()} == set(whole)
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("piece_bpe_32k.model")
    assert {d for r in packing.packed_rows(table, path, 32_000).collect() for d in r.doc_ids} == set(whole)
    assert {r.doc_id for r in token_counts.token_counts(table, path).collect()} == set(whole)


def test_embeddings_with_text_ids(spark):
    v = [[1.0, 0.0], [1.0, 0.01], [0.0, 1.0], [1.0, 0.0], None]
    table = spark.createDataFrame([(f"v{i}", x, 1) for i, x in enumerate(v)], "vec_id string, embedding array<double>, dim int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.embedding_groups(table, recall=0.999999).collect()}
    assert got == {"v0": (2, "v0", True), "v1": (2, "v0", False), "v2": (0, "v2", True), "v3": (2, "v0", False), "v4": (0, "v4", True)}


def test_texts_above_a_megabyte(spark):
    """Texts are cut into pieces of a megabyte inside the kernels; results are those of the whole text."""
    r = random.Random(6)
    long = " ".join(f"w{r.randrange(5000)}" for _ in range(230_000))
    notice, item = licenses.TEMPLATES["gpl-3.0-notice"], " ".join(f"b{i}" for i in range(20))
    other = long[:1_100_000] + f" {notice} {item} " + " ".join(f"z{i}" for i in range(300))
    texts = {0: long, 1: long, 2: other, 3: "a b c d e", 4: None}
    assert len(long) > 1 << 20
    table = spark.createDataFrame([(i, t, "s", *[""] * 4) for i, t in texts.items()], DOCS).repartition(2)
    sets = {i: shingles(t, 4) for i, t in texts.items()}
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_groups(table).collect()}
    near = 100 * len(sets[0] & sets[2]) >= 85 * len(sets[0] | sets[2])
    assert got == {0: (len(sets[0]), 0), 1: (len(sets[1]), 0), 2: (len(sets[2]), 0 if near else 2), 3: (2, 3), 4: (0, 4)}
    assert [m.license for x in licenses.license_matches(table).collect() if x.doc_id == 2 for m in x.matches] == ["gpl-3.0-notice"]
    cut = {x.doc_id: x for x in suffix_arrays.without_repeated_bytes(table).collect()}
    assert (cut[0].n_removed, cut[1].n_removed, cut[0].n_spans) == (len(long), len(long), 1)
    same = len(os.path.commonprefix([long, other]))
    assert cut[2].n_removed == same and bytes(cut[2].kept) == other[same:].encode()
    cut = {x.doc_id: x for x in suffix_trees.without_repeated_words(table).collect()}
    whole = len(os.path.commonprefix([long.split(), other.split()]))
    assert (cut[0].n_removed, cut[2].n_removed) == (230_000, whole) and cut[2].kept.split() == other.split()[whole:]
    bench = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    hit = {x.doc_id: (x.n_words, x.n_hit, x.contaminated) for x in decontaminate.contamination(table, bench).collect()}
    assert hit[2][1:] == (20, False) and hit[0] == (230_000, 0, False)
    marks = spark.createDataFrame([(0, 1, 0), (3, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.quality_scores(table, marks).count() == 5
    assert {x.doc_id: x.size for x in mixing.mix_plan(table).collect()} == {i: len(words(t)) for i, t in texts.items()}
    tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    n = {i: len(library.encode(t or "")) for i, t in texts.items()}
    assert {x.doc_id: x.n_tokens for x in token_counts.token_counts(table, path).collect()} == n
    held = {}
    for row in packing.packed_rows(table, path, 32_000).collect():
        for doc, lo, hi in zip(row.doc_ids, row.cu_seqlens, row.cu_seqlens[1:]):
            held[doc] = held.get(doc, 0) + hi - lo
            assert np.frombuffer(row.ids, "<u2").size == 2048
    assert held == {i: k for i, k in n.items() if k}


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    bench, marks = spark.createDataFrame([], "item_id bigint, text string"), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for out in (mixing.mixed(none), decontaminate.decontaminated(none, bench), quality.resampled(none, marks), jaccard.one_of_each(none)):
        assert out.columns == none.columns and out.count() == 0


def test_near_duplicates_of_clashing_ids(spark):
    """Rows that share a doc_id are judged each by its text: what is linked with nothing stays, of linked and of equal rows one does."""
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(30)) for k in "abcd")
    rows = [(1, a, "x"), (2, a + " more", "x"), (2, b, "x"), (3, c, "x"), (3, d, "x"), (3, d, "y"), (4, None, "x"), (4, "", "x"), (None, a, "x"), (5, b, "x"), (6, d.upper(), "x")]
    for n in (1, 4):
        table = spark.createDataFrame(rows, "doc_id bigint, text string, _set string").repartition(n)
        kept = jaccard.one_of_each(table)
        assert kept.columns == table.columns
        got = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
        assert got == sorted([(1, a), (2, b), (3, c), (3, d), (4, ""), (4, ""), (0, a)])
