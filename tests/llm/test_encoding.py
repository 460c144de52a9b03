"""Encoding and decoding against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import encoding

public_tokenizers, sentencepiece = pytest.importorskip("public_tokenizers"), pytest.importorskip("sentencepiece")
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def words():
    with open(PATH, "rb") as f:
        return encoding.Vocabulary(f.read())


def made(words, seed, n):
    r, pieces = random.Random(seed), list(words.ids)
    letters = "  ▁aabcdeéßñ中文\n\t\0😀<s>unk/_-.,'\"AB0123​́"
    for _ in range(n):
        yield "".join(r.choice(letters) for _ in range(r.randrange(40)))
        yield "".join(r.choice(pieces) for _ in range(r.randrange(8)))
        yield "".join(r.choice("ab") for _ in range(r.randrange(30)))


def test_encoder(words, library):
    encoder = encoding.Encoder(words)
    for text in made(words, 1, 2000):
        assert np.frombuffer(encoder.encode(text), np.int32).tolist() == library.encode(text), text


def test_encoder_without_cuts(words, library):
    """The walk itself, over whole texts that are cut nowhere, and with every place tried again after steps back."""
    encoder = encoding.Encoder(words)
    ids = {i: piece for piece, i in words.ids.items()}
    for text in made(words, 2, 1000):
        text = "▁" + text.replace(" ", "▁")
        if all(c in words.ids for c in text):
            assert encoder.pieces(text) == [ids[i] for i in library.encode(text[1:])] or text == "▁"


def test_long_unit(words, library):
    encoder, r = encoding.Encoder(words), random.Random(3)
    for text in ("ab" * 50_000, "".join(r.choice("abcdefghij") for _ in range(100_000)), " " * 5000, "é" * 3000 + "\U0001f600" * 3000):
        assert np.frombuffer(encoder.encode(text), np.int32).tolist() == library.encode(text)
    assert len(encoder.known) == 0 or max(map(len, encoder.known)) <= encoding.SHORT


def test_memory_is_bounded(monkeypatch, words, library):
    monkeypatch.setattr(encoding, "REMEMBERED", 5)
    encoder = encoding.Encoder(words)
    for text in made(words, 4, 100):
        assert np.frombuffer(encoder.encode(text), np.int32).tolist() == library.encode(text)
        assert max(len(m) + len(m.old) for m in (encoder.known, encoder.parts, encoder.fits)) <= 5


def test_decoder(words, library):
    decoder, r = encoding.Decoder(words), random.Random(5)
    for text in made(words, 6, 500):
        ids = library.encode(text)
        assert decoder.decode(ids) == library.decode(ids) == text.replace("▁", " ")
    for _ in range(5000):  # any ids: broken bytes, control and unknown ids
        ids = [r.choice([r.randrange(32_000), r.randrange(3), r.randrange(3, 259)]) for _ in range(r.randrange(12))]
        assert decoder.decode(ids) == library.decode(ids), ids


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_query(spark, words, library, tmp_path):
    texts = [None, "", " ", "one", "one", "x" * 70_000, "a b " * 20_000, *made(words, 7, 30)]
    rows = [(i, t, "a", "b", [1]) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, decoded string, n_tokens string, ids array<int>").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in encoding.op11_encoding(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode(text or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))


def test_batches_and_clashing_names(spark, monkeypatch, library):
    docs = spark.createDataFrame([("k", "one two", "x"), ("k", None, "x"), (None, "three", "x")], "doc_id string, text string, ids string").coalesce(1)
    tokens = encoding.encoded(docs, PATH)
    assert [(r.doc_id, r.ids) for r in tokens.collect()] == [("k", library.encode("one two")), ("k", []), (None, library.encode("three"))]
    both = encoding.decoded(tokens.selectExpr("*", "'d' decoded", "nullif(1, 1) Decoded_"), PATH)
    assert both.columns[-1] == "decoded__" and [r[-1] for r in both.collect()] == ["one two", "", "three"]
    nulls = spark.createDataFrame([([5, 9],), (None,), ([],)], "ids array<int>")
    assert sorted(r.decoded for r in encoding.decoded(nulls, PATH).collect()) == ["", "", library.decode([5, 9])]
    assert encoding.decoded(encoding.encoded(docs.limit(0), PATH), PATH).count() == 0
