"""Encoding against the library that defines it, and round trips."""

import random

import numpy as np
import pytest
import sentencepiece

from tableops.llm import pieces
from tableops.llm.base import table

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return pieces.Model.load(pieces.MODEL_FILE)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)


def test_whole_table_and_round_trip(spark, model, library):
    docs = table(spark, SF_DIR, "documents")
    encoded = pieces.encode(docs, model, "doc_id", verify=True)
    assert encoded.where("round_trip").count() == docs.count()
    got = {r.doc_id: r.ids for r in encoded.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got == {i: library.encode(t) for i, t in texts.items()}
    decoded = {r.doc_id: r.text for r in pieces.decode(encoded, model, "doc_id").collect()}
    assert decoded == texts


def test_random_texts(model, library):
    rng = random.Random(1)
    pool = [p for p, k in zip(model.pieces, model.kinds, strict=True) if k == 1]
    odd = "aaaabbcdeéß  \n\t▁日本語𝔘<s>0123　\x00"
    texts = ["".join(rng.choices(odd, k=rng.randint(0, 80))) for _ in range(1500)]
    texts += ["".join(rng.choices(pool, k=rng.randint(1, 12))).replace("▁", " ") for _ in range(2500)]
    texts += ["a" * 300, " " * 100, "ab" * 200, "<s></s><unk><0x0A>", "the" * 2000, "語" * 500]
    vocabulary = pieces.Vocabulary(model)
    got = [np.frombuffer(x, np.int32).tolist() for x in pieces.Encoder(vocabulary)(texts)]
    want = library.encode(texts)
    assert got == want
    assert [vocabulary.decode(x) for x in want] == library.decode(want)


def test_every_character(model, library):
    """Noncharacters, all planes, and more characters in one index than 16 bits can number."""
    encoder = pieces.Encoder(pieces.Vocabulary(model))
    rng = random.Random(4)
    planes = [*range(0x20, 0xD800), *range(0xE000, 0x110000)]
    texts = ["a\ufdd0", "\ufdd0", "x \ufdd0\ufffe y\ufdd0", "\U0010ffff b"]
    texts += ["".join(map(chr, rng.choices(planes, k=60))) for _ in range(300)]
    texts.append(" ".join(map(chr, range(0x10000, 0x10000 + 90_000))) + " the same words the")
    for batch in (texts, texts[:4], texts[-1:]):
        got = [np.frombuffer(x, np.int32).tolist() for x in encoder(batch)]
        assert got == library.encode(batch)
        encoder.known.clear()


def test_indexing_in_parts_and_forgetting(model, library, monkeypatch):
    monkeypatch.setattr(pieces, "_INDEXED", 30)
    monkeypatch.setattr(pieces, "_KNOWN", 5)
    encoder = pieces.Encoder(pieces.Vocabulary(model))
    for text in ("some words to begin with", "others and some words", "some words to begin with"):
        assert np.frombuffer(encoder([text])[0], np.int32).tolist() == library.encode(text)


def test_words_are_encoded_once(model, library, monkeypatch):
    """Whatever signs stand beside them, and however many others come between."""
    made = []
    encoded = pieces.encode_chunks
    monkeypatch.setattr(pieces, "encode_chunks", lambda new, v: made.extend(new) or encoded(new, v))
    monkeypatch.setattr(pieces, "_KNOWN", 20)
    encoder = pieces.Encoder(pieces.Vocabulary(model))
    rng = random.Random(2)
    for i in range(30):
        seldom = ["".join(rng.choices("abcdefgh", k=9)) for _ in range(9)]
        text = " ".join(["often" + rng.choice([".", ",\n", ")", "!?"]) + "Often", *seldom])
        assert np.frombuffer(encoder([text])[0], np.int32).tolist() == library.encode(text)
    assert sum("often" in c for c in made) == sum("Often" in c for c in made) == 1
    assert len(encoder.known) + len(encoder.older) < 100


def test_borders_that_share_a_place(model, monkeypatch):
    """A table of few places gives what no table gives."""
    monkeypatch.setattr(pieces, "_BORDERS", 3)
    vocabulary = pieces.Vocabulary(model)
    rng = np.random.default_rng(6)
    for _ in range(20):
        a, b = vocabulary.ids[rng.integers(0, len(vocabulary.ids), (2, 500)) % 40]
        assert (vocabulary.borders(a, b) == vocabulary.border(a, b)).all()


def test_odd_rows(spark, model, make_docs):
    rows = [(1, None), (1, None), (2, ""), (None, "x"), (3, "long " * 30_000)]
    docs = make_docs(rows).withColumnsRenamed({"lang": "ids", "source": "pieces"})
    got = pieces.encode(docs, model, "doc_id", "text", "ids")
    assert got.columns == ["doc_id", "text", "ids", "ids"] and got.count() == 5
    plain = pieces.encode(docs, model, "doc_id")
    back = pieces.decode(plain, model, "doc_id").collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t in rows)
    assert pieces.encode(make_docs([]), model, "doc_id").collect() == []
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert pieces.decode(nothing, model, "doc_id").first().text == ""
