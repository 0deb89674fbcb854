"""Token counts against the library that defines them."""

import random

import pytest
import sentencepiece

from tableops.llm import pieces, tokens
from tableops.llm import queries as registered
from tableops.llm.base import table

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return pieces.Model.load(pieces.MODEL_FILE)


@pytest.fixture(scope="module")
def merges(model):
    return tokens.Merges(model)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)


def odd_texts(model):
    rng = random.Random(1)
    pool = [p for p, k in zip(model.pieces, model.kinds, strict=True) if k == 1]
    odd = "aaaabbcdeéß  \n\t▁日本語𝔘<s>0123　\x00﷐"
    out = ["".join(rng.choices(odd, k=rng.randint(0, 90))) for _ in range(800)]
    out += ["".join(rng.choices(odd.replace(" ", ""), k=rng.randint(0, 700))) for _ in range(60)]
    out += ["".join(rng.choices(pool, k=rng.randint(1, 40))).replace("▁", rng.choice([" ", ""])) for _ in range(900)]
    planes = [*range(0x20, 0xD800), *range(0xE000, 0x110000, 7)]
    out += ["".join(map(chr, rng.choices(planes, k=100))) for _ in range(100)]
    return [*out, "a" * 3000, " " * 1000, "ab" * 2000, "<s></s><unk><0x0A>", "the" * 3000, "語" * 900, "Abc9" * 900]


@pytest.mark.parametrize("abreast", [2, 64, 5000])
def test_random_texts(model, merges, library, monkeypatch, abreast):
    """Whichever sequences go side by side, are cut, or are joined from a queue."""
    monkeypatch.setattr(tokens, "_ABREAST", abreast)
    own = odd_texts(model)
    own = [t for t in own if abreast < 5000 or len(t) < 1000]
    assert tokens.Counter(merges)(own) == [len(x) for x in library.encode(own)]


def test_in_parts_and_forgetting(merges, library, monkeypatch):
    monkeypatch.setattr(tokens, "_AT_ONCE", 30)
    monkeypatch.setattr(tokens, "_KNOWN", 5)
    counter = tokens.Counter(merges)
    for own in (["some words to begin with", ""], ["others and some words"] * 2, ["x" * 200 + " words"] * 2):
        assert counter(own) == [len(x) for x in library.encode(own)]
    assert all(len(p) <= tokens._ABREAST for p in counter.known)


def test_ties_go_to_the_left():
    """Two pieces of one score: the leftmost is joined first."""
    spelled = ["<unk>", "a", "b", "c", "ab", "bc"]
    model = pieces.Model(tuple(spelled), (2, 1, 1, 1, 1, 1), (0.0, -9.0, -9.0, -9.0, -1.0, -1.0))
    got = tokens.merged(["abc", "bcab", "cb", ""], tokens.Merges(model)).tolist()
    assert got == [2, 2, 2, 0]
    with pytest.raises(ValueError, match="unused"):
        tokens.Merges(pieces.Model(("a",), (5,), (0.0,)))


def test_odd_rows(model, library, make_docs):
    rows = [(1, None), (1, None), (2, ""), (None, "x"), (3, "long " * 30_000), (4, "é" * 5000)]
    docs = make_docs(rows).withColumnsRenamed({"lang": "n_tokens", "source": "n_bytes"})
    got = tokens.count(docs, model, "doc_id", "n_tokens", limit=100)
    assert got.columns == ["doc_id", "n_tokens", "n_bytes", "n_tokens", "over_limit"]
    want = [
        (str(i), len((t or "").encode()), n := len(library.encode(t or "")), n > 100) for i, t in rows
    ]
    assert sorted((str(r[0]), *r[2:]) for r in got.collect()) == sorted(want)
    assert tokens.count(make_docs([]), model, "doc_id").collect() == []


def test_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in table(spark, SF_DIR, "documents").collect()}
    rows = registered.op12_token_counts(spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)
