"""Profiles and distances against a plain version, and accuracy on held-out documents."""

import random
from collections import Counter

import pytest

from tableops.llm import langid, queries
from tableops.llm.base import table

SF_DIR = "/root/testdata/sf0.01"


def grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    for w in words:
        padded = f" {w} "
        yield from w
        yield from (padded[i : i + 2] for i in range(len(padded) - 1))
        yield from (padded[i : i + 3] for i in range(len(padded) - 2))


def code(gram):
    points = [1 if c == " " else ord(c) for c in gram]
    out = 0
    for p in points:
        out = out * (1 << 21) + p
    return out


def plain_train(rows, size):
    counts = {}
    for text, lang in rows:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(map(code, grams(text)))
    return {
        lang: {g: r for r, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:size])}
        for lang, c in counts.items()
        if c
    }


def plain_predict(text, profiles, size):
    counts = Counter(map(code, grams(text or "")))
    if not counts or not profiles:
        return "und", 0.0
    own = sorted(counts.items(), key=lambda x: (-x[1], order(x[0])))[:size]
    dist = {}
    for lang, ranks in profiles.items():
        off = [min(abs(ranks[g] - r), size) if g in ranks else size for r, (g, _) in enumerate(own)]
        dist[lang] = sum(off) / len(own) / size
    best = min(sorted(dist), key=dist.get)
    others = sorted(dist.values())
    score = 1 - others[0] / others[1] if len(others) > 1 else 1 - others[0]
    return best, score


def order(gram):
    return gram


@pytest.mark.parametrize("size", [15, 400])
def test_against_plain_version(spark, make_docs, size):
    rng = random.Random(size)
    words = {"aa": ["the", "and", "Thing", "with"], "bb": ["das", "und", "Öl", "ß"], "cc": ["le", "été", "qu'il"]}
    rows = []
    for i in range(90):
        lang = rng.choice(list(words))
        text = " ".join(rng.choices(words[lang] + ["x1y", "--"], k=rng.randint(1, 30)))
        rows.append((i, text, lang if i % 7 else None, "s"))
    rows += [(200, None, "aa", "s"), (201, "", "aa", "s"), (202, "12 34 !", None, "s"), (5, rows[5][1], rows[5][2], "s")]
    docs = make_docs(rows).withColumnsRenamed({"source": "gram", "n_chars": "score"})
    profiles = langid.train(docs, size)
    want = plain_train([(t, lang) for _, t, lang, _ in rows], size)
    got = {
        lang: {int(g): int(r[j]) for g, r in zip(profiles.grams, profiles.ranks, strict=True) if r[j] >= 0}
        for j, lang in enumerate(profiles.langs)
    }
    assert got == want
    found = langid.identify(docs, profiles, "doc_id", "text").collect()
    assert len(found) == len(rows)
    for doc, text, lang, score in found:
        name, expected = plain_predict(text, want, size)
        assert (lang, score) == (name, pytest.approx(expected, abs=1e-12)), doc


def test_nothing_to_learn_from_and_empty_tables(spark, make_docs):
    docs = make_docs([(1, "some words", None, None), (2, None, "en", None)])
    profiles = langid.train(docs)
    assert profiles.langs == ()
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, profiles, "doc_id").collect()} == {("und", 0.0)}
    one = langid.train(make_docs([(1, "only one language", "en", None)]))
    assert langid.identify(docs, one, "doc_id").where("doc_id = 1").first().lang_pred == "en"
    assert langid.identify(make_docs([]), one, "doc_id").collect() == []


def test_a_text_does_not_depend_on_its_neighbours(make_docs):
    profiles = langid.train(make_docs([(1, "the and of it", "en", None), (2, "der die das und", "de", None)]))
    texts = ["the end", "und so", "", "!?", "of x", "x"]
    together = langid.distances(texts, profiles)[0]
    for i, t in enumerate(texts):
        assert langid.distances([t], profiles)[0].tolist() == [together[i].tolist()]


def test_held_out_accuracy(spark):
    found = queries.op9_language_id(spark, SF_DIR)
    docs = table(spark, SF_DIR, "documents").select("doc_id", "lang")
    right, n = (
        found.where("held_out").join(docs, "doc_id").selectExpr("avg(int(lang = lang_pred))", "count(*)").first()
    )
    assert n > 250 and right > 0.99
