"""Benchmark items in documents, against a search of every window."""

import random
from collections import Counter

import numpy as np
import pytest

from tableops.llm import decontam
from tableops.llm.base import table

SF_DIR = "/root/testdata/sf0.001"


def plain(text, items, least=0.8):
    words = decontam.words_of(text or "")
    out = {}
    for item, other in items:
        want = decontam.words_of(other or "")
        n, size = min(len(want), len(words)), min(5, len(want))
        if not n:
            continue
        known = {tuple(want[i : i + size]) for i in range(len(want) - size + 1)}
        if not any(tuple(words[i : i + size]) in known for i in range(len(words) - size + 1)):
            continue
        best = max(
            decontam.resemblance(words[s : s + n], want, size) for s in range(len(words) - n + 1)
        )
        if best >= least:
            out[item] = best
    return out


def found(df):
    return {r.doc_id: {m.item_id: m.similarity for m in r.matches} for r in df.collect()}


def test_whole_table(spark):
    docs, bench = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "benchmark")
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    want = {r.doc_id: plain(r.text, items) for r in docs.collect()}
    assert found(decontam.matches(docs, bench, "doc_id")) == want
    assert any(want.values())


def test_changed_passages_and_odd_rows(spark, make_docs):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(20, 60)))) for i in range(30)]
    items += [(90, "only three words"), (91, ""), (92, None), (93, items[0][1])]
    rows = [(0, None), (1, ""), (2, "Only  THREE\nwords here"), (2, "Only  THREE\nwords here")]
    for i in range(60):
        words = items[i % 30][1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            at = rng.randrange(len(words))
            words[at : at + rng.choice([0, 1])] = ["other"]
        text = rng.choices(vocabulary, k=50) + words + rng.choices(vocabulary, k=50)
        rows.append((100 + i, " ".join(text).upper()))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.matches(make_docs(rows), bench, "doc_id")
    assert found(got) == {i: plain(t, items) for i, t in rows}
    assert got.count() == len(rows)
    assert found(got)[2] == {90: 1.0}
    assert set(found(got)[100]) >= {0, 93} or set(found(got)[100]) == set()


@pytest.mark.parametrize("chars", [0, 1 << 20])
def test_a_benchmark_in_a_table_makes_no_difference(spark, make_docs, monkeypatch, chars):
    """Nulls, copies of items and documents, a passage all items share, one word, changed passages."""
    monkeypatch.setattr(decontam, "BLOCK_CHARS", chars)
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(2000)]
    common = " ".join(rng.choices(vocabulary, k=12))
    items = [(i, common + " " + " ".join(rng.choices(vocabulary, k=rng.randint(20, 50)))) for i in range(25)]
    items += [(60, items[3][1]), (61, None), (62, ""), (63, "lonely"), (64, common), (65, "two words"), (None, "no id here at all")]
    rows = [(i, common + " " + " ".join(rng.choices(vocabulary, k=30))) for i in range(40)]
    for i in range(50):
        words = items[i % 25][1].split()
        for _ in range(rng.choice([0, 1, 2, 3])):
            at = rng.randrange(len(words))
            words[at : at + rng.choice([0, 1])] = ["other"]
        rows.append((100 + i, " ".join(rng.choices(vocabulary, k=20) + words + rng.choices(vocabulary, k=20))))
    rows += [(200, None), (201, ""), (202, "a lonely one"), (203, rows[50][1]), (None, rows[50][1]), (204, "Two  words")]
    rows += [(205, "it has no id here at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = make_docs(rows).withColumnsRenamed({"lang": "digest", "source": "key"})
    got = decontam.matches(docs, bench, "doc_id", "digest")
    assert got.columns == ["doc_id", "digest", "matches"] and got.count() == len(rows)
    assert found(got) == {i: plain(t, items) for i, t in rows}
    one = got.where("doc_id = 203").first().matches
    for m in one:
        words = decontam.words_of(rows[50][1])[m.start : m.start + m.words]
        item = decontam.words_of(dict(items)[m.item_id])
        assert m.similarity == decontam.resemblance(words, item, min(5, len(item)))
    empty = decontam.matches(make_docs([]), bench, "doc_id")
    assert empty.collect() == []


def test_long_items_with_few_words():
    """Hits at almost every place: memory and time follow the lengths, not their product."""
    rng = random.Random(1)
    for n in (2, 50):
        words = [f"w{i}" for i in range(n)]
        item, text = (" ".join(rng.choices(words, k=k)) for k in (3000, 20_000))
        (hit,) = decontam.Items(((1, item),)).found(text, 0.0) or [None]
        if hit:
            window = text.split()[hit[2] : hit[2] + hit[3]]
            same = decontam.resemblance([w.encode() for w in window], [w.encode() for w in item.split()], 5)
            assert hit[1] == same


def test_sliding_windows():
    rng = random.Random(1)
    for _ in range(300):
        own = np.array([rng.randrange(6) for _ in range(rng.randint(10, 60))], dtype=np.uint64)
        n = rng.randint(1, 8)
        item = np.array([rng.randrange(7) for _ in range(rng.randint(n, 10))], dtype=np.uint64)
        last = len(own) - n
        starts = np.array(sorted(rng.sample(range(last + 1), rng.randint(1, last + 1))))
        want = []
        for s in starts:
            a, b = Counter(own[s : s + n].tolist()), Counter(item.tolist())
            want.append(sum((a & b).values()) / sum((a | b).values()))
        assert decontam.sliding_resemblance(own, starts, n, item).tolist() == want
        hits = np.unique([rng.randrange(len(own)) for _ in range(3)])
        within = sorted({s for s in range(last + 1) for h in hits if s <= h < s + n})
        assert decontam.covered_starts(hits, n, last).tolist() == within


def test_empty_tables(spark, make_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert found(decontam.matches(make_docs([(1, "a b c d e f")]), bench, "doc_id")) == {1: {}}
    assert decontam.matches(make_docs([]), bench, "doc_id").collect() == []
