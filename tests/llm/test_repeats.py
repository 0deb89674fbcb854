"""Repeated strings against a table of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tableops.llm import repeats
from tableops.llm.base import table

SMALL = repeats.Limits(length=24, gram=9, group=2000)


def plain(rows, length):
    bodies = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for (key, _), b in zip(rows, bodies, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((key, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def mixed_rows(seed, n=120, sep=" "):
    """Passages shared whole, in part, at either end, inside one text, and in periods."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 7)))
    passages = [sep.join(word() for _ in range(rng.randint(3, 20))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            kind, p = rng.random(), rng.choice(passages)
            a, b = sorted(rng.sample(range(len(p) + 1), 2))
            parts.append(p if kind < 0.3 else p[a:b] if kind < 0.6 else word() * rng.randint(1, 9))
        rows.append((i, sep.join(parts)))
    rows += [(500, None), (501, ""), (502, "x" * 300), (503, "ab" * 200 + "c"), (7, rows[7][1]), (None, rows[9][1]), (None, None)]
    return rows


@pytest.mark.parametrize("seed,group", [(1, 2000), (2, 2000), (3, 2), (4, 5)])
def test_small_windows(spark, make_docs, seed, group):
    rows = mixed_rows(seed)
    lim = repeats.Limits(24, 9, group)
    got = repeats.remove_repeats(make_docs(rows), "doc_id", limits=lim)
    assert result(got) == plain(rows, 24)


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(repeats.remove_repeats(docs, "doc_id")) == plain(rows, 200)


def test_empty_table_and_clashing_names(spark, make_docs):
    assert repeats.remove_repeats(make_docs([]), "doc_id").collect() == []
    rows = mixed_rows(9, 20)
    docs = make_docs(rows).withColumnsRenamed({"lang": "uid", "source": "body", "n_chars": "gram"})
    got = repeats.remove_repeats(docs, "doc_id", limits=SMALL)
    assert result(got) == plain(rows, 24)


def test_suffix_sort_orders_within_groups():
    rng = random.Random(4)
    data = np.frombuffer("".join(rng.choices("ab", k=3000)).encode(), np.uint8)
    h = repeats.PrefixHashes(data)
    starts = np.array([rng.randrange(2900) for _ in range(700)])
    groups = np.sort(np.array([rng.randrange(20) for _ in range(700)]))
    order = repeats.suffix_sort(data, h, starts, groups, 60)
    text = data.tobytes()
    got = [(groups[i], text[starts[i] : starts[i] + 60]) for i in order]
    assert got == sorted(got)
    a, b = starts[:300], starts[300:600]
    for x, y, n in zip(a, b, repeats.common_prefix(h, a, b, 60), strict=True):
        assert text[x : x + n] == text[y : y + n]
        assert n == 60 or text[x + n] != text[y + n]
