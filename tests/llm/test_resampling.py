"""Buckets, weights and draws against a plain version."""

import math
import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from tableops.llm import queries as registered
from tableops.llm import resampling
from tableops.llm.base import table
from tests.oracle import connect, differences

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def buckets(text, settings):
    words = WORD.findall((text or "").translate(LOWER))
    runs = [
        " ".join(words[i : i + n])
        for n in range(settings.shortest, settings.longest + 1)
        for i in range(len(words) - n + 1)
    ]
    return [crc32(r.encode()) % settings.buckets for r in runs], len(words)


def plain(rows, target, settings):
    """``[(id, n_features, weight, score)]`` and the (id, score) of the drawn in order."""
    found = [(i, *buckets(t, settings)) for i, t in rows]
    s, t = Counter(b for _, bs, _ in found for b in bs), Counter(b for x in target for b in buckets(x, settings)[0])
    n, total_s, total_t = settings.buckets, sum(s.values()), sum(t.values())
    gain = {
        b: math.floor(1000 * math.log((t[b] + 1) * (total_s + n) / ((s[b] + 1) * (total_t + n)))) for b in s
    }
    out, chosen = [], []
    for i, bs, words in found:
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        h = int(sha256(f"{settings.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(bs), weight, score))
        if words >= settings.min_words:
            chosen.append((-score, i is None, i or 0))
    drawn = sorted(chosen)[: settings.percent * len(chosen) // 100]
    return out, [(None if null else i, -score) for score, null, i in drawn]


def check(got, rows, target, settings):
    want, drawn = plain(rows, target, settings)
    key = str
    assert sorted(((r[0], r.n_features, r.weight, r.score) for r in got), key=key) == sorted(want, key=key)
    ranked = sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r[0], r.score) for r in ranked] == drawn


def test_prefix_cancellation():
    rng = random.Random(5)
    settings = resampling.Settings(1, 4, 1 << 32)
    pool = ["A", "Zz", "é", "語𝔘", "x1", " ", "-", "\x00", "word" * 60, "K", "ſ", "_"]
    texts = ["".join(rng.choices(pool, k=rng.randrange(40))) for _ in range(300)]
    texts += ["", "w " * 70_000, "y" * 200_000 + " z"]
    flat, n, words = resampling.buckets_of(texts, settings)
    want = [buckets(t, settings) for t in texts]
    assert n.tolist() == [len(b) for b, _ in want] and words.tolist() == [w for _, w in want]
    assert flat.tolist() == [b for bs, _ in want for b in bs]
    assert resampling.shifted(np.array([crc32(b"ab")], np.uint32), np.array([1 << 20]))[0] ^ crc32(
        bytes(1 << 20)
    ) == crc32(b"ab" + bytes(1 << 20))


@pytest.mark.parametrize("settings", [resampling.Settings(), resampling.Settings(1, 2, 70_000, 35, 3, 7)])
def test_random_documents(spark, make_docs, settings):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(400)]
    target = [" ".join(rng.choices(words[:40], k=200)) for _ in range(5)] + [None, ""]
    docs = make_docs(rows)
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(docs, wanted, "doc_id", settings=settings).collect()
    check(got, rows, target, settings)


def test_odd_rows_and_one_score(spark, make_docs):
    """Nulls, repeated rows, and a third of the rows with one id, text and score."""
    body = " ".join(f"word{i}" for i in range(30))
    rows = [(1, None), (2, ""), (2, ""), (3, "few words"), (4, "long " * 60_000)]
    rows += [(None, body)] * 70 + [(i, body + f" {i}") for i in range(10, 150)] + [(10, body + " 10")] * 3
    docs = make_docs(rows).withColumnsRenamed({"lang": "rank", "source": "row", "n_chars": "buckets"})
    settings = resampling.Settings(percent=60)
    nothing = spark.createDataFrame([], "item_id long, text string")
    made = resampling.resample(docs, nothing, "doc_id", "rank", "row", "buckets", settings=settings)
    assert made.columns == ["doc_id", "rank", "row", "buckets", "n_features", "weight", "score", "rank"]
    got = resampling.resample(docs, nothing, "doc_id", settings=settings)
    check(got.collect(), rows, [], settings)
    again = resampling.resample(docs.repartition(5), nothing, "doc_id", settings=settings)
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))
    assert resampling.resample(make_docs([]), nothing, "doc_id").collect() == []
    none = resampling.resample(docs, nothing, "doc_id", settings=resampling.Settings(percent=0))
    assert none.where("rank IS NOT NULL").isEmpty() and none.count() == len(rows)


def test_query(spark):
    rows = [tuple(r) for r in table(spark, SF_DIR, "documents").select("doc_id", "text").collect()]
    target = [r.text for r in table(spark, SF_DIR, "benchmark").collect()]
    check(registered.op11_resampling(spark, SF_DIR).collect(), rows, target, resampling.Settings())
    bad, n = differences(
        spark, connect(SF_DIR), "op11_resampling", registered.op11_resampling,
        registered.ORACLE["op11_resampling"], SF_DIR,
    )
    assert not bad and n == len(rows)
