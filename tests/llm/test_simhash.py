"""Fingerprints and components against a plain version of the definition."""

import random

import numpy as np
import pytest
import xxhash

from tableops.llm import simhash
from tableops.llm.base import table
from tableops.llm.queries import op6_simhash

SF_DIR = "/root/testdata/sf0.001"
WHITE = "\t\n\v\f\r "


def plain_print(text, n=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in WHITE:
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, radius=3):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    members = {}
    for i in range(len(ids)):
        members.setdefault(root(i), []).append(ids[i])
    least = {r: min((x for x in m if x is not None), default=None) for r, m in members.items()}
    return [least[root(i)] for i in range(len(ids))]


def test_whole_table(spark):
    docs = table(spark, SF_DIR, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [plain_print(t) for _, t in rows]
    want = dict(zip([i for i, _ in rows], zip(prints, plain_components([i for i, _ in rows], prints), strict=True), strict=True))
    got = {
        r.doc_id: (int.from_bytes(r.fingerprint, "little"), r.component)
        for r in simhash.near_duplicates(docs).collect()
    }
    assert got == want


def test_registered_query(spark):
    """Fingerprints in hex; bytes of C2 and above begin a character in UTF-8 and must not move others."""
    rows = [(r.doc_id, r.text) for r in table(spark, SF_DIR, "documents").collect()]
    ids, prints = [i for i, _ in rows], [plain_print(t) for _, t in rows]
    assert any(p >> 8 * b & 0xFF >= 0xC2 for p in prints for b in range(8))
    hexed = [f"{p:016x}" for p in prints]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op6_simhash(spark, SF_DIR).collect()}
    assert got == dict(zip(ids, zip(hexed, plain_components(ids, prints), strict=True), strict=True))


def test_odd_rows(spark, make_docs):
    rows = [(5, None), (3, ""), (4, " \n\t"), (9, "Two Words"), (2, "two\x0bwords"), (2, "two words")]
    rows += [(None, "another text of some words here"), (8, "x" * 100_000 + " y z")]
    got = simhash.near_duplicates(make_docs(rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].component for i in (3, 4, 5)] == [3, 3, 3]
    assert set(by_id[3].fingerprint) == {0}
    assert by_id[9].component == by_id[2].component == 2
    assert by_id[None].component is None
    assert simhash.near_duplicates(make_docs([])).collect() == []


@pytest.mark.parametrize("scheme", [simhash.Scheme(), simhash.Scheme(3, 64, 3, 5, 2), simhash.Scheme(3, 64, 3, 6, 3)])
def test_links_are_complete(spark, scheme):
    """Chains and clusters around random points; also many nodes in one shard."""
    rng = random.Random(1)
    prints = set()
    for _ in range(40):
        p = rng.getrandbits(64)
        for _ in range(30):
            p ^= sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4])))
            prints.add(p)
    low = rng.getrandbits(16)
    prints |= {rng.getrandbits(48) << 16 | low for _ in range(700)}
    near = rng.getrandbits(64)
    prints |= {near ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}
    ids = sorted(prints)
    nodes = spark.createDataFrame([(p.to_bytes(8, "little"),) for p in ids], "fingerprint binary")
    edges = simhash.links(nodes, scheme)
    pairs = [(int.from_bytes(r.a, "little"), int.from_bytes(r.b, "little")) for r in edges.collect()]
    assert all((a ^ b).bit_count() <= 3 * len(ids) for a, b in pairs)
    at = {p: i for i, p in enumerate(ids)}
    a, b = (np.array([at[x[k]] for x in pairs]) for k in (0, 1))
    got = simhash._forest(len(ids), a, b).tolist()
    assert got == [at[c] for c in plain_components(ids, ids)]


@pytest.mark.parametrize("most", [20, 400])
def test_crowded_shards_are_dealt_out_anew(spark, monkeypatch, most):
    """A third of all nodes agree on a segment, and a tight cluster on nearly all bits."""
    monkeypatch.setattr(simhash, "_MOST", most)
    rng = random.Random(8)
    low, near = rng.getrandbits(16), rng.getrandbits(64)
    prints = {rng.getrandbits(48) << 16 | low for _ in range(500)}
    prints |= {near ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(a)}
    for p in rng.sample(sorted(prints), 200):
        prints.add(p ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4]))))
    prints |= {rng.getrandbits(64) for _ in range(300)}
    ids = sorted(prints)
    nodes = spark.createDataFrame([(p.to_bytes(8, "little"),) for p in ids], "fingerprint binary")
    pairs = simhash.links(nodes, simhash.Scheme()).collect()
    at = {p.to_bytes(8, "little"): i for i, p in enumerate(ids)}
    a, b = (np.array([at[bytes(x[k])] for x in pairs]) for k in (0, 1))
    got = simhash._forest(len(ids), a, b).tolist()
    assert got == [ids.index(c) for c in plain_components(ids, ids)]
    sizes = simhash._bounded_shards(nodes, simhash.Scheme()).groupBy("shard").count()
    assert sizes.agg({"count": "max"}).first()[0] < 500


def test_components_follow_long_chains(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000)]
    edges = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


def test_one_of_each(spark, make_docs):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(4000)]
    long = [rng.choice(words) for _ in range(400)]
    near = list(long)
    near[200] = "changed"
    other = [rng.choice(words) for _ in range(400)]
    rows = [(7, " ".join(long)), (4, " ".join(near)), (5, " ".join(other)), (5, " ".join(other)), (None, " ".join(long)), (1, None), (2, "")]
    docs = make_docs(rows).withColumnsRenamed({"n_chars": "text_hash", "source": "fingerprint"})
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 4, 5]
