"""SimHash near-duplicates, found with vantage-point partitions.

A text's fingerprint has a bit for each bit that most of its word shingles' hashes
have set. Texts with one fingerprint are one node; nodes within ``radius`` bits are
linked, and components of links are the classes.

Nodes meet in shards. Two fingerprints within the radius agree wholly on some of a
few disjoint bit segments (the triangle bound with distance zero), so a shard is
keyed by a choice of segments and their bits. A shard is then cut into rings around
a vantage point; a node whose distance to the inner edge of its ring is within the
radius also visits the next inner ring, which is where every partner it can have
there lies. Shards beyond a bound are dealt out by more segments. Inside a ring a vantage-point tree finds the pairs, leaving out
branches the triangle inequality rules out. What a task hands on is a spanning
forest of the links it found, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableops.llm.base import slices, staged, texts

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SEED = 42
#: Shingles whose bits are counted at once.
_BLOCK = 1 << 13
#: Pairs of fingerprints compared at once.
_LEAF = 1 << 16
_RING = 8
#: Nodes of a shard, which one task holds, at most.
_MOST = 1 << 17


@dataclass(frozen=True)
class Scheme:
    """How texts become fingerprints and which of them are linked.

    ``shingle`` words a shingle, ``bits`` a fingerprint, links at ``radius`` differing
    bits or fewer; ``segments`` disjoint bit segments, of which ``agreeing`` make a
    shard's key. Exact if ``segments - agreeing >= radius``.
    """

    shingle: int = 3
    bits: int = 64
    radius: int = 3
    segments: int = 4
    agreeing: int = 1

    @staticmethod
    def exact(nodes: int, shingle: int = 3, radius: int = 3) -> Scheme:
        """64 bits; more nodes get more segments, so that shards stay small."""
        agreeing = 1 if nodes < 1 << 22 else 2 if nodes < 1 << 30 else 3
        return Scheme(shingle, 64, radius, radius + agreeing, agreeing)


def _plain(text: str) -> bytes:
    """The words, A-Z in lower case, with a blank between."""
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_LOWER).split())


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words, A-Z in lower case, repeats included.

    Fewer words make one shingle of them all, no words none.
    """
    joined = _plain(text)
    words = joined.split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - size + 1)
    ends = ends[-n:].tolist()
    hashed = xxhash.xxh64_intdigest
    return np.array(
        [hashed(joined[a:b], _SEED) for a, b in zip(starts[:n].tolist(), ends, strict=True)],
        dtype=np.uint64,
    )


def _mixed(h: np.ndarray, words: int) -> np.ndarray:
    """``words`` 64-bit hashes from each hash; the first is the hash itself."""
    out = np.empty((len(h), words), dtype=np.uint64)
    out[:, 0] = h
    for j in range(1, words):
        z = h + np.uint64(j * 0x9E3779B97F4A7C15 % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, j] = z ^ (z >> np.uint64(31))
    return out


def fingerprint(text: str, scheme: Scheme) -> np.ndarray:
    """The fingerprint as 64-bit words; zero for a text without words."""
    h = shingle_hashes(text, scheme.shingle)
    words = scheme.bits // 64
    counts = np.zeros(scheme.bits, dtype=np.int64)
    for at in range(0, len(h), _BLOCK):
        mixed = _mixed(h[at : at + _BLOCK], words)
        bits = np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, scheme: Scheme, *keep: str) -> DataFrame:
    """``keep`` columns of every row and ``fingerprint`` (little-endian bytes).

    A null text counts as empty.
    """
    plain, kept, fields = texts(docs, *keep)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = [fingerprint(t, scheme).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch[k] for k in kept), pa.array(prints, pa.binary())], [*kept, "fingerprint"]
            )

    return plain.mapInArrow(marked, fields + "fingerprint binary").toDF(*keep, "fingerprint")


def _segment_bits(scheme: Scheme) -> list[slice]:
    edges = np.linspace(0, scheme.bits, scheme.segments + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def vantage(scheme: Scheme) -> np.ndarray:
    """A fixed point far from where fingerprints of few shingles cluster."""
    return np.random.default_rng(_SEED).integers(0, 1 << 64, scheme.bits // 64, dtype=np.uint64)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def _sharded(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """``(shard, fingerprint)``: each node in its ring of every shard and where it visits."""
    choices = list(combinations(_segment_bits(scheme), scheme.agreeing))
    width = _RING if scheme.radius < _RING else scheme.bits + 1  # wide radii cross any ring

    def sharding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        point = vantage(scheme)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                column = whole["fingerprint"].slice(at, 4096)
                prints = _as_words(column, scheme)
                bits = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little")
                away = distance(prints, point)
                ring, edge = away // width, away % width
                visits = np.flatnonzero((edge < scheme.radius) & (ring > 0))
                who = np.r_[np.arange(len(prints)), visits]
                rings = np.r_[ring, ring[visits] - 1].astype(np.uint64)
                for c, choice in enumerate(choices):
                    key = np.full(len(prints), c + 1, dtype=np.uint64)
                    for part in choice:
                        packed = np.packbits(bits[:, part], axis=1, bitorder="little")
                        for byte in packed.T:
                            key = (key ^ byte) * np.uint64(0x100000001B3)
                            key ^= key >> np.uint64(29)
                    shard = (key[who] ^ (rings + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.view(np.int64)), column.take(pa.array(who))],
                        ["shard", "fingerprint"],
                    )

    return nodes.mapInArrow(sharding, "shard long, fingerprint binary")


def _as_words(column: pa.Array, scheme: Scheme) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(
        -1, scheme.bits // 64
    )


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``n`` by the links ``a``-``b``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while not np.array_equal(new, again := new[new]):
            new = again
        if np.array_equal(new, root):
            return root
        root = new


class _Links:
    """Links between rows of one shard, kept as a forest."""

    def __init__(self, n: int):
        self.n, self.held, self.size = n, [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.held.append((a, b))
            self.size += len(a)
            if self.size > max(1 << 18, 4 * self.n):
                root = self.roots()
                child = np.flatnonzero(root != np.arange(self.n))
                self.held, self.size = [(child, root[child])], len(child)

    def roots(self) -> np.ndarray:
        if not self.held:
            return np.arange(self.n)
        return _forest(self.n, *(np.concatenate(x) for x in zip(*self.held, strict=True)))


def _between(prints, a, b, radius, links) -> None:
    """Links between rows ``a`` and rows ``b``, by a vantage point of ``a``.

    Those inside the median distance can only be near rows less than the radius
    beyond it, and the other way round.
    """
    if not len(a) or not len(b):
        return
    if len(a) * len(b) <= _LEAF or len(a) == 1:
        for part in np.array_split(b, max(1, len(a) * len(b) // _LEAF)):
            near = distance(prints[a][:, None], prints[part][None, :]) <= radius
            i, j = np.nonzero(near)
            links.add(a[i], part[j])
        return
    point = prints[a[len(a) // 2]]
    da, db = distance(prints[a], point), distance(prints[b], point)
    middle = int(np.median(da))
    inner, outer = a[da <= middle], a[da > middle]
    if not len(outer):  # all of a at one distance or nearer: split it by position
        half = len(a) // 2
        b = b[np.abs(db - middle) <= radius] if (da == middle).all() else b[db <= middle + radius]
        _between(prints, a[:half], b, radius, links)
        _between(prints, a[half:], b, radius, links)
        return
    _between(prints, inner, b[db <= middle + radius], radius, links)
    _between(prints, outer, b[db > middle - radius], radius, links)


def _within(prints: np.ndarray, rows: np.ndarray, radius: int, links: _Links) -> None:
    """Links among ``rows`` by a vantage-point tree."""
    if len(rows) ** 2 <= _LEAF:
        _between(prints, rows, rows, radius, links)
        return
    point = prints[rows[len(rows) // 2]]
    away = distance(prints[rows], point)
    middle = int(np.median(away))
    inner, outer = rows[away <= middle], rows[away > middle]
    if not len(outer):
        half = len(rows) // 2
        inner, outer = rows[:half], rows[half:]
        _between(prints, inner, outer, radius, links)
    else:
        _between(
            prints,
            rows[(away <= middle) & (away > middle - radius)],
            rows[(away > middle) & (away <= middle + radius)],
            radius,
            links,
        )
    _within(prints, inner, radius, links)
    _within(prints, outer, radius, links)


def _linked(shards: np.ndarray, prints: np.ndarray, radius: int) -> np.ndarray:
    """Roots over sorted rows: neighbours in small shards at once, large ones by a tree."""
    n = len(shards)
    links = _Links(n)
    first = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]])
    sizes = np.diff(np.r_[first, n])
    small = np.repeat(sizes <= 64, sizes)
    for k in range(1, int(min(64, sizes.max(initial=1)))):
        i = np.flatnonzero((shards[:-k] == shards[k:]) & small[:-k])
        for part in np.array_split(i, max(1, len(i) >> 16)):
            near = distance(prints[part], prints[part + k]) <= radius
            links.add(part[near], part[near] + k)
    for at, size in zip(first[sizes > 64], sizes[sizes > 64], strict=True):
        _within(prints, np.arange(at, at + size), radius, links)
    return links.roots()


def _bounded_shards(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """``_sharded``, but nodes of shards with more than ``_MOST`` rows are dealt out anew.

    Their new shards are keyed by nine of ``radius + 9`` segments, which a pair within the radius
    agrees on for some choice, too. What is left free there is ``radius`` segments, 16 bits of 64 for
    three: so a shard holds at most some 65,000 different fingerprints, however alike they are.
    """
    pairs = _sharded(nodes, scheme)
    many = pairs.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > _MOST)
    crowded = staged(many.select("shard"), "simhash-crowded")
    if crowded.isEmpty():
        return pairs
    again = staged(
        pairs.join(crowded, "shard", "left_semi").select("fingerprint").distinct(), "simhash-again"
    )
    fine = replace(scheme, segments=scheme.radius + 9, agreeing=9)
    return pairs.join(crowded, "shard", "left_anti").unionByName(_sharded(again, fine))


def links(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """``(a, b)``: a spanning forest, shard by shard, of the links between distinct nodes."""
    pairs = _bounded_shards(nodes, scheme)

    def linking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_shards, held_prints = np.zeros(0, np.int64), np.zeros((0, scheme.bits // 64), np.uint64)

        def made(shards, prints):
            root = _linked(shards, prints, scheme.radius)
            child = np.flatnonzero(root != np.arange(len(root)))
            child = child[(prints[child] != prints[root[child]]).any(axis=1)]
            size = scheme.bits // 8
            raw = np.ascontiguousarray(prints)
            a, b = (
                [raw[i].tobytes()[:size] for i in rows] for rows in (child, root[child])
            )
            return pa.RecordBatch.from_arrays(
                [pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"]
            )

        for batch in batches:
            shards = np.r_[held_shards, batch["shard"].to_numpy(False)]
            prints = np.concatenate([held_prints, _as_words(batch["fingerprint"], scheme)])
            whole = int(np.searchsorted(shards, shards[-1]))  # the last shard may go on
            if whole:
                yield made(shards[:whole], prints[:whole])
            held_shards, held_prints = shards[whole:], prints[whole:]
        if len(held_shards):
            yield made(held_shards, held_prints)

    edges = (
        pairs.repartition("shard")
        .sortWithinPartitions("shard", "fingerprint")  # so that roots of many shards are one node
        .mapInArrow(linking, "a binary, b binary")
        .distinct()
    )
    # a node has an edge for each of its shards at most; of these one stays, and the
    # roots the others name are linked among themselves
    lowest = edges.withColumn("low", F.min("b").over(Window.partitionBy("a")))
    return (
        lowest.select("a", F.col("low").alias("b"))
        .union(lowest.where("b != low").select(F.col("b"), F.col("low")))
        .distinct()
    )


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (a, b): the smallest node of its component.

    Each round takes the smallest root among neighbours and then the root's root, so
    the number of rounds follows the logarithm of the longest path. A round is staged.
    """
    both = staged(
        edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), f"{name}-edges"
    )
    roots = staged(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")),
        f"{name}-0",
    )
    turn = 0
    while True:
        turn += 1
        near = (
            both.join(roots, both.b == roots.node)
            .groupBy("a")
            .agg(F.min("root").alias("near"))
        )
        hopped = roots.join(near, roots.node == near.a).select(
            "node", F.col("root").alias("was"), F.least("root", "near").alias("root")
        )
        up = roots.select(F.col("node").alias("mid"), F.col("root").alias("top"))
        after = staged(
            hopped.join(up, hopped.root == up.mid).select(
                "node", "was", F.least("root", "top").alias("root")
            ),
            f"{name}-{turn}",
        )
        if after.where("was != root").isEmpty():
            return after.select("node", "root")
        roots = after.select("node", "root")


def groups(prints: DataFrame, scheme: Scheme | None = None, name: str = "simhash") -> DataFrame:
    """``(fingerprint, root, component)`` of every distinct fingerprint of ``prints``.

    ``root`` is the smallest fingerprint of its component, ``component`` the smallest
    ``doc_id`` there (null only if all are).
    """
    nodes = staged(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("head")), f"{name}-nodes")
    scheme = scheme or Scheme.exact(nodes.count())
    roots = components(links(nodes.select("fingerprint"), scheme), name)
    placed = nodes.join(roots, nodes.fingerprint == roots.node, "left").select(
        "fingerprint", "head", F.coalesce("root", "fingerprint").alias("root")
    )
    # staged, so that the join's other side can be split where a component is large
    heads = staged(placed.groupBy("root").agg(F.min("head").alias("component")), f"{name}-heads")
    return placed.join(heads, "root").select("fingerprint", "root", "component")


def near_duplicates(docs: DataFrame, scheme: Scheme | None = None) -> DataFrame:
    """``(doc_id, fingerprint, component)``, one row per row of ``docs``."""
    shape = scheme or Scheme()
    prints = staged(fingerprints(docs, shape, "doc_id"), "fingerprints")
    return prints.join(groups(prints, scheme), "fingerprint").select(
        "doc_id", "fingerprint", "component"
    )


def one_of_each(docs: DataFrame, scheme: Scheme | None = None) -> DataFrame:
    """The rows of ``docs`` less near-duplicates: of each component the smallest ``doc_id`` stays.

    Equal ids are decided by the text's hash; rows equal in both are one document.
    A null id gives way to any other. Without a scheme fingerprints of three-word shingles
    link at three bits, as in ``near_duplicates``.
    """
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    narrow = docs.select("doc_id", "text", hashed.alias("text_hash"))
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    prints = staged(fingerprints(narrow, scheme or Scheme(), "doc_id", "text_hash"), "fingerprints")
    first = prints.groupBy("fingerprint").agg(F.min(key).alias("key"))
    stay = staged(
        first.join(groups(prints, scheme), "fingerprint")
        .groupBy("root")
        .agg(F.min("key").alias("key"))
        .select(F.col("key.doc_id").alias("stay_id"), F.col("key.text_hash").alias("stay_hash")),
        "one-of-each",
    )
    whole = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), hashed.alias("own_hash")
    )
    kept = whole.join(
        stay, whole.own_id.eqNullSafe(stay.stay_id) & (whole.own_hash == stay.stay_hash), "left_semi"
    )
    return kept.dropDuplicates(["own_id", "own_hash"]).select("row.*")
