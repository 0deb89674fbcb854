"""Benchmark decontamination by SimHash windows.

A document is compared with a benchmark item in windows of the item's own length in
words. Every window that shares a shingle with the item gets a 64-bit SimHash; the
others have resemblance zero and are left out. A multi-index of the items'
fingerprints (eight blocks of eight bits: within ``RADIUS`` bits some block differs
by at most an eighth of them) gives all items within the radius, and their exact
resemblance, on the multisets of shingles, decides.

At a resemblance of 0.8 a fingerprint differs in 9 or 10 of 64 bits, give or take
3, so the radius of 22 leaves out none of such windows but about one in 100,000.

A benchmark of bounded size goes to the tasks, and texts are read once; a larger one stays a table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableops.llm.base import slices, staged, texts
from tableops.llm.simhash import _LOWER, distance

SHINGLE = 5
RADIUS = 22
#: Characters of benchmark up to which tasks hold all of it.
BLOCK_CHARS = 16 << 20

_BLOCKS = 8
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MATCH = pa.struct(
    [("item_id", pa.int64()), ("similarity", pa.float64()), ("start", pa.int64()), ("words", pa.int64())]
)
_MATCHES_DDL = "array<struct<item_id:long,similarity:double,start:long,words:long>>"


def words_of(text: str) -> list[bytes]:
    """White-space words with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array(list(map(xxhash.xxh3_64_intdigest, words)), dtype=np.uint64)


def shingles(hashed: np.ndarray, size: int) -> np.ndarray:
    """A mixed hash of each run of ``size`` words."""
    n = len(hashed) - size + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    z = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        z = z * _MULTIPLIER + hashed[i : i + n]
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(29))


def resemblance(a: list[bytes], b: list[bytes], size: int) -> float:
    """Shared over all shingles of two word lists, each as often as it occurs."""
    x, y = (Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) for w in (a, b))
    every = sum((x | y).values())
    return sum((x & y).values()) / every if every else 0.0


def sliding_resemblance(own: np.ndarray, starts: np.ndarray, n: int, item: np.ndarray) -> np.ndarray:
    """``resemblance`` of the ``n`` shingles from each of the rising ``starts`` on with those of an item.

    ``own`` and ``item`` are shingle hashes. The shared count follows the window from one start to
    the next, so a run of neighbouring windows costs its length, however long the item is.
    """
    values, wanted = np.unique(item, return_counts=True)
    low, high = int(starts[0]), int(starts[-1]) + n
    at = np.minimum(np.searchsorted(values, own[low:high]), len(values) - 1)
    ids = np.where(values[at] == own[low:high], at, -1).tolist()
    most, held, shared = wanted.tolist(), [0] * len(values), 0
    out, begin, end = [], 0, 0  # the window held is ids[begin:end]
    for start in (starts - low).tolist():
        if start >= end:  # apart from the window before
            for i in set(ids[begin:end]):
                held[i] = 0
            begin = end = start
            shared = 0
        for i in ids[end : start + n]:
            if i >= 0:
                held[i] += 1
                shared += held[i] <= most[i]
        end = start + n
        for i in ids[begin:start]:
            if i >= 0:
                shared -= held[i] <= most[i]
                held[i] -= 1
        begin = start
        out.append(shared)
    return np.array(out) / (n + len(item) - np.array(out))


def covered_starts(hits: np.ndarray, reach: int, last: int) -> np.ndarray:
    """Starts from 0 to ``last`` of windows that hold one of the ``hits`` among ``reach`` places."""
    edges = np.zeros(last + reach + 2, dtype=np.int64)
    np.add.at(edges, np.maximum(hits - reach + 1, 0), 1)
    np.add.at(edges, np.minimum(hits, last) + 1, -1)
    return np.flatnonzero(np.cumsum(edges[: last + 1]) > 0)


class HammingIndex:
    """Fingerprints by the values of their blocks, near values included.

    Fingerprints within ``radius`` bits differ by at most ``radius // 8`` bits in
    one of eight blocks, so looking a block's value up among all values that near
    misses none of them.
    """

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        values = np.arange(256, dtype=np.uint8)
        near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius // _BLOCKS
        blocks = prints.view(np.uint8).reshape(-1, _BLOCKS)
        self.table = [
            [np.flatnonzero(near[v][blocks[:, b]]) for v in range(256)] for b in range(_BLOCKS)
        ]

    def within(self, print_: np.uint64) -> np.ndarray:
        """Places of all fingerprints within the radius."""
        own = np.array([print_], dtype=np.uint64).view(np.uint8)
        found = np.unique(np.concatenate([self.table[b][own[b]] for b in range(_BLOCKS)]))
        return found[distance(self.prints[found][:, None], print_) <= self.radius]


def window_prints(h: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the ``n`` shingles from each start on."""
    low = int(starts.min())
    part = np.ascontiguousarray(h[low : int(starts.max()) + n])
    bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    upto = np.zeros((len(part) + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, out=upto[1:])
    counts = upto[starts - low + n] - upto[starts - low]
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view(np.uint64).ravel()


class Items:
    """A block of the benchmark: items by shingle, and an index for each length in words."""

    def __init__(self, items: tuple[tuple[int | None, str], ...]):
        self.items = [(i, w) for i, t in items if (w := words_of(t))]
        self.sizes = sorted({min(SHINGLE, len(w)) for _, w in self.items})
        self.known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.index: dict[int, tuple[np.ndarray, HammingIndex]] = {}
        by_length: dict[int, list[int]] = {}
        own = self.own = [shingles(word_hashes(w), min(SHINGLE, len(w))) for _, w in self.items]
        for k, (_, w) in enumerate(self.items):
            by_length.setdefault(len(w), []).append(k)
        for size in self.sizes:
            members = [k for k, (_, w) in enumerate(self.items) if min(SHINGLE, len(w)) == size]
            flat = np.concatenate([np.unique(own[k]) for k in members])
            who = np.repeat(members, [len(np.unique(own[k])) for k in members])
            order = np.argsort(flat, kind="stable")
            filled = np.zeros(1 << 16, dtype=bool)
            filled[(flat & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.known[size] = flat[order], who[order], filled
        for length, ks in by_length.items():
            prints = np.concatenate(
                [window_prints(own[k], np.zeros(1, np.int64), len(own[k])) for k in ks]
            )
            self.index[length] = np.array(ks), HammingIndex(prints, RADIUS)

    def found(self, text: str, least: float) -> list[tuple[int | None, float, int, int]]:
        """``(item, resemblance, first word, words)``: the best window for each item found."""
        words = words_of(text)
        hashed = word_hashes(words)
        best: dict[int, tuple[float, int, int]] = {}
        for size in self.sizes:
            flat, who, filled = self.known[size]
            h = shingles(hashed, size)
            maybe = np.flatnonzero(filled[(h & np.uint64(0xFFFF)).astype(np.int64)])
            low = np.searchsorted(flat, h[maybe], side="left")
            many = np.searchsorted(flat, h[maybe], side="right") - low
            at = np.repeat(maybe, many)
            if not len(at):
                continue
            item = who[np.repeat(low, many) + _spread(many)]
            for length in {len(self.items[k][1]) for k in np.unique(item).tolist()}:
                n = min(length, len(words))
                ks, index = self.index[length]
                hits = np.unique(at[np.isin(item, ks)])
                starts = covered_starts(hits, n - size + 1, len(words) - n)
                near: dict[int, list[int]] = {}
                prints = window_prints(h, starts, n - size + 1)
                for start, print_ in zip(starts.tolist(), prints, strict=True):
                    for k in ks[index.within(print_)].tolist():
                        near.setdefault(k, []).append(start)
                for k, some in near.items():
                    same = sliding_resemblance(h, np.array(some), n - size + 1, self.own[k])
                    first = int(same.argmax())
                    if same[first] >= least:
                        best[k] = float(same[first]), some[first], n
        return [(self.items[k][0], *best[k]) for k in sorted(best)]


def _spread(counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.arange(ends[-1]) - np.repeat(ends - counts, counts)


@lru_cache(maxsize=2)
def _items(items: tuple) -> Items:
    return Items(items)


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    *keep: str,
    least: float = 0.8,
    item_id: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """``keep`` columns of every row of ``docs`` and ``matches``, one entry per item found.

    An entry names the item, the exact resemblance of its best window, and where that
    window is. Null and empty texts and items match nothing; an item or a document
    of fewer than five words counts as one shingle.

    A benchmark of up to ``BLOCK_CHARS`` characters goes to the tasks as it is. A larger one
    is a table of shingles that documents are joined to; see ``_joined``.
    """
    plain, kept, fields = texts(docs, *keep, text=text)
    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    rows = rows.where(F.col("text").isNotNull())
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars > BLOCK_CHARS:
        return _joined(plain, kept, rows, least).toDF(*keep, "matches")
    block = tuple((r.item_id, r.text) for r in rows.collect())

    def finding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items(block)
        for batch in slices(batches):
            out = [
                [dict(zip(_MATCH.names, m, strict=True)) for m in items.found(t, least)]
                for t in batch["text"].to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch[k] for k in kept), pa.array(out, pa.list_(_MATCH))], [*kept, "matches"]
            )

    return plain.mapInArrow(finding, fields + f"matches {_MATCHES_DDL}").toDF(*keep, "matches")


def _counted(t: str, size: int) -> tuple[list[int], list[int]]:
    """Distinct shingles of a text and how often each occurs."""
    own, many = np.unique(shingles(word_hashes(words_of(t)), size), return_counts=True)
    return own.view(np.int64).tolist(), many.tolist()


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out: list[tuple] = []
        for key, t in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), strict=True):
            size = min(SHINGLE, len(words_of(t)))
            if size:
                own, many = _counted(t, size)
                out += [(key, size, h, n, sum(many)) for h, n in zip(own, many, strict=True)]
        names = ["key", "size", "shingle", "n", "total"]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], pa.int64()) for i in range(5)], names
        )


def _doc_shingles(sizes: list[int]):
    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts_, out = batch["text"].to_pylist(), []
            for digest, t in zip(batch["digest"].to_pylist(), texts_, strict=True):
                hashed = word_hashes(words_of(t))
                for size in sizes:
                    own = np.unique(shingles(hashed, size)).view(np.int64)
                    out.append((digest, size, own))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in out], pa.string()),
                    pa.array([r[1] for r in out], pa.int64()),
                    pa.array([r[2] for r in out], pa.list_(pa.int64())),
                ],
                ["digest", "size", "shingles"],
            )

    return cutting


def _joined(plain: DataFrame, kept: list[str], rows: DataFrame, least: float) -> DataFrame:
    """Matches with a benchmark of any size, which no task and not the driver holds.

    A window resembles an item of N shingles only if it has ``least`` N of them, so it has
    one of any more than the rest. Of each item so many are taken, those that fewest items have, and documents
    are joined to them: a shingle many items share, or a boilerplate one that many documents do, makes
    no pairs beyond those items that are little else. Each document found, known by a
    digest of its text, then meets the items it may hold, and windows are searched as ever.
    """
    items = staged(
        rows.select("text").distinct().select(F.monotonically_increasing_id().alias("key"), "text"),
        "benchmark-items",
    )
    own = staged(
        items.mapInArrow(_item_shingles, "key long, size long, shingle long, n long, total long"),
        "benchmark-shingles",
    )
    spread_ = own.groupBy("size", "shingle").agg(F.count(F.lit(1)).alias("items"))
    rarest = Window.partitionBy("key").orderBy("items", "shingle")
    enough = F.col("total") - F.ceil(F.lit(least) * F.col("total") - 1e-9)
    keys = staged(
        own.join(spread_, ["size", "shingle"])
        .withColumn("before", F.sum("n").over(rarest.rowsBetween(Window.unboundedPreceding, -1)))
        .where(F.coalesce("before", F.lit(0)) <= enough)
        .select("key", "size", "shingle"),
        "benchmark-keys",
    )
    sizes = sorted(r["size"] for r in keys.select("size").distinct().collect())  # five at most
    digested = plain.withColumn("digest", F.sha2("text", 256))
    cut = digested.select("digest", "text").mapInArrow(
        _doc_shingles(sizes), "digest string, size long, shingles array<long>"
    )
    pairs = staged(
        cut.select("digest", "size", F.explode("shingles").alias("shingle"))
        .join(keys, ["size", "shingle"])
        .select("digest", "key")
        .distinct(),
        "decontamination-pairs",
    )
    bodies = staged(
        digested.select("digest", "text")
        .join(pairs.select("digest").distinct(), "digest", "left_semi")
        .dropDuplicates(["digest"]),
        "decontamination-texts",
    )
    wanted = (
        pairs.join(items.withColumnRenamed("text", "item"), "key")
        .groupBy("digest")
        .agg(F.collect_list(F.struct("key", "item")).alias("items"))
    )

    def finding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for digest, t, some in zip(*(batch[c].to_pylist() for c in ("digest", "text", "items")), strict=True):
                found = Items(tuple((i["key"], i["item"]) for i in some)).found(t, least)
                out += [(digest, *m) for m in found]
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)],
                ["digest", "key", "similarity", "start", "words"],
            )

    fields = "digest string, key long, similarity double, start long, words long"
    named = rows.join(items, "text").select("key", "item_id")
    entry = F.struct("item_id", "similarity", "start", "words")
    found = staged(
        bodies.join(wanted, "digest").mapInArrow(finding, fields)
        .join(named, "key")
        .groupBy("digest")
        .agg(F.sort_array(F.collect_list(entry)).alias("matches")),
        "decontamination-matches",
    )
    none = F.array().cast(_MATCHES_DDL)
    return digested.select(*kept, "digest").join(found, "digest", "left").select(
        *kept, F.coalesce("matches", none).alias("matches")
    )
