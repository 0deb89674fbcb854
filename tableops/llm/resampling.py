"""Importance resampling towards a target's n-gram distribution.

Features are runs of words, counted in buckets of their CRC-32. A document, its words
in lower case with one space before each, is scanned once and the running CRC is kept
where words start and end. The CRC of any run of words follows from two of these: a
CRC is linear over GF(2), so the prefix, shifted past the run's bytes, cancels out of
the CRC at the run's end, whatever the length of the run. No run is read again.

The buckets are staged. Counts of all documents and of the target give each bucket a
gain, a document weighs the mean gain of its features, and noise drawn from its id (Gumbel, in
thousandths) turns taking the highest scores into drawing without replacement by weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tableops.llm.base import slices, spread, staged, texts

#: A-Z to a-z, and every ASCII byte that is neither letter nor digit to a space.
_NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 32
    for b in range(256)
)
_POLYNOMIAL = 0xEDB88320
#: Rows of a task that Spark numbers below this, and its number above.
_ROWS = 1 << 33


@dataclass(frozen=True)
class Settings:
    """Runs of ``shortest`` to ``longest`` words in ``buckets``; of the documents with ``min_words``
    or more ``percent`` of a hundred are drawn, with noise of ``seed``."""

    shortest: int = 1
    longest: int = 1
    buckets: int = 10_000
    percent: int = 10
    min_words: int = 20
    seed: int = 2024

    @property
    def stored(self) -> np.dtype:
        return np.dtype("<u2" if self.buckets <= 1 << 16 else "<u4")


@cache
def _zero_bytes(power: int) -> np.ndarray:
    """What 2**``power`` zero bytes make of a CRC register, as a table for each of its bytes."""
    if power:
        half = _zero_bytes(power - 1)
        return _applied(half, _applied(half, _columns())).reshape(4, 256)
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ np.uint32(_POLYNOMIAL), step >> 1)
    columns = _columns()
    return (step[columns & 0xFF] ^ (columns >> 8)).reshape(4, 256)


def _columns() -> np.ndarray:
    return (np.arange(256, dtype=np.uint32) << np.array([[0], [8], [16], [24]], np.uint32)).ravel()


def _applied(table: np.ndarray, register: np.ndarray) -> np.ndarray:
    return (
        table[0][register & 0xFF]
        ^ table[1][register >> 8 & 0xFF]
        ^ table[2][register >> 16 & 0xFF]
        ^ table[3][register >> 24]
    )


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Each CRC moved on by its number of zero bytes, without those the register starts with."""
    out = crc.copy()
    for power in range(int(n_bytes.max(initial=0)).bit_length()):
        some = np.flatnonzero(n_bytes >> power & 1)
        out[some] = _applied(_zero_bytes(power), out[some])
    return out


def buckets_of(batch_texts: list[str], settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all features, text by text, and each text's number of features and of words."""
    before, after, lengths, n_words = [], [], [], []
    for text in batch_texts:
        words = text.encode("utf-8", "surrogatepass").translate(_NORMAL).split()
        n_words.append(len(words))
        lengths += map(len, words)
        register = 0
        for word in words:
            register = crc32(b" ", register)
            before.append(register)
            register = crc32(word, register)
            after.append(register)
    starts, ends = np.array(before, dtype=np.uint32), np.array(after, dtype=np.uint32)
    sizes = np.array(lengths, dtype=np.int64)
    words = np.array(n_words, dtype=np.int64)
    end_at = np.cumsum(sizes + 1)
    start_at = end_at - sizes
    first = np.cumsum(words) - words
    found, owners = [], []
    every = np.arange(len(words))
    n_features = np.zeros(len(words), dtype=np.int64)
    for n in range(settings.shortest, settings.longest + 1):
        runs = np.maximum(words - n + 1, 0)
        i = np.repeat(first, runs) + spread(runs)
        j = i + n - 1
        crc = ends[j] ^ shifted(starts[i], end_at[j] - start_at[i])
        found.append((crc.astype(np.int64) % settings.buckets).astype(settings.stored))
        owners.append(np.repeat(every, runs))
        n_features += runs
    flat = np.concatenate(found) if found else np.zeros(0, settings.stored)
    if len(found) > 1:
        flat = flat[np.argsort(np.concatenate(owners), kind="stable")]
    return flat, n_features, words


def features(docs: DataFrame, settings: Settings, *keep: str, text: str = "text") -> DataFrame:
    """``keep`` columns of every row, ``n_words``, ``n_features`` and ``buckets`` (packed numbers)."""
    plain, kept, fields = texts(docs, *keep, text=text)
    width = settings.stored.itemsize

    def hashing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat, n, words = buckets_of(batch["text"].to_pylist(), settings)
            offsets = np.r_[0, np.cumsum(n * width)].astype(np.int32)
            packed = pa.BinaryArray.from_buffers(
                pa.binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())]
            )
            yield pa.RecordBatch.from_arrays(
                [*(batch[k] for k in kept), pa.array(words), pa.array(n), packed],
                [*kept, "n_words", "n_features", "buckets"],
            )

    schema = fields + "n_words long, n_features long, buckets binary"
    return plain.mapInArrow(hashing, schema).toDF(*keep, "n_words", "n_features", "buckets")


def _unpacked(column: pa.Array, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows one after the other, and how many each row has."""
    raw = column.to_pylist()
    sizes = np.array([len(b) for b in raw], dtype=np.int64) // settings.stored.itemsize
    return np.frombuffer(b"".join(raw), settings.stored), sizes


def totals(found: DataFrame, settings: Settings) -> np.ndarray:
    """How many features of all rows each bucket holds; ``settings.buckets`` numbers."""

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(settings.buckets, dtype=np.int64)
        for whole in batches:
            for batch in slices([whole], "buckets"):
                flat, _ = _unpacked(batch["buckets"], settings)
                held += np.bincount(flat, minlength=settings.buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["bucket", "n"])

    summed = found.select("buckets").mapInArrow(counting, "bucket long, n long")
    out = np.zeros(settings.buckets, dtype=np.int64)
    for row in summed.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(of_docs: np.ndarray, of_target: np.ndarray) -> np.ndarray:
    """By how much each bucket is likelier in the target: floored thousandths of a logarithm."""
    n = len(of_docs)
    whole, target = float(of_docs.sum() + n), float(of_target.sum() + n)
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * whole / ((s + 1.0) * target)))
            for s, t in zip(of_docs.tolist(), of_target.tolist(), strict=True)
        ],
        dtype=np.int64,
    )


def weighed(found: DataFrame, gain: np.ndarray, settings: Settings) -> DataFrame:
    """``found`` with ``weight``, the floored mean gain of a row's features, for its ``buckets``."""
    names = [c for c in found.columns if c != "buckets"]

    def weighing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices([whole], "buckets"):
                flat, sizes = _unpacked(batch["buckets"], settings)
                sums = np.r_[0, np.cumsum(gain[flat])]
                ends = np.cumsum(sizes)
                weight = (sums[ends] - sums[ends - sizes]) // np.maximum(sizes, 1)
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c] for c in names), pa.array(weight)], [*names, "weight"]
                )

    fields = "".join(f"`{c}` {t}, " for c, t in found.dtypes if c != "buckets")
    return found.mapInArrow(weighing, fields + "weight long")


def noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise in floored thousandths from a hash of the id; a null id is empty text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _ranked(scored: DataFrame, settings: Settings) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3... of the drawn rows by falling ``score``, else null.

    A histogram of the scores, whole numbers between some -50,000 and 70,000 at any
    size, gives the lowest score that can be drawn. Rows from there on are dealt to ranges of
    (score, id, text, row), so that neither a score nor an id many rows have is in one task,
    and ranked by what lies in the ranges before and the place in their own.
    """
    spark = scored.sparkSession
    chosen = F.col("n_words") >= settings.min_words
    counted = scored.where(chosen).groupBy("score").agg(F.count("*").alias("n")).collect()
    drawn = settings.percent * sum(r.n for r in counted) // 100
    lowest, above = None, 0
    for row in sorted(counted, key=lambda r: -r.score):
        if above >= drawn:
            break
        lowest, above = row.score, above + row.n
    if lowest is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    near = chosen & (F.col("score") >= lowest)
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("text_hash"), F.asc("row")]
    placed = staged(
        scored.where(near)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id()),
        "resampling-placed",
    )
    part = F.floor(F.col("place") / _ROWS).cast("long")
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect(), key=lambda r: r.part)
    before = np.cumsum([0, *(r["count"] for r in sizes)]).tolist()
    # a row for each range; there are as many as shuffle partitions
    offsets = spark.createDataFrame(
        [(r.part, n) for r, n in zip(sizes, before, strict=False)],
        StructType([StructField("part", LongType()), StructField("before", LongType())]),
    )
    rank = F.col("before") + F.col("place") % _ROWS + 1
    ranked = (
        placed.withColumn("part", part)
        .join(F.broadcast(offsets), "part")
        .withColumn("rank", F.when(rank <= drawn, rank))
    )
    rest = scored.where(~near).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*rest.columns).union(rest)


def resample(
    docs: DataFrame, target: DataFrame, *keep: str, settings: Settings | None = None,
    id_col: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """``keep`` columns of every row, ``n_features``, ``weight``, ``score`` and ``rank``.

    ``rank`` counts the drawn rows from the highest score, ties to the smaller id; it is null
    for the others. Null texts have no feature and weigh 0; a null id has the noise of
    empty text and comes after all ids. Rows that share an id share its noise, and equal scores
    of one id are ranked by a hash of the text; each row is drawn for itself. Without documents
    the result is empty, without target all gains fall on what the documents have.
    """
    settings = settings or Settings()
    names = [f"c{i}" for i in range(len(keep))]
    own = docs.select(
        *[docs[c].alias(n) for c, n in zip(keep, names, strict=True)],
        docs[id_col].alias("id"),
        F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("text_hash"),
        docs[text].alias("text"),
    )
    found = staged(features(own, settings, *names, "id", "text_hash"), "resampling-features")
    wanted = features(target.select(target[target_text].alias("text")), settings)
    gain = gains(totals(found, settings), totals(wanted, settings))
    scored = staged(
        weighed(found, gain, settings)
        .withColumn("score", F.col("weight") + noise(F.col("id"), settings.seed))
        .withColumn("row", F.monotonically_increasing_id()),
        "resampling-scored",
    )
    ranked = _ranked(scored, settings)
    return ranked.select(*names, "n_features", "weight", "score", "rank").toDF(
        *keep, "n_features", "weight", "score", "rank"
    )
