"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent letter n-grams (one to
three letters, with word borders), most frequent first. A document's own list is
compared with each profile by the out-of-place distance: how far every n-gram is
from its place there, or the length of the profile if it is not there at all.

Training counts the n-grams of every labelled text in Spark tasks, sums them by
language and n-gram (partial sums first, so a language with most of the rows is no
hot key) and keeps ``size`` ranks per language. Only those reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableops.llm.base import code_points, slices, texts

UNDETERMINED = "und"
#: Counts a task holds before it hands them on.
_HELD = 1_000_000
_BORDER = 1


@dataclass(frozen=True)
class Profiles:
    """``grams`` sorted; ``ranks[i, j]`` is the place of gram i in language j."""

    langs: tuple[str, ...]
    grams: np.ndarray
    ranks: np.ndarray
    size: int


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _marked(batch_texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters with one border between words, and each one's document."""
    lowered = [t.lower() for t in batch_texts]
    codes = code_points("\n" + "\n".join(lowered) + "\n").astype(np.int64)
    owner = np.r_[0, np.repeat(np.arange(len(lowered)), [len(t) + 1 for t in lowered])]
    codes[~_letters()[codes]] = _BORDER
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != _BORDER) | (codes[:-1] != _BORDER)
    return codes[keep], owner[keep]


def _grams(codes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Every n-gram as a number in ``base`` and the place of one of its letters.

    Two and three letter n-grams may begin or end at a border but not span one.
    """
    one = np.flatnonzero(codes != _BORDER)
    inside = codes != _BORDER
    two = np.flatnonzero(inside[:-1] | inside[1:])
    three = np.flatnonzero(inside[1:-1])
    keys = np.concatenate(
        [
            codes[one],
            codes[two] * base + codes[two + 1],
            (codes[three] * base + codes[three + 1]) * base + codes[three + 2],
        ]
    )
    return keys, np.concatenate([one, np.where(inside[two], two, two + 1), three + 1])


_CODE_BASE = 1 << 21


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(parts):
        keys = np.concatenate([k for k, _ in parts])
        counts = np.concatenate([n for _, n in parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[first], np.add.reduceat(counts, first)

    def handed_on():
        for lang, parts in held.items():
            keys, counts = merged(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys)), pa.array(keys), pa.array(counts)],
                ["lang", "gram", "n"],
            )

    for batch in slices(batches):
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, own in by_lang.items():
            keys, _ = _grams(_marked(own)[0], _CODE_BASE)
            if not len(keys):
                continue
            keys, counts = np.unique(keys, return_counts=True)
            parts = held.setdefault(lang, [])
            parts.append((keys, counts))
            size += len(keys)
        if size > _HELD:
            held = {lang: [merged(parts)] for lang, parts in held.items()}
            if sum(len(parts[0][0]) for parts in held.values()) > _HELD // 2:
                yield from handed_on()
                held = {}
            size = sum(len(parts[0][0]) for parts in held.values())
    yield from handed_on()


def train(docs: DataFrame, size: int = 400, text: str = "text", lang: str = "lang") -> Profiles:
    """The profiles of every language in ``docs``; rows without text or language do not count.

    Equal counts rank by n-gram. A language whose texts have no letter has no profile.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counted = (
        known.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
        .mapInArrow(_counter, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = (
        counted.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= size)
        .select("lang", "gram", "rank")
        .collect()
    )
    langs = tuple(sorted({r.lang for r in rows}))
    grams = np.unique(np.array([r.gram for r in rows], dtype=np.int64))
    ranks = np.full((len(grams), len(langs)), -1, dtype=np.int32)
    if rows:
        ranks[
            np.searchsorted(grams, [r.gram for r in rows]),
            [langs.index(r.lang) for r in rows],
        ] = [r.rank - 1 for r in rows]
    return Profiles(langs, grams, ranks, size)


def distances(batch_texts: list[str], profiles: Profiles) -> tuple[np.ndarray, np.ndarray]:
    """Mean out-of-place distance (0 to 1) per text and language, and n-grams compared."""
    docs, width = len(batch_texts), len(profiles.langs)
    codes, owner = _marked(batch_texts)
    alphabet = np.unique(codes)
    base = len(alphabet) + 1
    dense = np.searchsorted(alphabet, codes) + 1  # the border is the smallest: 1
    keys, at = _grams(dense, base)
    keys = np.sort(owner[at] * base**3 + keys)
    if not len(keys):
        return np.ones((docs, width)), np.zeros(docs, dtype=np.int64)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    counts = np.diff(np.r_[first, len(keys)])
    keys = keys[first]
    doc = keys // base**3
    most = counts.max() + 1
    order = np.argsort(doc * most + (most - counts), kind="stable")
    starts = np.searchsorted(doc, np.arange(docs + 1))
    rank = np.arange(len(keys)) - np.repeat(starts[:-1], np.diff(starts))
    top = rank < profiles.size
    keys, doc, rank = keys[order][top] % base**3, doc[top], rank[top]
    letters = np.r_[0, alphabet]  # digit 0: a shorter n-gram
    grams = (letters[keys // base**2] * _CODE_BASE + letters[keys // base % base]) * _CODE_BASE
    grams += letters[keys % base]
    seen = np.bincount(doc, minlength=docs)
    if not width:
        return np.ones((docs, 0)), seen
    place = np.minimum(np.searchsorted(profiles.grams, grams), len(profiles.grams) - 1)
    known = profiles.grams[place] == grams
    out = np.empty((docs, width))
    for j in range(width):
        want = np.where(known, profiles.ranks[place, j], -1)
        off = np.where(want >= 0, np.minimum(np.abs(want - rank), profiles.size), profiles.size)
        out[:, j] = np.bincount(doc, weights=off, minlength=docs)
    return np.where(seen[:, None] > 0, out / np.maximum(seen, 1)[:, None] / profiles.size, 1.0), seen


def _predicted(batch_texts: list[str], profiles: Profiles) -> tuple[list[str], np.ndarray]:
    dist, seen = distances(batch_texts, profiles)
    score = np.zeros(len(batch_texts))
    if not profiles.langs:
        return [UNDETERMINED] * len(batch_texts), score
    best = dist.argmin(axis=1)
    nearest = dist.min(axis=1)
    if len(profiles.langs) > 1:
        second = np.partition(dist, 1, axis=1)[:, 1]
        score = 1 - nearest / np.maximum(second, 1e-12)
    else:
        score = 1 - nearest
    score = np.clip(np.where(seen > 0, score, 0.0), 0.0, 1.0)
    names = [profiles.langs[b] if n else UNDETERMINED for b, n in zip(best, seen, strict=True)]
    return names, score


def identify(docs: DataFrame, profiles: Profiles, *keep: str) -> DataFrame:
    """``keep`` columns of every row with ``lang_pred`` and ``score``.

    ``und`` with score 0 if the text is null, empty or has no letter, or if no
    language is known. Else the nearest profile, the first by name if two are
    equally near; the score is how much nearer it is than the next one (0: tied).
    """
    plain, kept, fields = texts(docs, *keep)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, score = _predicted(batch["text"].to_pylist(), profiles)
            columns = [batch[k] for k in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(names, pa.string()), pa.array(score)],
                [*kept, "lang_pred", "score"],
            )

    return plain.mapInArrow(scored, fields + "lang_pred string, score double").toDF(*keep, "lang_pred", "score")
