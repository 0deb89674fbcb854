"""Quality classifier: histogram gradient-boosted trees over document statistics.

Spark tasks reduce each whole text to a few numbers, which are staged. The trees are
grown in numpy from at most ``max_rows`` labelled rows, on binned features, and are
then flattened: all trees are complete and of one depth, so a document walks down
all of them at once by index arithmetic on three arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableops.llm import rules
from tableops.llm.base import lowest_by_hash, slices, texts

FEATURES = (
    "log_words word_length symbols repeated_lines repeated_words words_a_line different_words "
    "capitals exclamations digits punctuation bytes_a_char spaces"
).split()

_DIGITS = b"0123456789"
_MARKS = b".,;:!?'\"()-"
_WHITE = b"\t\n\v\f\r "


def features(text: str) -> list[float]:
    """The statistics named in ``FEATURES``; all are 0 for an empty text."""
    n, chars, symbols, dup_lines, repeated, lines, different, upper, marked = rules.measure(text)
    raw = text.encode("utf-8", "surrogatepass")
    words, letters, size = max(n, 1), max(chars, 1), len(raw)
    return [
        math.log1p(n),
        chars / words,
        symbols / words,
        dup_lines / max(lines, 1),
        repeated / words,
        n / max(lines, 1),
        different / words,
        upper / letters,
        marked / words,
        (size - len(raw.translate(None, _DIGITS))) / letters,
        (size - len(raw.translate(None, _MARKS))) / letters,
        size / max(len(text), 1),
        (size - len(raw.translate(None, _WHITE))) / words,
    ]


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns of every row and its features; a null text counts as empty."""
    plain, kept, fields = texts(docs, *keep)

    def measuring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = np.array([features(t) for t in batch["text"].to_pylist()], dtype=np.float64)
            yield pa.RecordBatch.from_arrays(
                [*(batch[k] for k in kept), *(pa.array(c) for c in own.T)], [*kept, *FEATURES]
            )

    schema = fields + ", ".join(f"{f} double" for f in FEATURES)
    return plain.mapInArrow(measuring, schema).toDF(*keep, *FEATURES)


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth, node k's children being 2k + 1 and 2k + 2.

    A row goes right where ``values[feature] > threshold``. ``leaves`` add up to the
    log odds, with ``prior``.
    """

    feature: np.ndarray
    threshold: np.ndarray
    leaves: np.ndarray
    prior: float

    def score(self, values: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each row."""
        trees, inner = self.feature.shape
        node = np.zeros((len(values), trees), dtype=np.int64)
        rows, tree = np.arange(len(values))[:, None], np.arange(trees)[None, :]
        for _ in range(int(math.log2(inner + 1)) if inner else 0):
            right = values[rows, self.feature[tree, node]] > self.threshold[tree, node]
            node = 2 * node + 1 + right
        log_odds = self.prior + self.leaves[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(log_odds, -40, 40)))


def grow(
    values: np.ndarray,
    labels: np.ndarray,
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.2,
    bins: int = 64,
    penalty: float = 1.0,
    least: int = 5,
) -> Forest:
    """Boosted trees for 0/1 labels with logistic loss.

    Each level adds up gradients and curvatures of all its nodes in one histogram per
    feature, and takes each node's best cut. A node without a gain sends all rows left.
    """
    n, width = values.shape if len(values) else (0, len(FEATURES))
    inner = 2**depth - 1
    feature = np.zeros((trees, inner), dtype=np.int64)
    threshold = np.full((trees, inner), np.inf)
    leaves = np.zeros((trees, inner + 1))
    if not n:
        return Forest(feature, threshold, leaves, 0.0)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    prior = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(values[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], values[:, f], side="left") for f in range(width)], 1)
    edges = np.full((width, bins), np.inf)
    for f in range(width):
        edges[f, : len(cuts[f])] = cuts[f]
    log_odds = np.full(n, prior)
    for t in range(trees):
        p = 1 / (1 + np.exp(-log_odds))
        slope, curve = labels - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            nodes, first = 2**level, 2**level - 1
            best = np.full(nodes, 1e-6)
            for f in range(width):
                cell = (node - first) * bins + binned[:, f]
                g, h, c = (
                    np.bincount(cell, weights=w, minlength=nodes * bins).reshape(nodes, bins)
                    for w in (slope, curve, np.ones(n))
                )
                left = [x.cumsum(axis=1)[:, :-1] for x in (g, h, c)]
                total = [x.sum(axis=1, keepdims=True) for x in (g, h, c)]
                right = [a - b for a, b in zip(total, left, strict=True)]
                gain = (
                    left[0] ** 2 / (left[1] + penalty)
                    + right[0] ** 2 / (right[1] + penalty)
                    - total[0] ** 2 / (total[1] + penalty)
                )
                gain[(left[2] < least) | (right[2] < least)] = -np.inf
                at = gain.argmax(axis=1)
                top = gain[np.arange(nodes), at]
                better = top > best
                feature[t, first : first + nodes][better] = f
                threshold[t, first : first + nodes][better] = edges[f, at[better]]
                best = np.where(better, top, best)
            right = values[np.arange(n), feature[t, node]] > threshold[t, node]
            node = 2 * node + 1 + right
        leaf = node - inner
        g, h = (np.bincount(leaf, weights=w, minlength=inner + 1) for w in (slope, curve))
        leaves[t] = rate * g / (h + penalty)
        log_odds += leaves[t][leaf]
    return Forest(feature, threshold, leaves, prior)


def train(
    known: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000, **shape
) -> Forest:
    """Trees from ``known`` (``doc_id`` and features) and the labels of the same ids.

    If more than ``max_rows`` rows have a label, those whose ids hash lowest are used.
    """
    marked = labels.where(F.col(label).isNotNull()).select("doc_id", F.col(label).alias("label"))
    joined = known.join(marked, "doc_id")
    rows = lowest_by_hash(joined, max_rows, "doc_id", *FEATURES).select(*FEATURES, "label").toPandas()
    values = rows[list(FEATURES)].to_numpy(dtype=np.float64)
    return grow(values, rows["label"].to_numpy(dtype=np.float64), **shape)


def classify(known: DataFrame, forest: Forest, *keep: str) -> DataFrame:
    """``keep`` columns of every row of ``known`` (which has the features) and ``score``."""
    names = [f"k{i}" for i in range(len(keep))]
    plain = known.select(
        *[known[c].alias(k) for c, k in zip(keep, names, strict=True)],
        *[known[f] for f in FEATURES],
    )
    fields = "".join(f"{k} {t}, " for k, t in plain.dtypes[: len(keep)])

    def scoring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                values = np.stack([batch[f].to_numpy(False) for f in FEATURES], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*(batch[k] for k in names), pa.array(forest.score(values))], [*names, "score"]
                )

    return plain.mapInArrow(scoring, fields + "score double").toDF(*keep, "score")
