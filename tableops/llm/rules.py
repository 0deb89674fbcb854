"""Quality rules as a ledger of bits.

Every rule is evaluated once per document. The ledger keeps the measurements and
one number whose bit i says that rule i failed. A policy is a set of rules with a
version; whether it keeps a document, and what leaving out one of its rules would
change, follow from the bits alone, without reading a text again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableops.llm.base import slices, texts

_SPACE = "\t\n\v\f\r "
_SYMBOLS = "#*$%&|<>"
_WINDOW = 8

#: What is measured, all over whole texts; the first five are the base.
MEASURES = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_unique_words n_upper n_marked"
).split()


@dataclass(frozen=True)
class Rule:
    """Fails where ``failed`` is true; ``sql`` is the same test as SQL."""

    name: str
    sql: str

    def failed(self) -> Column:
        return F.expr(self.sql)


#: Bit i is rule i. Rules are only ever appended, so that old ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("repeated_lines", "n_lines >= 10 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("capitals", "100 * n_upper > 40 * word_chars"),
    Rule("exclamations", "100 * n_marked > 20 * n_words"),
    Rule("few_different_words", "n_words >= 30 AND 100 * n_unique_words < 15 * n_words"),
    Rule(
        "few_different_words_short",
        "n_words >= 30 AND n_words < 200 AND 100 * n_unique_words < 35 * n_words",
    ),
)

_BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}

#: A policy rejects what fails one of its rules. Versions are kept as they were.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(rule.name for rule in RULES),
}


def mask(policy: str) -> int:
    return sum(_BIT[name] for name in POLICIES[policy])


def measure(text: str) -> tuple[int, ...]:
    """The numbers named in ``MEASURES`` for one text."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in _SPACE)
    lines = [line for line in text.split("\n") if line.strip(_SPACE)]
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    marked = sum(w.endswith(b"!") for w in words) if "!" in text else 0
    return (
        n,
        chars,
        sum(text.count(c) for c in _SYMBOLS),
        len(lines) - len(set(lines)),
        _repeated(words),
        len(lines),
        len(set(words)),
        upper,
        marked,
    )


def _repeated(words: list[bytes]) -> int:
    """Words inside a run of eight that the text holds twice or more."""
    n = len(words) - _WINDOW + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    runs = np.zeros(n, dtype=np.uint64)
    for i in range(_WINDOW):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n]
    order = np.argsort(runs, kind="stable")
    same = runs[order][1:] == runs[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + _WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def ledger(docs: DataFrame, *keep: str, measured: Callable[[str], tuple] = measure) -> DataFrame:
    """``keep`` columns of every row with all measurements and ``failed_bits``.

    A null text counts as empty: all measurements are 0 and only ``few_words`` fails.
    """
    plain, kept, fields = texts(docs, *keep)

    def measuring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = np.array([measured(t) for t in batch["text"].to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch[k] for k in kept), *(pa.array(c) for c in rows.T)], [*kept, *MEASURES]
            )

    schema = fields + ", ".join(f"{m} long" for m in MEASURES)
    bits = [F.when(r.failed(), F.lit(_BIT[r.name])).otherwise(F.lit(0)) for r in RULES]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return plain.mapInArrow(measuring, schema).toDF(*keep, *MEASURES).withColumn("failed_bits", failed)


def rejected(policy: str, bits: str = "failed_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy))) != 0


def ablations(entries: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: documents that fail it, and those it alone rejects.

    Documents are first counted by their bits (map-side, at most two to the number
    of rules), so the rules are applied to counts and not to rows.
    """
    by_bits = (
        entries.select(F.col("failed_bits").bitwiseAND(F.lit(mask(policy))).alias("bits"))
        .groupBy("bits")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rules = F.array(
        *[F.struct(F.lit(n).alias("rule"), F.lit(_BIT[n]).alias("bit")) for n in POLICIES[policy]]
    )
    each = by_bits.select("bits", "n", F.explode(rules).alias("r"))
    fails = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("bits") == F.col("r.bit")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_rejected_alone"),
    )
