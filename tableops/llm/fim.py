"""Fill-in-middle transformation by repeated-capture matching.

A text is a run of units, by default words of letters and single other characters.
One ``fullmatch`` of ``(unit)*`` with a library that keeps every repetition of a
group gives all unit ends at once: their number is n, and two of them are the cuts
between prefix, middle and suffix. Nothing steps from unit to unit in Python.

Draws come from a hash of the document's id, so a rerun, another partitioning or a
lost executor gives the same cuts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tableops.llm.base import slices, texts

#: Code points of a text that one match takes; what it keeps in memory follows this, not the text.
_BLOCK = 1 << 18

PLAIN, PSM, SPM = "plain", "psm", "spm"
NAMES = ("n", "form", "output", "prefix_chars", "middle_chars")


@dataclass(frozen=True)
class Plan:
    """How texts are cut and put together.

    ``seed`` goes before the id into the hash. Of 100 documents ``transformed`` are
    taken apart, and of 100 of these ``spm`` have the suffix first. A unit is a run of
    ``joined`` characters (a character class) or a single other character. Texts that
    hold one of the marks stay plain.
    """

    seed: int = 1
    transformed: int = 90
    spm: int = 20
    joined: str = "A-Za-z"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @cached_property
    def units(self) -> regex.Pattern:
        return regex.compile(f"([{self.joined}]+|[^{self.joined}])*")

    @cached_property
    def rest_of_run(self) -> regex.Pattern:
        return regex.compile(f"(?<=[{self.joined}])[{self.joined}]*")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def unit_ends(text: str, plan: Plan) -> np.ndarray:
    """Where each unit of ``text`` ends, in code points.

    A text beyond a block is matched block by block, each ending where a unit does.
    """
    found, at = [], 0
    while at < len(text):
        to = min(at + _BLOCK, len(text))
        if rest := plan.rest_of_run.match(text, to):
            to = rest.end()
        found.append(np.array(plan.units.fullmatch(text, at, to).ends(1), dtype=np.int64))
        at = to
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def draws(doc_id: int | None, plan: Plan) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of an id: two cuts, whether, and which form. A null id is empty text."""
    digest = sha256(f"{plan.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))  # type: ignore[return-value]


@dataclass(frozen=True)
class Cut:
    """A document taken apart: units, form, output and the lengths of prefix and middle (None if plain)."""

    n: int
    form: str
    output: str
    prefix_chars: int | None
    middle_chars: int | None


def cut(text: str, doc_id: int | None, plan: Plan) -> Cut:
    ends = unit_ends(text, plan)
    n = len(ends)
    one, two, whether, which = draws(doc_id, plan)
    if not n or any(m in text for m in plan.marks) or whether % 100 >= plan.transformed:
        return Cut(n, PLAIN, text, None, None)
    low, high = sorted((one % (n + 1), two % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = plan.marks
    if which % 100 < plan.spm:
        return Cut(n, SPM, f"{s}{suffix}{p}{prefix}{m}{middle}", a, b - a)
    return Cut(n, PSM, f"{p}{prefix}{s}{suffix}{m}{middle}", a, b - a)


def rebuilt(output: str, form: str, plan: Plan) -> str:
    """The text an output was made of.

    A transformed text holds no mark, so the first of each mark is where a part begins.
    """
    if form == PLAIN:
        return output
    first, second = (plan.suffix, plan.prefix) if form == SPM else (plan.prefix, plan.suffix)
    one, _, rest = output.removeprefix(first).partition(second)
    two, _, middle = rest.partition(plan.middle)
    prefix, suffix = (two, one) if form == SPM else (one, two)
    return prefix + middle + suffix


def transform(
    docs: DataFrame, *keep: str, plan: Plan | None = None, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``keep`` columns of every row and its ``n``, ``form``, ``output``, ``prefix_chars``, ``middle_chars``.

    Null texts count as empty: no unit, plain, empty output. Rows of one id and text get the
    same result; a null id draws as empty text does. Other columns may have any name.
    """
    plan = plan or Plan()
    plain, kept, fields = texts(docs, *keep, id_col, text=text)

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [
                cut(t, i, plan)
                for t, i in zip(batch["text"].to_pylist(), batch[kept[-1]].to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch[k] for k in kept),
                    pa.array([c.n for c in made], pa.int64()),
                    pa.array([c.form for c in made], pa.string()),
                    pa.array([c.output for c in made], pa.string()),
                    pa.array([c.prefix_chars for c in made], pa.int64()),
                    pa.array([c.middle_chars for c in made], pa.int64()),
                ],
                [*kept, *NAMES],
            )

    schema = fields + "n long, form string, output string, prefix_chars long, middle_chars long"
    return plain.mapInArrow(cutting, schema).drop(kept[-1]).toDF(*keep, *NAMES)


def restore(
    made: DataFrame, *keep: str, plan: Plan | None = None, output: str = "output", form: str = "form"
) -> DataFrame:
    """``keep`` columns of every row and the ``text`` its output and form came from.

    A null output counts as empty, a null form as plain.
    """
    plan = plan or Plan()
    plain, kept, fields = texts(made, *keep, form, text=output)

    def restoring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            back = [
                rebuilt(t, f or PLAIN, plan)
                for t, f in zip(batch["text"].to_pylist(), batch[kept[-1]].to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch[k] for k in kept), pa.array(back, pa.string())], [*kept, "text"]
            )

    return plain.mapInArrow(restoring, fields + "text string").drop(kept[-1]).toDF(*keep, "text")
