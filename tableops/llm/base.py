"""What the operators of this subpackage share.

Tables come in any form: columns may hold nulls, rows may repeat, there may be no
rows and columns an operator does not know. ``texts`` picks the columns that are
used, so that others never clash with what an operator adds.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableops.session import shared_dir

#: Bytes of text a Python task works on at once; longer texts are a slice of their own.
SLICE_BYTES = 1 << 20


def on_workers(spark: SparkSession) -> None:
    """Python workers look for this package where the driver has it.

    Enough where they see that folder; else hand the package over with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder that every executor sees."""
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage, so that a lost executor costs a task and not a chain of
    them, and fixes values such as generated row numbers.
    """
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % folds


def lowest_by_hash(df: DataFrame, bound: int, *columns: str) -> DataFrame:
    """At most ``bound`` rows of ``df``, those whose columns hash lowest, for the driver.

    Of many rows only those under a threshold that about half as many again pass are
    ordered, so that not every task sends ``bound`` rows.
    """
    space = 1 << 40
    place = F.pmod(F.xxhash64(*columns), F.lit(space))
    rows = df.count()
    if rows > 2 * bound:
        df = df.where(place < int(space * 1.5 * bound / rows))
    return df.orderBy(place, *columns).limit(bound)


def texts(docs: DataFrame, *keep: str, text: str = "text") -> tuple[DataFrame, list[str], str]:
    """The kept columns under names of their own and ``text``, never null.

    Also these names, and the kept columns as the start of a schema.
    """
    on_workers(docs.sparkSession)
    names = [f"k{i}" for i in range(len(keep))]
    plain = docs.select(
        *[docs[c].alias(k) for c, k in zip(keep, names, strict=True)],
        F.coalesce(docs[text], F.lit("")).alias("text"),
    )
    return plain, names, "".join(f"{k} {t}, " for k, t in plain.dtypes[:-1])


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Record batches cut into runs of rows of about ``limit`` bytes of ``column``."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(False)
        at, ends = 0, np.cumsum(sizes, dtype=np.int64)
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def spread(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of ``counts``, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
