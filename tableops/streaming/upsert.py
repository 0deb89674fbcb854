"""The incremental merge as a stream.

A target is a folder. Each micro-batch adds its own latest rows as
``delta/batch=<number>``; reading merges them. Now and then everything is merged
into a new ``base/through=<number>``. A batch costs what its rows cost, not what the
target does.

Spark numbers batches by checkpoint, from 0. The target keeps in ``runs`` which number
each checkpoint's first batch has here, above all that were there before. So a batch
that is run again after a failure writes the same folder again, and a new
checkpoint on an old target adds to it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tableops.functions.scalars import event_time
from tableops.operators.merge import latest_rows, union_all
from tableops.session import delete_path, hadoop_path, path_exists

_BATCH = "__batch"
_IS, _WAS = "__is", "__was"


def _numbers(spark: SparkSession, folder: str, name: str, finished: bool = True) -> list[int]:
    """The numbers of ``<name>=<number>`` folders, only of finished ones unless asked, ascending."""
    if not path_exists(spark, folder):
        return []
    fs, jpath = hadoop_path(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(jpath)]
    numbers = [int(n.split("=")[1]) for n in names if n.startswith(f"{name}=")]
    done = [
        n for n in numbers if not finished or path_exists(spark, f"{folder}/{name}={n}/_SUCCESS")
    ]
    return sorted(done)


def _state(spark: SparkSession, path: str) -> tuple[int | None, list[int]]:
    """The newest base, and the batches that came after it."""
    bases = _numbers(spark, f"{path}/base", "through")
    base = bases[-1] if bases else None
    batches = _numbers(spark, f"{path}/delta", "batch")
    return base, [b for b in batches if base is None or b > base]


def _merged(
    spark: SparkSession, path: str, base: int | None, batches: list[int], keys: list[str], ts: str
) -> DataFrame:
    """Batches are ranked among themselves; the base has one row per key and is only filtered."""
    old = None if base is None else spark.read.parquet(f"{path}/base/through={base}")
    if not batches:
        if old is None:
            raise ValueError(f"no finished batch in {path}")
        return old
    folders = [f"{path}/delta/batch={b}" for b in batches]
    rows = spark.read.option("basePath", f"{path}/delta").option("mergeSchema", True).parquet(*folders)
    rows = rows.withColumn(_BATCH, F.col("batch").cast("long")).drop("batch")
    new = latest_rows(rows, keys, ts, "one", prefer=[F.col(_BATCH).desc()]).drop(_BATCH)
    if old is None:
        return new
    was = old.select(*keys, event_time(old, ts).alias(_WAS))
    arrived = new.select(*keys, event_time(new, ts).alias(_IS))
    # a base row goes if its key's batch row is not older, else that batch row goes
    kept = old.withColumn(_WAS, event_time(old, ts)).join(arrived, keys, "left")
    kept = kept.where(F.col(_IS).isNull() | (F.col(_IS) < F.col(_WAS))).select(*old.columns)
    news = new.withColumn(_IS, event_time(new, ts)).join(
        was.join(arrived, keys).where(F.col(_WAS) > F.col(_IS)).select(*keys), keys, "left_anti"
    )
    return union_all(kept, news.select(*new.columns))


def _first_number(spark: SparkSession, path: str, checkpoint: str, number: int) -> int:
    """The number here of the first batch of ``checkpoint``'s query; set at its first batch."""
    runs = f"{path}/runs"
    query = _query_id(spark, checkpoint)
    known = spark.read.schema("query string, first long").json(runs) if path_exists(spark, runs) else None
    row = known.where(F.col("query") == query).first() if known is not None else None
    if row is not None:
        return row["first"]
    there = [
        *_numbers(spark, f"{path}/base", "through", finished=False),
        *_numbers(spark, f"{path}/delta", "batch", finished=False),
    ]
    first = max(there) + 1 - number if there else -number
    spark.createDataFrame([(query, first)], "query string, first long").coalesce(1).write.mode(
        "append"
    ).json(runs)
    return first


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id Spark keeps in a checkpoint for as long as it exists."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def read_target(spark: SparkSession, path: str, keys: list[str], ts: str) -> DataFrame:
    """The latest row of each key over all finished batches."""
    return _merged(spark, path, *_state(spark, path), keys, ts)


def compact(spark: SparkSession, path: str, keys: list[str], ts: str) -> int | None:
    """Merge base and batches into a new base; the number of its last batch.

    The previous base and its batches stay for readers that already began, and
    are removed by the compaction after.
    """
    base, batches = _state(spark, path)
    if not batches:
        return base
    last = batches[-1]
    rows = _merged(spark, path, base, batches, keys, ts)
    rows.write.mode("overwrite").parquet(f"{path}/base/through={last}")
    if base is not None:
        for old in _numbers(spark, f"{path}/base", "through"):
            if old < base:
                delete_path(spark, f"{path}/base/through={old}")
        for old in _numbers(spark, f"{path}/delta", "batch"):
            if old <= base:
                delete_path(spark, f"{path}/delta/batch={old}")
    return last


def stream_merge_latest(
    changes: DataFrame,
    path: str,
    keys: list[str],
    ts: str,
    checkpoint: str,
    every: str | None = None,
    compact_every: int = 50,
) -> StreamingQuery:
    """Merge a stream of changed rows into the target at ``path``.

    Without ``every`` the query takes in what is there and ends; with it, for
    example ``"10 minutes"``, it goes on at that pace. At the same ``ts`` the row
    of the later batch wins. One query at a time may write to a target.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = _first_number(spark, path, checkpoint, number) + number
        rows = latest_rows(batch, keys, ts, "one")
        rows.write.mode("overwrite").parquet(f"{path}/delta/batch={own}")
        if own and own % compact_every == 0:
            compact(spark, path, keys, ts)

    writer = changes.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    pace = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**pace).start()
