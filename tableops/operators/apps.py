"""Lists of cluster applications."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableops.functions.scalars import elapsed_minutes, millis_to_time
from tableops.sources.files import read_json

# The fields of an application in a cluster's list.
APP_FIELDS = (
    "id string, name string, user string, queue string, state string, "
    "finalStatus string, startedTime bigint, finishedTime bigint"
)


def read_apps(
    spark: SparkSession, path: str, fields: str = APP_FIELDS, whole: bool = False
) -> DataFrame:
    """Applications of documents ``{"apps": {"app": [...]}}``, one row each.

    A document per line, or with ``whole`` per file.
    """
    schema = f"apps struct<app: array<struct<{fields}>>>"
    return read_json(spark, path, schema, whole).select(F.inline("apps.app"))


def filter_apps(
    apps: DataFrame,
    text: str | None = None,
    state: str | None = None,
    queue: str | None = None,
) -> DataFrame:
    """Applications with ``text`` in any field, in that state and that queue."""
    if text is not None:
        fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in apps.columns]
        apps = apps.where(reduce(lambda a, b: a | b, [f.contains(text) for f in fields]))
    if state is not None:
        apps = apps.where(F.col("state") == state)
    if queue is not None:
        apps = apps.where(F.col("queue") == queue)
    return apps


def long_running(apps: DataFrame, minutes: int, now: Column | None = None) -> DataFrame:
    """Running applications older than ``minutes`` whole minutes, with their age.

    ``now`` is a UTC time without zone; by default the time of the query.
    """
    if now is None:
        now = F.convert_timezone(
            F.current_timezone(), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz")
        )
    started = millis_to_time(F.col("startedTime"))
    return (
        apps.where(F.col("state") == "RUNNING")
        .withColumn("running_minutes", elapsed_minutes(started, now))
        .where(F.col("running_minutes") > minutes)
    )


def newest_first(apps: DataFrame) -> DataFrame:
    return apps.orderBy(F.col("finishedTime").desc(), F.col("id"))
