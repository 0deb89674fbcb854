"""Tables that are replaced in one step: versions behind a view.

``publish`` writes the rows as a table of its own, ``<name>__v<number>``, and then lets the view
``<name>`` select from it. A reader that has begun goes on with the version the view
named then; one that begins later sees the new one; none finds the name free or half of the rows. The
version before stays for readers that still use it, older ones are removed.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tableops.operators.tables import create_table, drop_table, leftover_dir, quoted, table_exists
from tableops.session import path_exists


def versions(spark: SparkSession, name: str) -> list[int]:
    """The numbers of the versions that are there, ascending."""
    db, table = name.split(".")
    named = re.compile(re.escape(table) + r"__v(\d+)$")
    found = [named.match(t.name) for t in spark.catalog.listTables(db)]
    return sorted(int(m[1]) for m in found if m)


def current(spark: SparkSession, name: str) -> int | None:
    """The number of the version the view selects from; None if nothing is published."""
    if not table_exists(spark, name):
        return None
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(name)}")
    text = described.where("col_name = 'View Text'").first()
    found = re.search(r"__v(\d+)`$", text["data_type"]) if text else None
    if found is None:
        raise ValueError(f"{name} is no view of versions")
    return int(found[1])


def _point(spark: SparkSession, name: str, version: int) -> None:
    spark.sql(f"CREATE OR REPLACE VIEW {quoted(name)} AS SELECT * FROM {quoted(f'{name}__v{version}')}")


def publish(df: DataFrame, name: str, keep: int = 2, **layout) -> DataFrame:
    """Replace what ``name`` shows by ``df``, which may read from ``name`` itself.

    ``keep`` versions stay, the new one included; a reader may take as long as it takes to publish
    ``keep - 1`` more. ``layout`` as in ``create_table``. A version a failed job left
    half written is numbered over, and removed with the old ones. One writer at a time.
    """
    if keep < 1:
        raise ValueError("the new version has to stay")
    spark = df.sparkSession
    before = current(spark, name)
    number = max([*versions(spark, name), before or 0]) + 1
    failed = []  # folders without a table, which late tasks of a failed job may still write to
    while path_exists(spark, leftover_dir(spark, f"{name}__v{number}")):
        failed.append(number)
        number += 1
    create_table(df, f"{name}__v{number}", **layout)
    _point(spark, name, number)
    shown = [v for v in versions(spark, name) if before is None or v <= before]
    unseen = [v for v in versions(spark, name) if before is not None and before < v < number]
    for old in [*failed, *unseen, *shown[: max(0, len(shown) + 1 - keep)]]:
        if old != number:
            drop_table(spark, f"{name}__v{old}")
    return spark.table(name)


def roll_back(spark: SparkSession, name: str) -> DataFrame:
    """Let ``name`` show the version before the current one; that has to be there still."""
    now = current(spark, name)
    older = [v for v in versions(spark, name) if now is not None and v < now]
    if not older:
        raise ValueError(f"no older version of {name}")
    _point(spark, name, older[-1])
    return spark.table(name)


def drop_versions(spark: SparkSession, name: str) -> None:
    """Drop the view, then all versions."""
    spark.sql(f"DROP VIEW IF EXISTS {quoted(name)}")
    for version in versions(spark, name):
        drop_table(spark, f"{name}__v{version}")
