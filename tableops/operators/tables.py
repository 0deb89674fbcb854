"""Create, replace, rename and alter warehouse tables. Names are ``db.table``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableops.session import delete_path, path_exists
from tableops.sources.files import inventory, path_below


def quoted(name: str) -> str:
    return ".".join(f"`{part}`" for part in name.split("."))


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def leftover_dir(spark: SparkSession, name: str) -> str:
    """Where a managed table of this name keeps its files."""
    db, table = name.split(".")
    return f"{spark.catalog.getDatabase(db).locationUri.rstrip('/')}/{table}"


def drop_table(
    spark: SparkSession, name: str, purge: bool = False, leftovers: bool = True
) -> None:
    """Drop the table if it is there, with the files a failed write left behind."""
    spark.sql(f"DROP TABLE IF EXISTS {quoted(name)}{' PURGE' if purge else ''}")
    if leftovers and path_exists(spark, leftover_dir(spark, name)):
        delete_path(spark, leftover_dir(spark, name))


def _writer(
    df: DataFrame, keys: list[str] | None, buckets: int | None, partition_by: str | None
):
    if partition_by:
        return df.hint("rebalance", partition_by).write.format("parquet").partitionBy(partition_by)
    writer = df.write.format("parquet")
    if buckets:
        writer = writer.bucketBy(buckets, *keys).sortBy(*keys)
    return writer


def create_table(
    df: DataFrame,
    name: str,
    keys: list[str] | None = None,
    buckets: int | None = None,
    partition_by: str | None = None,
) -> DataFrame:
    """Create ``name`` from ``df``; a table that is already there is an error."""
    _writer(df, keys, buckets, partition_by).mode("errorifexists").saveAsTable(name)
    return df.sparkSession.table(name)


def overwrite_table(
    df: DataFrame,
    name: str,
    keys: list[str] | None = None,
    buckets: int | None = None,
    staging: str | None = None,
    partition_by: str | None = None,
) -> DataFrame:
    """Replace ``name`` by ``df``, which may read from ``name`` itself.

    The rows are written to a staging table first, so that a failed job leaves
    the old table as it was.
    """
    spark = df.sparkSession
    staging = staging or f"{name}_staged"
    drop_table(spark, staging)
    create_table(df, staging, keys, buckets, partition_by)
    return swap_table(spark, staging, name)


def swap_table(spark: SparkSession, staged: str, name: str) -> DataFrame:
    """Put ``staged`` in the place of ``name``.

    Two renames and a drop, not one atomic step: for a moment no table has the
    name. The old table is kept as ``<name>_replaced`` until the new one is in
    place, and ``recover_table`` puts it back after a crash in between.
    """
    old = f"{name}_replaced"
    if table_exists(spark, name):
        drop_table(spark, old)
        rename_table(spark, name, old)
    else:
        drop_table(spark, name)
    try:
        rename_table(spark, staged, name)
    except Exception:
        recover_table(spark, name)
        raise
    drop_table(spark, old)
    return spark.table(name)


def recover_table(spark: SparkSession, name: str) -> bool:
    """Bring back the old table of a swap that stopped half way."""
    old = f"{name}_replaced"
    if table_exists(spark, name) or not table_exists(spark, old):
        return False
    rename_table(spark, old, name)
    return True


def rename_table(spark: SparkSession, name: str, new_name: str) -> None:
    """Rename a table; catalogs that keep the old folders of its partitions learn the new ones."""
    spark.sql(f"ALTER TABLE {quoted(name)} RENAME TO {quoted(new_name)}")
    if is_partitioned(spark, new_name):
        spark.sql(f"MSCK REPAIR TABLE {quoted(new_name)} SYNC PARTITIONS")
    spark.catalog.refreshTable(new_name)


def add_column(spark: SparkSession, name: str, column: str, datatype: str) -> DataFrame:
    """Add a column; it is null in the rows already there."""
    spark.sql(f"ALTER TABLE {quoted(name)} ADD COLUMNS (`{column}` {datatype})")
    return spark.table(name)


def keep_columns(spark: SparkSession, name: str, columns: list[str]) -> DataFrame:
    """Rewrite the table with these columns only."""
    return overwrite_table(spark.table(name).select(*columns), name)


def create_empty_table(spark: SparkSession, name: str, schema: str | T.StructType) -> DataFrame:
    """An empty table of the given column names and types."""
    return create_table(spark.createDataFrame([], schema), name)


def append_rows(df: DataFrame, name: str) -> DataFrame:
    df.select(*df.sparkSession.table(name).columns).write.mode("append").insertInto(name)
    return df.sparkSession.table(name)


def create_partitioned(df: DataFrame, name: str, by: str) -> DataFrame:
    """Create ``name`` partitioned on ``by``.

    ``rebalance`` gathers each value into few files, and splits a value that
    holds much of the data over several tasks.
    """
    return create_table(df, name, partition_by=by)


def overwrite_partitions(df: DataFrame, name: str, by: str) -> DataFrame:
    """Replace just those partitions of ``name`` that ``df`` has rows for.

    That is an option of this write to the table's folder, after which new partitions
    are registered; the session's own mode is not touched.
    """
    spark = df.sparkSession
    rows = df.select(*spark.table(name).columns).hint("rebalance", by)
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(by)
        .parquet(table_location(spark, name))
    )
    spark.catalog.recoverPartitions(name)
    spark.catalog.refreshTable(name)
    return spark.table(name)


def is_partitioned(spark: SparkSession, name: str) -> bool:
    return any(c.isPartition for c in spark.catalog.listColumns(quoted(name)))


def table_location(spark: SparkSession, name: str) -> str:
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(name)}")
    return described.where("col_name = 'Location'").first()["data_type"]


def files_fingerprint(spark: SparkSession, name: str) -> str:
    """A text that changes when files of the table come, go or change in size,
    but not when the table is renamed."""
    root = table_location(spark, name)
    count, size, names = (
        inventory(spark, root)
        .agg(
            F.count(F.lit(1)),
            F.coalesce(F.sum("length"), F.lit(0)),
            F.coalesce(F.bit_xor(F.xxhash64(path_below(spark, root), "length")), F.lit(0)),
        )
        .first()
    )
    return f"{count}/{size}/{names}"


def table_property(spark: SparkSession, name: str, key: str) -> str | None:
    rows = spark.sql(f"SHOW TBLPROPERTIES {quoted(name)}").where(F.col("key") == key)
    row = rows.first()
    return row["value"] if row else None


def set_table_property(spark: SparkSession, name: str, key: str, value: str) -> None:
    text = value.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"ALTER TABLE {quoted(name)} SET TBLPROPERTIES ('{key}' = '{text}')")
