"""Text, JSON and delimited files, and inventories of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableops.functions.scalars import whole_gb
from tableops.session import qualified


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line, in column ``value``; large files are split over tasks."""
    return read_records(spark, path, "\n")


def read_records(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """One row per piece between delimiters, in column ``value``."""
    return spark.read.option("lineSep", delimiter).text(path)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with its path. A file has to fit in one row."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), "value"
    )


def write_records(df: DataFrame, path: str, delimiter: str = "\n") -> None:
    """Write a one-column text frame, ``delimiter`` after each row."""
    df.write.option("lineSep", delimiter).text(path)


def read_json(
    spark: SparkSession, path: str, schema: str | T.StructType, whole: bool = False
) -> DataFrame:
    """JSON files: a document per line, or with ``whole`` one per file.

    Text that is not JSON stops the job.
    """
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=whole)


def write_json(df: DataFrame, path: str) -> None:
    """One document per row. Times keep their microseconds, nulls their field."""
    (
        df.write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        .option("ignoreNullFields", False)
        .json(path)
    )


def write_delimited(df: DataFrame, path: str, delimiter: str = "|") -> None:
    """Delimited files with a header. A path that is already there is an error."""
    (
        df.write.option("header", True)
        .option("delimiter", delimiter)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        .csv(path)
    )


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType,
    delimiter: str = "|",
    multiline: bool = False,
) -> DataFrame:
    """Delimited files with a header and known column types.

    Large files are split over tasks. ``multiline`` lets a quoted cell hold line
    breaks, and then each file is one task.
    """
    return (
        spark.read.schema(schema)
        .option("mode", "FAILFAST")
        .option("header", True)
        .option("delimiter", delimiter)
        .csv(path, multiLine=multiline)
    )


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """``path, modificationTime, length`` of every file below ``path``.

    The contents are never read: the column is pruned.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "modificationTime", "length")
    )


def path_below(spark: SparkSession, root: str) -> Column:
    """The path of a listed file, from ``root`` on."""
    return F.substring_index("path", qualified(spark, root) + "/", -1)


def dir_sizes(files: DataFrame, root: str) -> DataFrame:
    """Bytes, files and whole GB below each direct child of ``root``."""
    below = path_below(files.sparkSession, root)
    return (
        files.select(F.substring_index(below, "/", 1).alias("name"), "length")
        .groupBy("name")
        .agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files"))
        .withColumn("gb", whole_gb(F.col("bytes")))
    )


def content_summary(files: DataFrame, root: str, levels: int | None = None) -> DataFrame:
    """Files, folders and bytes below every folder under ``root``: ``folder, level, files, folders, bytes``.

    ``folder`` is the path from ``root`` on and empty for ``root`` itself, at level 0; with ``levels`` no
    deeper one is listed, but all that is below counts. ``folders`` leaves out the folder itself. Folders
    without any file are unknown to a list of files. A file adds to each folder above it; these
    sums are begun in the tasks that list the files, so the shuffle moves rows per folder.
    """
    below = path_below(files.sparkSession, root)
    parts = F.split(below, "/")
    depth = F.size(parts) - 1

    def above(depth: Column, parts: Column) -> Column:
        """The folders a path lies in, from the root on."""
        return F.transform(
            F.sequence(F.lit(0), depth),
            lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("folder"), n.alias("level")),
        )

    own = files.select(depth.alias("depth"), parts.alias("parts"), "length")
    summed = own.select(F.inline(above(F.col("depth"), F.col("parts"))), "length")
    counted = summed.groupBy("folder", "level").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")
    )
    # each folder but the root counts once for every folder above it
    inner = counted.where("level > 0").select(F.split("folder", "/").alias("parts"), "level")
    holding = (
        inner.select(F.inline(above(F.col("level") - 1, F.col("parts"))))
        .groupBy("folder")
        .agg(F.count(F.lit(1)).alias("folders"))
    )
    out = counted.join(holding, "folder", "left").select(
        "folder", "level", "files", F.coalesce("folders", F.lit(0)).cast("long").alias("folders"), "bytes"
    )
    return out if levels is None else out.where(F.col("level") <= levels)
