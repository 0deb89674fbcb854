"""Spreadsheet grids exported as delimited files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableops.functions.scalars import normalized_names
from tableops.operators.tables import create_table, overwrite_table
from tableops.sources.files import write_delimited


def _files(spark: SparkSession, path: str) -> list[str]:
    """The files of a folder with data, in order of their names; or the one file."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rows = found.where("length > 0").select("path").orderBy("path").collect()
    return [r["path"] for r in rows]


def read_sheet(
    spark: SparkSession, path: str, delimiter: str = ",", multiline: bool = True
) -> DataFrame:
    """The grid as a table of text columns.

    The first row of each file is its header, and its cells become the column
    names after clean-up. Files of a folder may have their columns in another order;
    other columns are an error. A row wider than the header is an error too, when it
    is read, unless its cells beyond are blank and no more than ``_SPARE``; the missing cells of a shorter one are empty text, as blank cells are.
    Rows that repeat the cleaned header are no data.

    Sheets are few: their headers are read one after the other on the driver, and
    files with one header together. ``multiline`` as in ``read_delimited``.
    """

    def reader():
        return (
            spark.read.option("inferSchema", False)
            .option("delimiter", delimiter)
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .option("multiLine", multiline)
        )

    by_header: dict[tuple[str, ...], list[str]] = {}
    for file in _files(spark, path):
        header = reader().option("header", True).csv(file).columns
        by_header.setdefault(tuple(normalized_names(header)), []).append(file)
    if not by_header:
        raise ValueError(f"no sheet with a header in {path}")
    names = next(iter(by_header))
    for other in by_header:
        if sorted(other) != sorted(names):
            raise ValueError(f"headers differ: {list(names)} and {list(other)}")
    return reduce(
        DataFrame.unionByName,
        [_grid(reader(), files, header) for header, files in by_header.items()],
    ).select(*[f"`{n}`" for n in names])


#: Cells beyond the header a row may have if they are blank. More stop the parser.
_SPARE = 8


def _grid(reader: DataFrameReader, files: list[str], header: tuple[str, ...]) -> DataFrame:
    """Files under one cleaned header."""
    spare = [f"__beyond_{i}" for i in range(_SPARE)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*header, *spare)])
    rows = reader.schema(schema).option("header", True).option("maxColumns", len(schema)).csv(files)
    too_many = F.raise_error(F.lit(f"a row is wider than the header {list(header)}"))
    fits = F.when(F.coalesce(*spare).isNull(), F.lit(True)).otherwise(too_many.cast("boolean"))
    df = rows.where(fits).select(*[F.col(f"`{n}`") for n in header]).fillna("")
    repeated = reduce(lambda a, b: a & b, [F.col(f"`{n}`") == F.lit(n) for n in header])
    return df.where(~repeated)


def sheet_to_table(
    spark: SparkSession, path: str, name: str, overwrite: bool = True, **reading
) -> DataFrame:
    """The grid as warehouse table ``name``."""
    write = overwrite_table if overwrite else create_table
    return write(read_sheet(spark, path, **reading), name)


def sheet_to_files(
    spark: SparkSession, path: str, out: str, out_delimiter: str = "|", **reading
) -> None:
    """The grid as delimited files under clean column names."""
    write_delimited(read_sheet(spark, path, **reading), out, out_delimiter)
