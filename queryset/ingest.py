"""Sheets, JSON APIs and files."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from queryset.base import fresh_db, fresh_path, table
from tableops.functions.scalars import normalize_name
from tableops.sources import api, files, paged, sheets

_PAGE_ROWS = 500
_LINKED_ROWS = 100
_CHAIN_PAGES = 8
#: Lines of a file at most; one that is read as one row has to fit in it.
_FILE_LINES = 4_000
_CUSTOMER = {
    "c_custkey": "bigint",
    "c_name": "string",
    "c_nationkey": "int",
    "c_acctbal": "double",
    "c_mktsegment": "string",
}


def _sheet_files(spark: SparkSession, sf_dir: str, query: str) -> str:
    """Customers as a sheet export with headers as people type them."""
    path = f"{fresh_path(spark, query)}/sheet"
    grid = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    files.write_delimited(grid.toDF(" Cust Key/ID ", "Name", "Market Segment"), path, ",")
    return path


def sheet_to_table(spark, sf_dir):
    path = _sheet_files(spark, sf_dir, "sheet_to_table")
    return sheets.sheet_to_table(spark, path, f"{fresh_db(spark, 'sheet_to_table')}.customer")


def sheet_to_csv(spark, sf_dir):
    path = _sheet_files(spark, sf_dir, "sheet_to_csv")
    sheets.sheet_to_files(spark, path, f"{path}_out")
    schema = "cust_key_id string, name string, market_segment string"
    return files.read_delimited(spark, f"{path}_out", schema)


def normalize_names(spark, sf_dir):
    typed = F.concat(F.lit(" "), "p_name", F.lit("/"), "p_brand", F.lit(" "))
    return table(spark, sf_dir, "part").select("p_partkey", normalize_name(typed).alias("name"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in lists of at most ``_PAGE_ROWS``, as an API pages them."""
    rows = F.sort_array(F.collect_list(F.struct(*_CUSTOMER))).alias("rows")
    page = F.floor(F.col("c_custkey") / _PAGE_ROWS)
    return table(spark, sf_dir, "customer").groupBy(page.alias("page")).agg(rows)


def _endpoints(bodies: DataFrame) -> DataFrame:
    """Endpoints that answer with the bodies: URLs that hold their own data."""
    encoded = F.base64(F.encode("body", "UTF-8"))
    return bodies.select(F.concat(F.lit("application/json;base64,"), encoded).alias("endpoint"))


def _record_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _endpoints(_pages(spark, sf_dir).select(F.to_json("rows").alias("body")))


def _element() -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in _CUSTOMER.items())


def api_records(spark, sf_dir):
    bodies = api.fetch(_record_endpoints(spark, sf_dir), "data:")
    return api.records(bodies, _element())


def api_columns(spark, sf_dir):
    lists = F.struct(*[F.col(f"rows.{c}").alias(c) for c in _CUSTOMER])
    endpoints = _endpoints(_pages(spark, sf_dir).select(F.to_json(lists).alias("body")))
    return api.columns(api.fetch(endpoints, "data:"), _CUSTOMER)


def api_to_table(spark, sf_dir):
    name = f"{fresh_db(spark, 'api_to_table')}.customer"
    return api.api_to_table(_record_endpoints(spark, sf_dir), name, _element(), base_url="data:")


def _linked_pages(spark: SparkSession, sf_dir: str, query: str) -> tuple[str, list[str]]:
    """Customers as files that link to one another, in chains of at most ``_CHAIN_PAGES`` pages.

    Tasks write the files under fixed names, so a task that runs again writes the same. The
    reader opens them by ``file:`` addresses, hence the shared folder has to be one.
    """
    folder = fresh_path(spark, query)
    if urlsplit(folder).scheme not in ("", "file"):
        raise ValueError("the pages of this query need a shared folder that is a file system's")
    plain = urlsplit(folder).path
    page = F.floor(F.col("c_custkey") / _LINKED_ROWS)
    rows = F.sort_array(F.collect_list(F.struct(*_CUSTOMER))).alias("data")
    pages = table(spark, sf_dir, "customer").groupBy(page.alias("page")).agg(rows)
    chain = F.floor(F.col("page") / _CHAIN_PAGES)
    in_chain = Window.partitionBy(chain).orderBy("page")
    linked = pages.select(
        "data",
        F.concat(F.lit("page-"), F.col("page").cast("string")).alias("file"),
        F.concat(F.lit("page-"), F.lead("page").over(in_chain).cast("string")).alias("next"),
        (F.row_number().over(in_chain) == 1).alias("first"),
    )
    body = F.to_json(
        F.struct(F.struct("data").alias("result"), F.struct("next").alias("links"))
    )

    def write(batches):
        import os

        os.makedirs(plain, exist_ok=True)
        for batch in batches:
            for name, text in zip(batch["file"], batch["body"], strict=True):
                with open(f"{plain}/{name}", "w", encoding="utf-8") as f:
                    f.write(text)
            yield batch[["file", "first"]]

    written = linked.select("file", "first", body.alias("body")).mapInPandas(
        write, "file string, first boolean"
    )
    # all are written; only the chains' first pages are named to the driver, as endpoints are
    return f"file://{plain}/", sorted(r.file for r in written.where("first").collect())


def api_pages(spark, sf_dir):
    """A task follows the links of each endpoint."""
    base, endpoints = _linked_pages(spark, sf_dir, "api_pages")
    pages = paged.read_pages(spark, endpoints, base, link="links.next")
    return api.records(pages, _element(), items="result.data")


def paged_to_table(spark, sf_dir):
    base, endpoints = _linked_pages(spark, sf_dir, "paged_to_table")
    name = f"{fresh_db(spark, 'paged_to_table')}.customer"
    return api.paged_to_table(
        spark, endpoints, name, _element(), "result.data", base_url=base, link="links.next"
    )


def text_scan(spark, sf_dir):
    path = f"{fresh_path(spark, 'text_scan')}/lines"
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")))
    files.write_records(lines, path)
    return files.read_lines(spark, path).withColumnRenamed("value", "line")


def delimited_records(spark, sf_dir):
    """Whole texts, which hold line breaks, between record separators."""
    path = f"{fresh_path(spark, 'delimited_records')}/records"
    files.write_records(table(spark, sf_dir, "documents").select("text"), path, "\x1e")
    return files.read_records(spark, path, "\x1e").withColumnRenamed("value", "text")


def json_file_scan(spark, sf_dir):
    path = f"{fresh_path(spark, 'json_file_scan')}/events"
    events = table(spark, sf_dir, "events")
    files.write_json(events, path)
    return files.read_json(spark, path, events.schema)


def _folders(spark, sf_dir, query):
    """The kinds of events, a line each, in files of bounded size: a folder per kind and block of ids.

    A block is written by one task and holds at most ``_FILE_LINES`` lines.
    """
    path = f"{fresh_path(spark, query)}/kinds"
    events = table(spark, sf_dir, "events")
    line = F.concat_ws(" ", F.col("event_id").cast("string"), F.col("user_id").cast("string"))
    block = F.floor(F.col("event_id") / _FILE_LINES).alias("block")
    kinds = events.select("event_type", block, line.alias("line"))
    kinds.repartition("event_type", "block").write.partitionBy("event_type", "block").text(path)
    return path


_KIND = r"/event_type=([^/]+)/"


def file_inventory(spark, sf_dir):
    """Files by folder and size; times of files are those of the run."""
    found = files.inventory(spark, _folders(spark, sf_dir, "file_inventory"))
    return found.select(
        F.regexp_extract("path", _KIND, 1).alias("kind"),
        F.regexp_extract("path", "/block=([0-9]+)/[^/]+$", 1).cast("long").alias("block"),
        F.col("length").alias("bytes"),
    )


def dir_sizes(spark, sf_dir):
    path = _folders(spark, sf_dir, "dir_sizes")
    return files.dir_sizes(files.inventory(spark, path), path)


def tree_sizes(spark, sf_dir):
    """Files, folders and bytes of every folder, whole tree first."""
    path = _folders(spark, sf_dir, "tree_sizes")
    return files.content_summary(files.inventory(spark, path), path)


def whole_text(spark, sf_dir):
    """Whole files of bounded size, one row each, and how many lines and characters a kind has."""
    whole = files.read_whole(spark, _folders(spark, sf_dir, "whole_text"))
    return (
        whole.select(
            F.regexp_extract("path", _KIND, 1).alias("kind"),
            F.regexp_count("value", F.lit("\n")).cast("long").alias("lines"),
            F.length("value").cast("long").alias("chars"),
        )
        .groupBy("kind")
        .agg(F.sum("lines").alias("lines"), F.sum("chars").alias("chars"))
    )


QUERIES = {
    "sheet_to_table": sheet_to_table,
    "sheet_to_csv": sheet_to_csv,
    "normalize_names": normalize_names,
    "api_records": api_records,
    "api_columns": api_columns,
    "api_to_table": api_to_table,
    "api_pages": api_pages,
    "paged_to_table": paged_to_table,
    "text_scan": text_scan,
    "delimited_records": delimited_records,
    "json_file_scan": json_file_scan,
    "file_inventory": file_inventory,
    "dir_sizes": dir_sizes,
    "tree_sizes": tree_sizes,
    "whole_text": whole_text,
}

_SHEET = """SELECT CAST(c_custkey AS VARCHAR) AS cust_key_id, c_name AS name,
  c_mktsegment AS market_segment FROM customer"""

_BLOCKS = f"""SELECT event_type AS kind, event_id // {_FILE_LINES} AS block, count(*) AS lines,
  CAST(sum(strlen(event_id || ' ' || user_id) + 1) AS BIGINT) AS bytes FROM events GROUP BY ALL"""

ORACLE = {
    "sheet_to_table": _SHEET,
    "sheet_to_csv": _SHEET,
    "normalize_names": """SELECT p_partkey,
  replace(replace(lower(trim(' ' || p_name || '/' || p_brand || ' ')), ' ', '_'), '/', '_') AS name
FROM part""",
    "api_records": "SELECT * FROM customer",
    "api_columns": "SELECT * FROM customer",
    "api_to_table": "SELECT * FROM customer",
    "api_pages": "SELECT * FROM customer",
    "paged_to_table": "SELECT * FROM customer",
    "text_scan": "SELECT unnest(string_split(text, chr(10))) AS line FROM documents",
    "delimited_records": "SELECT text FROM documents",
    "json_file_scan": "SELECT * FROM events",
    "file_inventory": f"SELECT kind, block, bytes FROM ({_BLOCKS})",
    "dir_sizes": f"""SELECT 'event_type=' || kind AS name, CAST(sum(bytes) AS BIGINT) AS bytes,
  count(*) AS files, CAST(floor(sum(bytes) / 1073741824) AS BIGINT) AS gb FROM ({_BLOCKS}) GROUP BY kind""",
    "tree_sizes": f"""WITH b AS ({_BLOCKS})
SELECT '' AS folder, 0 AS level, count(*) AS files, count(*) + count(DISTINCT kind) AS folders,
  CAST(sum(bytes) AS BIGINT) AS bytes FROM b
UNION ALL SELECT 'event_type=' || kind, 1, count(*), count(*), CAST(sum(bytes) AS BIGINT) FROM b GROUP BY kind
UNION ALL SELECT 'event_type=' || kind || '/block=' || block, 2, 1, 0, bytes FROM b""",
    "whole_text": f"""SELECT kind, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(bytes) AS BIGINT) AS chars
FROM ({_BLOCKS}) GROUP BY kind""",
}
