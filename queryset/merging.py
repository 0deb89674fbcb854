"""Latest row per key, watermarks, unions, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queryset.base import TABLES, table
from tableops.functions.scalars import json_value, url_host, url_segment
from tableops.operators import merge

_TS = "timestamp_ntz"


def _at(text: str):
    return F.lit(text).cast(_TS)


def events_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A base up to one day, and changed rows that begin some days before it ends."""
    events = table(spark, sf_dir, "events")
    base = events.where(F.col("ts") < _at("2024-01-20"))
    delta = events.where(F.col("ts") >= _at("2024-01-15")).withColumn("value", F.col("value") * 2)
    return base, delta


def lineitem_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "lineitem")
    cut = _at("1999-01-01")
    return rows.where(F.col("l_shipdate") < cut), rows.where(F.col("l_shipdate") >= cut)


def merge_latest(spark, sf_dir):
    return merge.merge_latest(*events_sides(spark, sf_dir), ["event_id"], "ts")


def merge_latest_join(spark, sf_dir):
    """Users' latest events; those of early days have no time and count where there is no other."""
    sides = [
        side.withColumn("ts", F.when(F.col("ts") >= _at("2024-01-18"), F.col("ts")))
        for side in events_sides(spark, sf_dir)
    ]
    return merge.merge_latest(*sides, ["user_id"], "ts", form="join", keep_null_ts=True)


def merge_latest_window(spark, sf_dir):
    return merge.merge_latest(*events_sides(spark, sf_dir), ["event_id"], "ts", form="window")


def merge_latest_one(spark, sf_dir):
    return merge.merge_latest(*events_sides(spark, sf_dir), ["event_id"], "ts", ties="one")


def merge_latest_composite(spark, sf_dir):
    sides = lineitem_sides(spark, sf_dir)
    return merge.merge_latest(*sides, ["l_orderkey", "l_linenumber"], "l_shipdate")


def merge_latest_user(spark, sf_dir):
    return merge.merge_latest(*events_sides(spark, sf_dir), ["user_id"], "ts")


def upsert_newer(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    cut = _at("2024-01-20")
    base = merge.latest_rows(events.where(F.col("ts") < cut), ["user_id"], "ts", "one")
    delta = events.where(F.col("ts") >= cut)
    return merge.upsert_newer(base, delta, ["user_id"], "ts")


def latest_per_key(spark, sf_dir):
    return merge.latest_per_key(table(spark, sf_dir, "events"), ["user_id"], "ts")


def high_watermark(spark, sf_dir):
    """The watermark of times, and of times kept as text."""
    orders = table(spark, sf_dir, "orders").select("o_orderdate")
    text = F.when(F.col("o_orderdate") < _at("1996-01-01"), "no time").otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    )
    as_text = merge.watermark(orders.withColumn("o_orderdate", text), "o_orderdate")
    events = merge.watermark(table(spark, sf_dir, "events"), "ts")
    return merge.union_all(
        events.select(F.lit("events").alias("source"), "watermark_text"),
        as_text.select(F.lit("orders").alias("source"), "watermark_text"),
    )


def union_all(spark, sf_dir):
    return merge.union_all(*events_sides(spark, sf_dir), by_position=True)


def row_counts(spark, sf_dir):
    return merge.row_counts({name: table(spark, sf_dir, name) for name in TABLES})


def empty_guard(spark, sf_dir):
    """Whether a source has rows, for a filter that nothing passes and for none."""
    events = table(spark, sf_dir, "events")
    found = [
        ("impossible", merge.is_empty(events.where("value < 0 AND value > 0"))),
        ("all", merge.is_empty(events)),
    ]
    return spark.createDataFrame(found, "source string, is_empty boolean")


def filter_before_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")
    customer = table(spark, sf_dir, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        "o_orderkey", "o_totalprice", "c_name", "c_mktsegment"
    )


def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", json_value(F.col("props"), "$.k").alias("k")
    )


def url_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", url_host(url).alias("host"), url_segment(url, -2).alias("segment")
    )


_SIDES = """
  base AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-20'),
  delta AS (SELECT event_id, ts, user_id, event_type, value * 2 AS value, props
            FROM events WHERE ts >= TIMESTAMP '2024-01-15'),
  u AS (SELECT * FROM base UNION ALL SELECT * FROM delta)"""

_COLUMNS = "event_id, ts, user_id, event_type, value, props"

_MERGED = f"""WITH {_SIDES},
  r AS (SELECT *, rank() OVER (PARTITION BY event_id ORDER BY ts DESC) AS place FROM u)
SELECT {_COLUMNS} FROM r WHERE place = 1"""

_MERGED_USER = f"""WITH {_SIDES},
  r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY ts DESC) AS place FROM u)
SELECT {_COLUMNS} FROM r WHERE place = 1"""

_MERGED_NULLS = f"""WITH {_SIDES},
  v AS (SELECT * REPLACE (CASE WHEN ts >= TIMESTAMP '2024-01-18' THEN ts END AS ts) FROM u),
  r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST) AS place FROM v)
SELECT {_COLUMNS} FROM r WHERE place = 1"""

QUERIES = {
    "merge_latest": merge_latest,
    "merge_latest_join": merge_latest_join,
    "merge_latest_window": merge_latest_window,
    "merge_latest_one": merge_latest_one,
    "merge_latest_composite": merge_latest_composite,
    "merge_latest_user": merge_latest_user,
    "upsert_newer": upsert_newer,
    "latest_per_key": latest_per_key,
    "high_watermark": high_watermark,
    "union_all": union_all,
    "row_counts": row_counts,
    "empty_guard": empty_guard,
    "filter_before_join": filter_before_join,
    "json_extract": json_extract,
    "url_parts": url_parts,
}

ORACLE = {
    "merge_latest": _MERGED,
    "merge_latest_join": _MERGED_NULLS,
    "merge_latest_window": _MERGED,
    "merge_latest_user": _MERGED_USER,
    "merge_latest_one": f"""WITH {_SIDES.replace("base AS (SELECT *", "base AS (SELECT *, 0 AS side")
        .replace("value * 2 AS value, props", "value * 2 AS value, props, 1 AS side")},
  r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts DESC, side DESC,
        user_id DESC, event_type DESC, value DESC, props DESC) AS rn FROM u)
SELECT event_id, ts, user_id, event_type, value, props FROM r WHERE rn = 1""",
    "merge_latest_composite": """WITH s AS (
  SELECT l_orderkey, l_linenumber, max(l_shipdate) AS l_shipdate
  FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT l.* FROM lineitem l JOIN s ON s.l_orderkey = l.l_orderkey
 AND s.l_linenumber = l.l_linenumber AND s.l_shipdate = l.l_shipdate""",
    "upsert_newer": """SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1""",
    "latest_per_key": "SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id",
    "high_watermark": """
SELECT 'events' AS source, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS watermark_text FROM events
UNION ALL
SELECT 'orders', strftime(max(TRY_CAST(CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'no time'
  ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S')
FROM orders""",
    "union_all": f"WITH {_SIDES} SELECT * FROM u",
    "row_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS tablename, count(*) AS row_count FROM {t}" for t in TABLES
    ),
    "empty_guard": """
SELECT 'impossible' AS source, count(*) = 0 AS is_empty FROM events WHERE value < 0 AND value > 0
UNION ALL SELECT 'all', count(*) = 0 FROM events""",
    "filter_before_join": """
SELECT o_orderkey, o_totalprice, c_name, c_mktsegment
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'""",
    "json_extract": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "url_parts": """SELECT page_id,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) AS host,
  CASE WHEN len(string_split(url, '/')) >= 2 THEN string_split(url, '/')[-2] END AS segment
FROM pages""",
}
