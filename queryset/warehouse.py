"""Table maintenance and SQL models."""

from __future__ import annotations

from pyspark.sql import functions as F

from queryset.base import fresh_db, table
from tableops.operators import tables
from tableops.plans.models import Model, adhoc_query, refresh_models, run_statements


def ctas_create(spark, sf_dir):
    db = fresh_db(spark, "ctas_create")
    return tables.create_table(table(spark, sf_dir, "customer"), f"{db}.customer")


def ctas_overwrite(spark, sf_dir):
    """A table of suppliers, replaced by customers, then by part of itself."""
    name = f"{fresh_db(spark, 'ctas_overwrite')}.t"
    tables.create_table(table(spark, sf_dir, "supplier"), name)
    tables.overwrite_table(table(spark, sf_dir, "customer"), name)
    return tables.overwrite_table(spark.table(name).where("c_acctbal > 0"), name)


def table_rename(spark, sf_dir):
    db = fresh_db(spark, "table_rename")
    tables.create_table(table(spark, sf_dir, "customer"), f"{db}.reconcile")
    tables.rename_table(spark, f"{db}.reconcile", f"{db}.base")
    return spark.table(f"{db}.base")


def add_column(spark, sf_dir):
    name = f"{fresh_db(spark, 'add_column')}.customer"
    tables.create_table(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), name)
    return tables.add_column(spark, name, "remark", "string")


def keep_columns(spark, sf_dir):
    name = f"{fresh_db(spark, 'keep_columns')}.customer"
    tables.create_table(table(spark, sf_dir, "customer"), name)
    return tables.keep_columns(spark, name, ["c_custkey", "c_mktsegment"])


def table_exists(spark, sf_dir):
    """A table that is there, one that was dropped and one that never was."""
    db = fresh_db(spark, "table_exists")
    customer = table(spark, sf_dir, "customer")
    for name in ("kept", "dropped"):
        tables.create_table(customer, f"{db}.{name}")
    tables.drop_table(spark, f"{db}.dropped", purge=True)
    names = ("kept", "dropped", "never")
    found = [(n, tables.table_exists(spark, f"{db}.{n}")) for n in names]
    flags = spark.createDataFrame(found, "name string, found boolean")
    rows = spark.table(f"{db}.kept").agg(
        F.lit("kept").alias("name"), F.count(F.lit(1)).alias("row_count")
    )
    return flags.join(rows, "name", "left")


def typed_table(spark, sf_dir):
    name = f"{fresh_db(spark, 'typed_table')}.test"
    tables.create_empty_table(spark, name, "id int, notes string")
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("int").alias("id"), F.col("c_name").alias("notes")
    )
    return tables.append_rows(rows, name)


def partition_overwrite(spark, sf_dir):
    """Events by day; one day is written again with doubled values."""
    name = f"{fresh_db(spark, 'partition_overwrite')}.events"
    events = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    tables.create_partitioned(events, name, "day")
    again = events.where("day = DATE '2024-01-15'").withColumn("value", F.col("value") * 2)
    return tables.overwrite_partitions(again, name, "day")


_TEST = Model("test", "SELECT CAST(c_custkey AS INT) AS id, c_name AS notes FROM {customer}",
              ("customer",))
_TEST_MASTER = Model("test_master", "SELECT * FROM {test}", ("test",))
_ORDER_DAYS = Model(
    "order_days",
    "SELECT CAST(o_orderdate AS DATE) AS day, o_custkey, "
    "CAST(o_totalprice AS DECIMAL(18, 2)) AS price FROM {orders}",
    ("orders",),
)
_CUSTOMER_ORDERS = Model(
    "customer_orders",
    "SELECT o_custkey, count(*) AS orders, sum(price) AS spent, max(day) AS last_day "
    "FROM {order_days} GROUP BY o_custkey",
    ("order_days",),
)
_NAMED = Model(
    "named_orders",
    "SELECT id, notes, orders, CAST(spent AS DOUBLE) AS spent, last_day "
    "FROM {test_master} JOIN {customer_orders} ON id = o_custkey",
    ("test_master", "customer_orders"),
)


def _sources(spark, sf_dir):
    return {t: table(spark, sf_dir, t) for t in ("customer", "orders")}


def model_refresh(spark, sf_dir):
    db = fresh_db(spark, "model_refresh")
    models = [_NAMED, _CUSTOMER_ORDERS, _TEST_MASTER, _ORDER_DAYS, _TEST]
    refresh_models(spark, models, db, _sources(spark, sf_dir))
    return spark.table(f"{db}.named_orders")


def model_refresh_optional(spark, sf_dir):
    """An optional model that fails, one that needs it, and two that do not."""
    db = fresh_db(spark, "model_refresh_optional")
    broken = Model("broken", "SELECT no_such_column FROM {customer}", ("customer",), True)
    needs = Model("needs_broken", "SELECT * FROM {broken}", ("broken",), True)
    report = refresh_models(
        spark, [needs, broken, _TEST_MASTER, _TEST], db, _sources(spark, sf_dir)
    )
    built = spark.table(f"{db}.test_master").agg(
        F.lit("test_master").alias("model"), F.count(F.lit(1)).alias("row_count")
    )
    return report.select("model", "status").join(built, "model", "left")


def sql_statements(spark, sf_dir):
    db = fresh_db(spark, "sql_statements")
    return run_statements(
        spark,
        [
            "-- customers by segment",
            f"CREATE TABLE {db}.segments (segment STRING, customers BIGINT) USING parquet",
            "",
            f"INSERT INTO {db}.segments SELECT c_mktsegment, count(*) "
            f"FROM parquet.`{sf_dir}/customer.parquet` GROUP BY c_mktsegment",
            f"SELECT segment, customers, ';' AS mark FROM {db}.segments",
        ],
    )


def adhoc(spark, sf_dir):
    return adhoc_query(
        spark,
        "SELECT o_orderpriority, count(*) AS orders, max(o_orderdate) AS last_order "
        f"FROM parquet.`{sf_dir}/orders.parquet` GROUP BY o_orderpriority",
    )


QUERIES = {
    "ctas_create": ctas_create,
    "ctas_overwrite": ctas_overwrite,
    "table_rename": table_rename,
    "add_column": add_column,
    "keep_columns": keep_columns,
    "table_exists": table_exists,
    "typed_table": typed_table,
    "partition_overwrite": partition_overwrite,
    "model_refresh": model_refresh,
    "model_refresh_optional": model_refresh_optional,
    "sql_statements": sql_statements,
    "adhoc_query": adhoc,
}

ORACLE = {
    "ctas_create": "SELECT * FROM customer",
    "ctas_overwrite": "SELECT * FROM customer WHERE c_acctbal > 0",
    "table_rename": "SELECT * FROM customer",
    "add_column": "SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS remark FROM customer",
    "keep_columns": "SELECT c_custkey, c_mktsegment FROM customer",
    "table_exists": """SELECT 'kept' AS name, true AS found, count(*) AS row_count FROM customer
UNION ALL SELECT 'dropped', false, NULL UNION ALL SELECT 'never', false, NULL""",
    "typed_table": "SELECT CAST(c_custkey AS INTEGER) AS id, c_name AS notes FROM customer",
    "partition_overwrite": """SELECT event_id, ts, user_id, event_type,
  CASE WHEN CAST(ts AS DATE) = DATE '2024-01-15' THEN value * 2 ELSE value END AS value,
  props, CAST(ts AS DATE) AS day FROM events""",
    "model_refresh": """SELECT CAST(c_custkey AS INTEGER) AS id, c_name AS notes,
  count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS spent,
  max(CAST(o_orderdate AS DATE)) AS last_day
FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name""",
    "model_refresh_optional": """SELECT 'test' AS model, 'built' AS status, NULL AS row_count
UNION ALL SELECT 'test_master', 'built', count(*) FROM customer
UNION ALL SELECT 'broken', 'failed', NULL UNION ALL SELECT 'needs_broken', 'skipped', NULL""",
    "sql_statements": """SELECT c_mktsegment AS segment, count(*) AS customers, ';' AS mark
FROM customer GROUP BY c_mktsegment""",
    "adhoc_query": """SELECT o_orderpriority, count(*) AS orders, max(o_orderdate) AS last_order
FROM orders GROUP BY o_orderpriority""",
}
