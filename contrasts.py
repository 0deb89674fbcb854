"""Time the choices this library makes against their alternatives.

Prints one line per contrast for the tables in ``BENCH_SF_DIR``; the numbers in
runs once to warm up, and the median of the runs after that is printed.
"""

from __future__ import annotations

import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from queryset import merging, replication  # noqa: E402
from queryset.base import fresh_db, fresh_path, table  # noqa: E402
from tableops.operators import merge, tables  # noqa: E402
from tableops.sources import jdbc  # noqa: E402
from tableops.streaming import upsert  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(name: str, action, runs: int = 3) -> None:
    taken = []
    for _ in range(runs + 1):
        begin = time.perf_counter()
        action()
        taken.append(time.perf_counter() - begin)
    print(f"{name:46s} {statistics.median(taken[1:]):7.2f} s", flush=True)


def by_max(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """One row per key by an aggregate over whole rows, for comparison."""
    rest = [c for c in df.columns if c not in (*keys, ts)]
    top = df.groupBy(*keys).agg(F.max(F.struct(ts, *rest)).alias("row"))
    return top.select(*keys, "row.*")


def merges(spark: SparkSession) -> None:
    for name, sides, keys, ts in (
        ("events", merging.events_sides, ["event_id"], "ts"),
        ("lineitem", merging.lineitem_sides, ["l_orderkey", "l_linenumber"], "l_shipdate"),
    ):
        rows = merge.union_all(*sides(spark, SF_DIR))
        for ties, form in (("all", "join"), ("all", "window"), ("one", "window")):
            timed(
                f"latest rows, {name}, ties={ties}, {form}",
                lambda: run(merge.latest_rows(rows, keys, ts, ties, form)),  # noqa: B023
            )
        timed(f"latest rows, {name}, max of structs", lambda: run(by_max(rows, keys, ts)))  # noqa: B023


def upserts(spark: SparkSession) -> None:
    """A merged base and a changed share of its keys, written as a new table."""
    db = fresh_db(spark, "contrast")
    orders = table(spark, SF_DIR, "orders")
    newer = orders.withColumn("o_orderdate", F.col("o_orderdate") + F.expr("INTERVAL 10 YEARS"))
    key, ts = ["o_orderkey"], "o_orderdate"
    base = tables.create_table(orders.repartition(8, *key), f"{db}.base", key, 8)
    timed("write all rows", lambda: tables.overwrite_table(orders, f"{db}.out"))
    for percent in (1, 10, 100):
        delta = newer.where(F.pmod(F.hash("o_orderkey"), F.lit(100)) < percent)
        for name, rows in (
            ("ranked again", lambda: merge.merge_latest(base, delta, key, ts, "one")),  # noqa: B023
            ("keys replaced", lambda: merge.upsert_newer(base, delta, key, ts)),  # noqa: B023
            ("keys replaced, buckets", lambda: merge.upsert_newer(base, delta, key, ts, 8)),  # noqa: B023
        ):
            timed(
                f"{percent}% changed, {name}",
                lambda: tables.overwrite_table(rows(), f"{db}.out"),  # noqa: B023
            )


def large(spark: SparkSession, n: int = 10_000_000) -> None:
    """The merge plans on generated rows, where plans outweigh the cost of a job."""
    db = fresh_db(spark, "contrast_large")

    def generated(shift: int) -> DataFrame:
        return spark.range(0, n, 1, 16).select(
            F.col("id").alias("k"),
            F.timestamp_seconds(F.col("id") + shift).cast("timestamp_ntz").alias("ts"),
            F.sha2(F.col("id").cast("string"), 256).alias("v"),
        )

    key, ts = ["k"], "ts"
    base = tables.create_table(generated(0), f"{db}.base")
    placed = tables.create_table(generated(0).repartition(16, "k"), f"{db}.placed", key, 16)
    for percent in (1, 10, 100):
        changed = generated(n).where(F.pmod(F.hash("k"), F.lit(100)) < percent)
        delta = tables.create_table(changed, f"{db}.delta_{percent}")
        for name, rows in (
            ("ranked again", lambda: merge.merge_latest(base, delta, key, ts, "one")),  # noqa: B023
            ("keys replaced", lambda: merge.upsert_newer(base, delta, key, ts)),  # noqa: B023
            ("keys replaced, buckets", lambda: merge.upsert_newer(placed, delta, key, ts, 16)),  # noqa: B023
        ):
            timed(f"large, {percent}% changed, {name}", lambda: run(rows()), runs=2)  # noqa: B023
    hot = F.col("k") % 3 == 0
    tied = base.select(
        F.when(hot, -1).otherwise(F.col("k")).alias("k"),
        F.when(hot, F.lit("2050-01-01").cast("timestamp_ntz")).otherwise(F.col("ts")).alias("ts"),
        "v",
    )
    for name, rows in (("no ties", base), ("a third tied", tied)):
        for form in ("join", "window"):
            timed(
                f"large, all ties, {name}, {form}",
                lambda: run(merge.latest_rows(rows, key, ts, "all", form)),  # noqa: B023
                runs=2,
            )


def reads(spark: SparkSession) -> None:
    source = replication.orders_source(spark, SF_DIR)
    timed("source scan, one task", lambda: run(jdbc.scan(spark, source, "orders")))
    timed(
        "source scan, ranges",
        lambda: run(jdbc.scan(spark, source, "orders", split_on="o_orderkey")),
    )


def streams(spark: SparkSession) -> None:
    events = table(spark, SF_DIR, "events")
    place = fresh_path(spark, "contrast_stream")
    events.repartition(8).write.parquet(f"{place}/in")
    for files in (1, 8):
        number = iter(range(100))

        def once():
            out = f"{place}/out{files}_{next(number)}"  # noqa: B023
            changes = (
                spark.readStream.schema(events.schema)
                .option("maxFilesPerTrigger", files)  # noqa: B023
                .parquet(f"{place}/in")
            )
            upsert.stream_merge_latest(
                changes, f"{out}/t", ["user_id"], "ts", f"{out}/c"
            ).awaitTermination()
            run(upsert.read_target(spark, f"{out}/t", ["user_id"], "ts"))

        timed(f"stream of 8 files, {files} per batch", once, runs=2)


if __name__ == "__main__":
    session = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    parts = (merges, upserts, reads, streams, large)
    for part in parts:
        if not sys.argv[1:] or part.__name__ in sys.argv[1:]:
            part(session)
    session.stop()
