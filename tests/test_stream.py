from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tableops.operators.merge import latest_rows
from tableops.session import path_exists
from tableops.streaming import upsert

SCHEMA = "k int, ts timestamp_ntz, v string"
T = [datetime(2024, 1, d) for d in range(1, 9)]
BATCHES = [
    [(1, T[0], "a"), (1, T[1], "b"), (2, T[3], "c"), (None, T[0], "x"), (9, None, "x")],
    [(1, T[1], "tie"), (2, T[2], "late"), (3, T[0], "d")],
    [(3, T[5], "e"), (4, T[0], "f")],
    [(1, T[7], "g")],
]
WANT = [(1, T[7], "g"), (2, T[3], "c"), (3, T[5], "e"), (4, T[0], "f")]


def values(df):
    return sorted(tuple(r) for r in df.collect())


def run(spark, place, **options):
    changes = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    upsert.stream_merge_latest(
        changes, f"{place}/target", ["k"], "ts", f"{place}/checkpoint", **options
    ).awaitTermination()
    return upsert.read_target(spark, f"{place}/target", ["k"], "ts")


def put(spark, place, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{place}/in")


def test_batches_merge_and_the_later_one_wins_a_tie(spark, tmp_path):
    put(spark, tmp_path, BATCHES[0])
    assert values(run(spark, tmp_path)) == [(1, T[1], "b"), (2, T[3], "c")]
    put(spark, tmp_path, BATCHES[1])
    assert values(run(spark, tmp_path)) == [(1, T[1], "tie"), (2, T[3], "c"), (3, T[0], "d")]
    for rows in BATCHES[2:]:
        put(spark, tmp_path, rows)
    assert values(run(spark, tmp_path)) == WANT


def test_compaction_and_a_batch_that_is_run_again(spark, tmp_path):
    for rows in BATCHES:
        put(spark, tmp_path, rows)
        out = run(spark, tmp_path, compact_every=1)
    assert values(out) == WANT
    target = f"{tmp_path}/target"
    base, batches = upsert._state(spark, target)
    assert (base, batches) == (3, [])
    assert path_exists(spark, f"{target}/base/through=2")
    assert not path_exists(spark, f"{target}/base/through=1")
    assert upsert.compact(spark, target, ["k"], "ts") == 3
    # A batch cut off half way has no _SUCCESS and is not read; run again, it is.
    again = spark.createDataFrame([(4, T[6], "h")], SCHEMA)
    again.write.parquet(f"{target}/delta/batch=4")
    (tmp_path / "target" / "delta" / "batch=4" / "_SUCCESS").unlink()
    assert values(upsert.read_target(spark, target, ["k"], "ts")) == WANT
    for _ in range(2):
        again.write.mode("overwrite").parquet(f"{target}/delta/batch=4")
        got = values(upsert.read_target(spark, target, ["k"], "ts"))
        assert got == WANT[:3] + [(4, T[6], "h")]


def test_stream_equals_batch_merge(spark, tmp_path):
    data = spark.range(2000).select(
        (F.col("id") % 37).cast("int").alias("k"),
        F.timestamp_seconds(F.hash("id") % 1000).cast("timestamp_ntz").alias("ts"),
        F.col("id").cast("string").alias("v"),
    )
    data.repartition(5).write.parquet(f"{tmp_path}/in")
    got = run(spark, tmp_path, compact_every=2).select("k", "ts")
    assert values(got) == values(latest_rows(data, ["k"], "ts", "one").select("k", "ts"))


@pytest.mark.parametrize("compacted", [False, True])
def test_a_new_checkpoint_adds_to_the_target(spark, tmp_path, compacted):
    for rows in BATCHES[:2]:
        put(spark, tmp_path, rows)
    before = values(run(spark, tmp_path))
    if compacted:
        upsert.compact(spark, f"{tmp_path}/target", ["k"], "ts")
    (tmp_path / "checkpoint").rename(tmp_path / "old-checkpoint")
    (tmp_path / "in").rename(tmp_path / "old-in")
    for rows in BATCHES[2:]:
        put(spark, tmp_path, rows)
    assert before != WANT
    assert values(run(spark, tmp_path)) == WANT


def test_small_batches_leave_the_base_where_it_is(spark, tmp_path):
    put(spark, tmp_path, [(i, T[0], "x" * 50) for i in range(5000)])
    run(spark, tmp_path, compact_every=1)
    upsert.compact(spark, f"{tmp_path}/target", ["k"], "ts")
    put(spark, tmp_path, [(1, T[1], "new"), (6000, T[1], "new")])
    out = run(spark, tmp_path)
    assert out.count() == 5001
    plan = out._jdf.queryExecution().executedPlan().toString()
    above_base = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert not above_base


def test_a_growing_source_table_as_a_stream(spark, db, tmp_path):
    """Two restarts, the second under a new checkpoint, while rows are added and changed."""
    import time
    import uuid

    from tableops.operators.merge import content_summary
    from tableops.sources import jdbc
    from tableops.streaming.replicate import stream_replicate

    source = jdbc.JdbcSource(
        f"jdbc:derby:memory:s{uuid.uuid4().hex};create=true", driver="org.apache.derby.jdbc.EmbeddedDriver"
    )
    schema, kept = "id long, updated_at timestamp_ntz, status string", {}

    def add(rows):
        kept.update({r[0]: r for r in rows})
        spark.createDataFrame(rows, schema).write.format("jdbc").options(**source.properties()).option(
            "url", source.url
        ).option("dbtable", "orders").option("createTableColumnTypes", "status VARCHAR(9)").mode("append").save()

    def until(query, want):
        for _ in range(240):
            if not query.isActive:
                raise query.exception()
            if spark.catalog.tableExists(f"{db}.orders"):
                try:
                    if values(spark.table(f"{db}.orders")) == sorted(want.values()):
                        return
                except Exception:  # between two renames
                    pass
            time.sleep(0.5)
        raise AssertionError("not up to date in time")

    add([(i, T[0], "a") for i in range(5)])
    for run, checkpoint in enumerate(("one", "one", "two")):
        query = stream_replicate(
            spark, source, "orders", db, ["id"], "updated_at", f"{tmp_path}/{checkpoint}", "1 second"
        )
        try:
            until(query, kept)
            add([(i, T[1 + 2 * run], "b") for i in (run, 10 + run)])
            until(query, kept)
        finally:
            query.stop()
        add([(i, T[2 + 2 * run], "c") for i in (run, 20 + run)])
    from tableops.plans.replicate import incremental_replicate

    out = incremental_replicate(spark, source, "orders", db, ["id"], "updated_at")
    plain = latest_rows(jdbc.scan(spark, source, "orders"), ["id"], "updated_at", "one")
    assert content_summary(out) == content_summary(plain.select(*out.columns))
