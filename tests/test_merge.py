from datetime import datetime
from itertools import product

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tableops.operators import merge

T = [datetime(2024, 1, d) for d in range(1, 6)]
SCHEMA = "k int, ts timestamp_ntz, v string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


BASE = [(1, T[0], "old"), (2, T[1], "kept"), (3, T[1], "tie"), (4, T[0], "both"), (None, T[4], "x"),
        (5, None, "no time")]
DELTA = [(1, T[2], "new"), (3, T[1], "tie too"), (4, T[0], "both"), (6, T[0], "added"),
         (7, None, "no time")]


@pytest.mark.parametrize("form", ["join", "window"])
def test_all_ties_stay_and_a_row_in_both_inputs_counts_twice(spark, form):
    out = merge.merge_latest(frame(spark, BASE), frame(spark, DELTA), ["k"], "ts", form=form)
    assert rows(out) == sorted(
        [(1, T[2], "new"), (2, T[1], "kept"), (3, T[1], "tie"), (3, T[1], "tie too"),
         (4, T[0], "both"), (4, T[0], "both"), (6, T[0], "added")],
        key=str,
    )


def test_one_row_per_key_and_delta_wins_a_tie(spark):
    out = merge.merge_latest(frame(spark, BASE), frame(spark, DELTA), ["k"], "ts", ties="one")
    assert rows(out) == sorted(
        [(1, T[2], "new"), (2, T[1], "kept"), (3, T[1], "tie too"), (4, T[0], "both"),
         (6, T[0], "added")],
        key=str,
    )


@pytest.mark.parametrize(("ties", "form"), [("all", "join"), ("all", "window"), ("one", None)])
def test_keep_null_ts(spark, ties, form):
    out = merge.merge_latest(
        frame(spark, BASE), frame(spark, DELTA), ["k"], "ts", ties, form, keep_null_ts=True
    )
    got = rows(out.where("ts IS NULL"))
    assert got == [(5, None, "no time"), (7, None, "no time")]
    assert out.where("k IS NULL").isEmpty()
    # A key with a time does not keep its rows without one.
    mixed = frame(spark, [(1, None, "a"), (1, T[0], "b")])
    out = merge.latest_rows(mixed, ["k"], "ts", ties, form, keep_null_ts=True)
    assert rows(out) == [(1, T[0], "b")]


@pytest.mark.parametrize(("ties", "form"), [("all", "join"), ("all", "window"), ("one", None)])
def test_composite_key(spark, ties, form):
    schema = "a int, b int, ts timestamp_ntz, v string"
    base = frame(spark, [(1, 1, T[0], "x"), (1, 2, T[3], "y")], schema)
    delta = frame(spark, [(1, 1, T[1], "z"), (1, 2, T[1], "late")], schema)
    out = merge.merge_latest(base, delta, ["a", "b"], "ts", ties, form)
    assert rows(out) == [(1, 1, T[1], "z"), (1, 2, T[3], "y")]


@pytest.mark.parametrize(("ties", "form"), [("all", "join"), ("all", "window"), ("one", None)])
def test_text_times_are_parsed_and_bad_ones_drop(spark, ties, form):
    base = frame(spark, [(1, "2024-01-09 00:00:00", "a"), (2, "soon", "b")], "k int, ts string, v string")
    delta = frame(spark, [(1, "2024-01-10", "c")], "k int, ts string, v string")
    out = merge.merge_latest(base, delta, ["k"], "ts", ties, form)
    assert rows(out) == [(1, "2024-01-10", "c")]
    assert out.columns == ["k", "ts", "v"]


def test_new_columns_are_null_in_old_rows(spark):
    base = frame(spark, [(1, T[0], "a")])
    delta = frame(spark, [(2, T[1], "b", 7)], SCHEMA + ", n int")
    out = merge.merge_latest(base, delta, ["k"], "ts", ties="one")
    assert rows(out) == [(1, T[0], "a", None), (2, T[1], "b", 7)]
    swapped = delta.select("n", "v", "ts", "k").withColumnRenamed("n", "extra")
    assert merge.union_all(base, swapped).columns == ["k", "ts", "v", "extra"]
    by_place = merge.union_all(base, delta.select("k", "ts", F.col("v").alias("w")), by_position=True)
    assert by_place.columns == ["k", "ts", "v"]


def test_map_columns_do_not_break_the_pick(spark):
    schema = "k int, ts timestamp_ntz, m map<string,int>"
    base = frame(spark, [(1, T[0], {"a": 1})], schema)
    out = merge.merge_latest(base, frame(spark, [(1, T[1], {"a": 2})], schema), ["k"], "ts", "one")
    assert out.collect()[0]["m"] == {"a": 2}


def test_bad_arguments(spark):
    df = frame(spark, BASE)
    with pytest.raises(ValueError):
        merge.latest_rows(df, ["k"], "ts", ties="some")
    with pytest.raises(ValueError):
        merge.latest_rows(df, ["k"], "ts", ties="one", form="join")


def test_watermark(spark):
    df = frame(spark, [(1, datetime(2024, 1, 2, 3, 4, 5, 999999), "a"), (2, None, "b")])
    assert merge.high_watermark(df, "ts") == datetime(2024, 1, 2, 3, 4, 5, 999999)
    assert merge.watermark(df, "ts").first()["watermark_text"] == "2024-01-02 03:04:05"
    with pytest.raises(ValueError):
        merge.high_watermark(df.where("false"), "ts")
    text = frame(spark, [(1, "2024-01-02 03:04:05"), (2, "never"), (3, None)], "k int, ts string")
    assert merge.watermark(text, "ts").first()["watermark_text"] == "2024-01-02 03:04:05"
    days = text.select("k", F.lit("2024-02-03").cast("date").alias("ts"))
    assert merge.watermark(days, "ts").first()["watermark_text"] == "2024-02-03 00:00:00"


def test_counts_and_emptiness(spark):
    df = frame(spark, BASE)
    assert merge.row_count(df).first()[0] == len(BASE)
    assert not merge.is_empty(df)
    assert merge.is_empty(df.where("k > 100"))
    latest = {r["k"]: r["ts"] for r in merge.latest_per_key(df, ["k"], "ts").collect()}
    assert latest[5] is None and latest[1] == T[0]


def test_upsert_newer_equals_merge(spark):
    base = frame(spark, [(k, T[k % 3], f"base {k}") for k in range(20)])
    delta = frame(spark, [(k, T[2 + k % 3], f"delta {k}") for k in (1, 1, 5, 30, 31, 31)] + [(31, T[4], "z")])
    want = merge.merge_latest(base, delta, ["k"], "ts", ties="one")
    assert rows(merge.upsert_newer(base, delta, ["k"], "ts")) == rows(want)
    assert rows(merge.upsert_newer(base, delta, ["k"], "ts", buckets=4)) == rows(want)


def brute_force(base, delta, ties):
    """The merge row by row in Python."""
    everything = [(*r, 0) for r in base] + [(*r, 1) for r in delta]
    everything = [r for r in everything if r[0] is not None and r[1] is not None]
    out = []
    for k in {r[0] for r in everything}:
        mine = [r for r in everything if r[0] == k]
        top = [r for r in mine if r[1] == max(m[1] for m in mine)]
        out += top if ties == "all" else [max(top, key=lambda r: (r[3], r[2]))]
    return sorted([r[:3] for r in out], key=str)


ROW = st.tuples(st.sampled_from([None, 1, 2, 3]), st.sampled_from([None, *T[:3]]), st.sampled_from("abc"))


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(base=st.lists(ROW, max_size=8), delta=st.lists(ROW, max_size=8))
def test_merge_against_brute_force(spark, base, delta):
    b, d = frame(spark, base), frame(spark, delta)
    for ties, form in (("all", "join"), ("all", "window"), ("one", None)):
        out = merge.merge_latest(b, d, ["k"], "ts", ties, form)
        assert rows(out) == brute_force(base, delta, ties)
    once = merge.merge_latest(b, d, ["k"], "ts", "one")
    assert rows(merge.latest_rows(once, ["k"], "ts", "one")) == rows(once)


def test_a_hot_key_is_split(spark):
    """A third of the rows share key and time: the join splits them over tasks."""
    settings_ = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "32",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings_}
    for k, v in settings_.items():
        spark.conf.set(k, v)
    try:
        hot = F.col("id") % 3 == 0
        data = spark.range(0, 240_000, 1, 8).select(
            F.when(hot, -1).otherwise(F.col("id")).alias("k"),
            F.timestamp_seconds(F.when(hot, 0).otherwise(F.col("id"))).alias("ts"),
            F.sha2(F.col("id").cast("string"), 256).alias("v"),
        )
        out = merge.latest_rows(data, ["k"], "ts").groupBy(F.col("k") == -1).agg(
            F.count("v"), F.sum(F.length("v"))
        )
        assert {tuple(r)[:2] for r in out.collect()} == {(True, 80_000), (False, 160_000)}
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize(("ties", "form"), list(product(["all"], ["join", "window"])) + [("one", None)])
def test_plans(spark, tmp_path, ties, form):
    frame(spark, BASE[:4]).write.parquet(str(tmp_path / "b"))
    df = spark.read.parquet(str(tmp_path / "b"))
    plan = merge.latest_rows(df, ["k"], "ts", ties, form)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(k), IsNotNull(ts)]" in plan
    assert ("WindowGroupLimit" in plan) == (form != "join")
