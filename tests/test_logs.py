from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tableops.operators import apps as applications
from tableops.operators import logs as joblogs

A, B = "a" * 32, "b" * 32
APPS = [("app1", datetime(2024, 1, 1), "FINISHED"), ("app2", datetime(2024, 1, 2), "KILLED"),
        ("app3", datetime(2024, 1, 3), "FAILED")]


@pytest.fixture()
def apps(spark):
    return spark.createDataFrame(APPS, "app_id string, finished_time timestamp_ntz, final_status string")


def logs(spark, rows):
    return spark.createDataFrame(rows, "app_id string, log_type string, line string")


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        ([("stderr", f"{A} FAILED"), ("stderr", f"{A} SUCCEEDED")], "FAILURE"),
        ([("stderr", f"{A} SUCCEEDED"), ("stderr", "an Exception")], "SUCCESS"),
        ([("stderr", f"{A} SUCCEEDED"), ("stdout", f"{A} FAILED")], "SUCCESS"),
        ([("stderr", "an Exception"), ("stdout", f"{A} SUCCEEDED")], "FAILURE"),
        ([("stderr", f"id {A} here"), ("stdout", f"{A} SUCCEEDED")], "FINISHED"),
        ([("stderr", "nothing"), ("stdout", f"{A} SUCCEEDED")], "SUCCESS"),
        ([("stdout", f"id {A} here")], "FINISHED"),
        ([("directory.info", f"{A} FAILED")], None),
        ([("stderr", f"{B} FAILED"), ("stdout", f"{B} x")], None),
    ],
)
def test_status_rules(spark, apps, lines, want):
    df = logs(spark, [("app1", t, line) for t, line in lines])
    got = [tuple(r) for r in joblogs.log_status(df, apps, A).collect()]
    assert got == ([("app1", want)] if want else [])
    per_job = {(r["app_id"], r["job"]): r["status"] for r in joblogs.job_status(df, apps).collect()}
    assert per_job.get(("app1", A)) == want


def test_newest_application_counts_and_foreign_exceptions_do_not(spark, apps):
    df = logs(
        spark,
        [("app1", "stdout", f"{A} FAILED"), ("app2", "stdout", f"{A} SUCCEEDED"),
         ("app3", "stderr", "java.lang.Exception: other job")],
    )
    assert tuple(joblogs.log_status(df, apps, A).first()) == ("app2", "SUCCESS")
    strict = joblogs.log_status(df, apps, A, strict_reference=True)
    assert tuple(strict.first()) == ("app3", "FAILURE")
    assert joblogs.log_status(df, apps, B).isEmpty()


def test_several_jobs_of_one_application(spark, apps):
    df = logs(spark, [("app1", "stdout", f"{A} FAILED after {B} SUCCEEDED"), ("app2", "stdout", f"on {B}")])
    got = {(r["app_id"], r["job"]): r["status"] for r in joblogs.job_status(df, apps).collect()}
    assert got == {("app1", A): "FAILURE", ("app1", B): "SUCCESS", ("app2", B): "KILLED"}


def test_search(spark, apps):
    df = logs(spark, [("app1", "stdout", "needle one"), ("app2", "stderr", "x"),
                      ("app2", "stdout", "a needle"), ("app3", "stdout", "hay")])
    found = {tuple(r) for r in joblogs.log_search(df, apps, "needle").collect()}
    assert found == {("app2", "stderr", "x"), ("app2", "stdout", "a needle")}
    assert joblogs.log_search(df, apps, "no such").isEmpty()
    with pytest.raises(ValueError):
        joblogs.log_search(df, apps, "two\nlines")


def test_read_logs_by_path(spark, apps, tmp_path):
    for app, kind, text in [("app1", "stderr", "one\ntwo\n"), ("app2", "stdout", "three\n")]:
        (tmp_path / "plain" / app / kind).mkdir(parents=True)
        (tmp_path / "plain" / app / kind / "part-0").write_text(text)
        folder = tmp_path / "named" / f"app_id={app}" / f"log_type={kind}"
        folder.mkdir(parents=True)
        (folder / "part-0").write_text(text)
    want = {("app1", "stderr", "one"), ("app1", "stderr", "two"), ("app2", "stdout", "three")}
    plain = joblogs.read_logs(spark, str(tmp_path / "plain"))
    named = joblogs.read_logs(spark, str(tmp_path / "named"), partitioned=True)
    assert {tuple(r) for r in plain.collect()} == want
    assert {tuple(r) for r in named.collect()} == want
    assert plain.columns == named.columns == ["app_id", "log_type", "line"]
    plan = named.where("log_type = 'stderr'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(log_type" in plan


def test_events(spark):
    df = logs(
        spark,
        [
            ("app1", "stdout", f"{A} STARTED"),
            ("app1", "stdout", "Starting task Table(a b) at time 2024-01-02 03:04:05 GMT..."),
            ("app1", "stdout", f"{A} SUCCEEDED"),
            ("app1", "stdout", "Task Table(a b) succeeded at time 2024-01-02 03:14:05 GMT..."),
            ("app1", "stdout", "Processing time for task Table(a b) was 600.5 seconds"),
            ("app1", "stdout", "Processing time for task Table(a b) was 10.0 minutes"),
            ("app1", "stdout", "FAILED: Exception"),
            ("app1", "stderr", "Task Query() BROKEN at time 2024-01-02 05:00:00 GMT..."),
            ("app1", "stderr", "it STARTED somehow"),
            ("app2", "stderr", f"{B} FAILED"),
        ],
    )
    found = joblogs.log_events(df)
    got = sorted(
        (tuple(r) for r in found.select("job", "task", "event", "event_time", "seconds").collect()), key=str
    )
    task = "Table(a b)"
    assert got == sorted(
        [
            (A, None, "STARTED", None, None),
            (None, task, "STARTED", datetime(2024, 1, 2, 3, 4, 5), None),
            (A, None, "SUCCEEDED", None, None),
            (None, task, "SUCCEEDED", datetime(2024, 1, 2, 3, 14, 5), None),
            (None, task, "TIMED", None, 600.5),
            (None, "Query()", "BROKEN", datetime(2024, 1, 2, 5), None),
            (B, None, "FAILED", None, None),
        ],
        key=str,
    )
    timed = found.where("event = 'TIMED'").first()
    assert (timed["minutes"], timed["hours"]) == (600.5 / 60, 600.5 / 3600)
    summary = {r["app_id"]: r for r in joblogs.app_summary(found).collect()}
    one = summary["app1"]
    assert (one["job"], one["started"], one["succeeded"], one["failed"]) == (A, 1, 1, 0)
    assert one["first_start"] == datetime(2024, 1, 2, 3, 4, 5)
    assert one["last_end"] == datetime(2024, 1, 2, 5)
    assert one["seconds"] == 600.5
    assert summary["app2"]["failed"] == 1


def test_app_lists(spark, tmp_path):
    text = """{"apps": {"app": [
      {"id": "app1", "name": "load x", "queue": "q", "state": "RUNNING", "startedTime": 1704067200999},
      {"id": "app2", "name": "load y", "queue": "r", "state": "RUNNING", "startedTime": 1704067260000},
      {"id": "app3", "queue": "q", "state": "ACCEPTED", "startedTime": 0, "finishedTime": 5}]}}"""
    (tmp_path / "a.json").write_text(text)
    apps = applications.read_apps(spark, str(tmp_path), whole=True)
    assert apps.count() == 3
    assert [r["id"] for r in applications.newest_first(apps).collect()][0] == "app3"

    def ids(df):
        return sorted(r["id"] for r in df.collect())

    assert ids(applications.filter_apps(apps, text="load")) == ["app1", "app2"]
    assert ids(applications.filter_apps(apps, state="RUNNING", queue="q")) == ["app1"]
    assert ids(applications.filter_apps(apps, text="app3", state="RUNNING")) == []
    # Started at second 0 and at second 60: 61 and 60 whole minutes.
    now = F.lit("2024-01-01 01:01:00").cast("timestamp_ntz")
    old = applications.long_running(apps, 60, now).collect()
    assert [(r["id"], r["running_minutes"]) for r in old] == [("app1", 61)]
    assert ids(applications.long_running(apps, 10)) == ["app1", "app2"]


def test_search_by_type_and_user(spark):
    apps = spark.createDataFrame(
        [("app1", datetime(2024, 1, 1), "me"), ("app2", datetime(2024, 1, 2), "you"), ("app3", datetime(2024, 1, 3), "me")],
        "app_id string, finished_time timestamp_ntz, user string",
    )
    df = logs(
        spark,
        [("app1", "stderr", "needle"), ("app1", "stdout", "hay"), ("app2", "stderr", "needle"),
         ("app3", "launch.sh", "needle"), ("app3", "stderr", "hay")],
    )

    def search(**options):
        return sorted(tuple(r) for r in joblogs.log_search(df, apps, "needle", **options).collect())

    assert search() == [("app2", "stderr", "needle")]
    assert search(user="me") == [("app1", "stderr", "needle"), ("app1", "stdout", "hay")]
    assert search(log_types=("launch.sh",)) == [("app3", "launch.sh", "needle")]
    assert search(user="nobody") == []


def test_the_failed_log(spark, apps):
    df = logs(
        spark,
        [("app1", "stdout", f"{A} STARTED"), ("app1", "stdout", f"{A} FAILED"), ("app1", "stderr", "quiet"),
         ("app2", "stdout", f"{B} SUCCEEDED")],
    )
    got = sorted(r["line"] for r in joblogs.failed_log(df, apps, A).collect())
    assert got == [f"{A} FAILED", f"{A} STARTED"]
    assert joblogs.failed_log(df, apps, B).isEmpty()


def test_dependency_lines(spark):
    df = logs(
        spark,
        [("app1", "stdout", "Task load depends on Task fetch all"), ("app1", "stdout", "Task fetch all missing as dependency"),
         ("app1", "stdout", "a Task x depends on Task y")],
    )
    got = sorted((r["event"], r["task"], r["depends_on"]) for r in joblogs.log_events(df).collect())
    assert got == [("DEPENDS_ON", "load", "fetch all"), ("MISSING", "fetch all", None)]


def test_job_status_reads_the_logs_once(spark, apps, tmp_path):
    logs(spark, [("app1", "stdout", f"{A} FAILED")]).write.parquet(str(tmp_path / "logs"))
    plan = joblogs.job_status(spark.read.parquet(str(tmp_path / "logs")), apps)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Relation") == 1


def test_bitmaps_rule_out_no_log_that_holds_the_text(spark):
    import random

    rng = random.Random(3)
    pool = ["Exception", "job ", "abc", "é𝔘", " ", "x", "FAILED", "12", "\t"]
    rows = [
        (f"app{i % 40}", rng.choice(["stderr", "stdout"]), "".join(rng.choices(pool, k=rng.randrange(8))))
        for i in range(400)
    ]
    index = joblogs.log_index(logs(spark, rows))
    held = {(a, t): {x for b, u, x in rows if (b, u) == (a, t)} for a, t, _ in rows}
    ruled_out = 0
    for text in ("Exception", "job x", "é𝔘", "FAILED12", "ab", "", "abcabc", "nowhere to be found"):
        may = {(r.app_id, r.log_type) for r in index.where(joblogs.may_hold(F.col("grams"), text)).collect()}
        holding = {k for k, lines in held.items() if any(text in x for x in lines)}
        assert holding <= may
        ruled_out += len(held) - len(may)
    assert ruled_out > 50
    assert index.selectExpr("max(length(grams))").first()[0] == 4096


def test_bitmaps_are_made_batch_by_batch(spark, monkeypatch):
    """No row a run of bytes, and no sort of them; also lines cut by blocks and more logs than a task keeps."""
    monkeypatch.setattr(joblogs, "_BLOCK", 16)
    monkeypatch.setattr(joblogs, "_ABREAST", 3)
    monkeypatch.setattr(joblogs, "_KEPT", 5)
    rows = [(f"app{i % 11}", "stdout", "é" * (i % 7) + f"line {i} " * (i % 5)) for i in range(200)]
    rows += [("app0", "stderr", None), ("app1", "stderr", ""), (None, "stderr", "some text"), ("app2", None, "ab")]
    index = joblogs.log_index(logs(spark, rows).repartition(3))
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    want = {}
    for app, kind, line in rows:
        raw = (line or "").encode()
        runs = {int.from_bytes(raw[i : i + 3], "little") * 0x9E3779B1 % (1 << 32) >> 17 for i in range(len(raw) - 2)}
        want.setdefault((app, kind), set()).update(runs)
    got = index.collect()
    assert len(got) == len(want)
    for r in got:
        assert {i for i in range(32_768) if r.grams[i // 8] >> i % 8 & 1} == want[r.app_id, r.log_type]


def test_an_indexed_search_reads_few_folders(spark, apps, tmp_path):
    """Folders it has no need of hold what no reader gets through."""
    rows = [(f"app{i:03d}", "stdout", f"{A} step {i}" + (" needle" if i in (20, 77) else "")) for i in range(100)]
    rows += [(f"app{i:03d}", "stderr", "needle") for i in (90,)] + [("app095", "directory.info", "needle")]
    root = str(tmp_path / "logs")
    logs(spark, rows).write.partitionBy("app_id", "log_type").text(root)
    lists = spark.createDataFrame(
        [(f"app{i:03d}", datetime(2024, 1, 1, i // 60, i % 60), "FINISHED", "me" if i != 90 else "you") for i in range(101)],
        "app_id string, finished_time timestamp_ntz, final_status string, user string",
    )
    found = joblogs.read_logs(spark, root, partitioned=True)
    joblogs.log_index(found).write.parquet(f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    for text, user in ((" needle", None), ("needle", None), ("needle", "me"), ("step 5", "me"), ("no such text", None)):
        plain = joblogs.log_search(found, lists, text, user=user).collect()
        got = joblogs.log_search(found, lists, text, user=user, index=index).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, plain))
    # applications that came after the index was made are looked at too
    later = logs(spark, [("app100", "stdout", "a needle")])
    got = joblogs.log_search(found.union(later), lists, "needle", index=index).collect()
    assert [r.app_id for r in got] == ["app100"]
    for i in range(100):
        if i not in (20, 77):
            (tmp_path / "logs" / f"app_id=app{i:03d}" / "log_type=stdout" / "part-x.gz").write_text("no gzip")
    fresh = joblogs.read_logs(spark, root, partitioned=True)
    with pytest.raises(Exception):
        joblogs.log_search(fresh, lists, " needle").collect()
    got = joblogs.log_search(fresh, lists.where("app_id != 'app100'"), " needle", index=index).collect()
    assert [(r.app_id, r.line) for r in got] == [("app077", f"{A} step 77 needle")]


def test_an_indexed_search_goes_on_past_false_hits(spark, monkeypatch):
    """More applications than are named at once; bitmaps that rule nothing out."""
    monkeypatch.setattr(joblogs, "_NAMED", 16)
    rows = [(f"app{i:03d}", "stdout", "abx bxy" if i else "abxy") for i in range(60)]
    lists = spark.createDataFrame(
        [(f"app{i:03d}", datetime(2024, 1, 1, 0, i), "FINISHED") for i in range(60)],
        "app_id string, finished_time timestamp_ntz, final_status string",
    )
    found = logs(spark, rows)
    index = joblogs.log_index(found)
    assert index.where(joblogs.may_hold(F.col("grams"), "abxy")).count() == 60
    assert [tuple(r) for r in joblogs.log_search(found, lists, "abxy", index=index).collect()] == [rows[0]]
    assert joblogs.log_search(found, lists, "xyab", index=index).collect() == []
