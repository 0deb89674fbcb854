import pytest

from tableops.operators import tables
from tableops.plans.models import Model, ModelError, adhoc_query, refresh_models, run_statements

TEST = Model("test", "SELECT CAST(id AS INT) AS id, notes FROM {raw}", ("raw",))
MASTER = Model("test_master", "SELECT * FROM {test}", ("test",))
BROKEN = Model("broken", "SELECT nothing FROM {test}", ("test",), optional=True)
NEEDS = Model("needs", "SELECT * FROM {broken}", ("broken",), optional=True)


@pytest.fixture()
def raw(spark):
    return {"raw": spark.createDataFrame([(1, "a"), (2, "b")], "id long, notes string")}


def status(report):
    return {r["model"]: r["status"] for r in report.collect()}


def test_models_are_built_in_order_and_rebuilt(spark, db, raw):
    for _ in range(2):
        report = refresh_models(spark, [MASTER, TEST], db, raw)
        assert status(report) == {"test": "built", "test_master": "built"}
        out = spark.table(f"{db}.test_master")
        assert out.schema.simpleString() == "struct<id:int,notes:string>"
        assert out.count() == 2


def test_an_optional_model_may_fail(spark, db, raw):
    report = refresh_models(spark, [NEEDS, BROKEN, MASTER, TEST], db, raw)
    assert status(report) == {
        "test": "built", "test_master": "built", "broken": "failed", "needs": "skipped",
    }
    errors = {r["model"]: r["error"] for r in report.collect()}
    assert "nothing" in errors["broken"] and "broken" in errors["needs"]
    assert not tables.table_exists(spark, f"{db}.needs")


def test_a_required_failure_is_raised_after_the_rest_is_built(spark, db, raw):
    required = Model("broken", BROKEN.select, BROKEN.depends_on)
    with pytest.raises(ModelError) as caught:
        refresh_models(spark, [NEEDS, required, MASTER, TEST], db, raw)
    assert dict(r[:2] for r in caught.value.report)["broken"] == "failed"
    assert spark.table(f"{db}.test_master").count() == 2
    # A model that has to be built and whose upstream failed counts too.
    with pytest.raises(ModelError):
        refresh_models(spark, [Model("needs", NEEDS.select, NEEDS.depends_on), BROKEN, TEST], db, raw)


def test_a_failed_rebuild_leaves_the_old_table(spark, db, raw):
    refresh_models(spark, [TEST], db, raw)
    fails = Model("test", "SELECT raise_error('no') AS id FROM {raw}", ("raw",), optional=True)
    assert status(refresh_models(spark, [fails], db, raw)) == {"test": "failed"}
    assert spark.table(f"{db}.test").count() == 2


def test_unknown_and_circular_dependencies(spark, db):
    with pytest.raises(ValueError, match="raw"):
        refresh_models(spark, [TEST], db)
    loop = [Model("a", "SELECT * FROM {b}", ("b",)), Model("b", "SELECT * FROM {a}", ("a",))]
    with pytest.raises(ValueError):
        refresh_models(spark, loop, db)


def test_statements(spark, db):
    out = run_statements(
        spark,
        [
            f"CREATE TABLE {db}.t (id INT, notes STRING) USING parquet",
            "  ",
            "-- one comment line",
            f"-- a comment above a statement\nINSERT INTO {db}.t VALUES (1, 'a;b')",
            f"SELECT * FROM {db}.t",
        ],
    )
    assert [tuple(r) for r in out.collect()] == [(1, "a;b")]
    assert run_statements(spark, ["", "-- nothing"]) is None
    with pytest.raises(NotImplementedError):
        run_statements(spark, ["SELECT 1"], context="other")
    with pytest.raises(ValueError):
        run_statements(spark, ["SELECT 1"], context="hive")


def test_adhoc_query(spark):
    assert adhoc_query(spark, "SELECT 1 AS one").first()["one"] == 1
    for nothing in ("", "  ", None):
        with pytest.raises(ValueError):
            adhoc_query(spark, nothing)


def test_independent_models_are_built_side_by_side(spark, db, raw):
    """Two models that wait for each other's start end only if both run at once."""
    import threading

    from tableops.plans import models

    both, entered, overwrite = threading.Barrier(2, timeout=60), [], models.overwrite_table

    def slowly(df, name):
        if name.endswith(("left", "right")):
            both.wait()
            entered.append(spark.sparkContext.getLocalProperty("spark.scheduler.pool"))
        return overwrite(df, name)

    models.overwrite_table = slowly
    try:
        sides = [Model(n, "SELECT * FROM {test}", ("test",)) for n in ("left", "right")]
        last = Model("last", "SELECT * FROM {left} UNION ALL SELECT * FROM {right}", ("left", "right"))
        report = refresh_models(spark, [last, *sides, TEST], db, raw, at_once=2)
    finally:
        models.overwrite_table = overwrite
    assert set(status(report).values()) == {"built"} and [r.model for r in report.collect()][-1] == "last"
    assert sorted(entered) == ["model-left", "model-right"]
    assert spark.table(f"{db}.last").count() == 4


def test_one_at_a_time_gives_the_same_report(spark, db, raw):
    chain = [NEEDS, BROKEN, MASTER, TEST]
    reports = [refresh_models(spark, chain, db, raw, at_once=n).collect() for n in (1, 3)]
    assert [(r.model, r.status) for r in reports[0]] == [(r.model, r.status) for r in reports[1]]
