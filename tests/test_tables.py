import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tableops.operators import tables
from tableops.session import path_exists


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame([(1, "a"), (2, "b")], "id int, notes string")


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_create_fails_if_present_and_overwrite_replaces(spark, db, rows):
    name = f"{db}.t"
    assert not tables.table_exists(spark, name)
    assert values(tables.create_table(rows, name)) == [(1, "a"), (2, "b")]
    assert tables.table_exists(spark, name)
    with pytest.raises(AnalysisException):
        tables.create_table(rows, name)
    # The new rows may come from the table itself.
    assert values(tables.overwrite_table(spark.table(name).where("id = 2"), name)) == [(2, "b")]
    names = {t.name for t in spark.catalog.listTables(db)}
    assert names == {"t"}


def test_exists_is_about_the_database_not_temp_views(spark, db, rows):
    rows.createOrReplaceTempView("only_a_view")
    assert not tables.table_exists(spark, f"{db}.only_a_view")
    spark.catalog.dropTempView("only_a_view")


def test_failed_overwrite_leaves_the_old_table(spark, db, rows):
    name = f"{db}.t"
    tables.create_table(rows, name)
    broken = rows.withColumn("id", F.raise_error(F.lit("stop")).cast("int"))
    with pytest.raises(Exception, match="stop"):
        tables.overwrite_table(broken, name)
    assert values(spark.table(name)) == [(1, "a"), (2, "b")]
    assert values(tables.overwrite_table(rows.where("id = 1"), name)) == [(1, "a")]


def test_recover_after_a_swap_that_stopped(spark, db, rows):
    name = f"{db}.t"
    tables.create_table(rows, name)
    tables.rename_table(spark, name, f"{name}_replaced")
    assert tables.recover_table(spark, name)
    assert values(spark.table(name)) == [(1, "a"), (2, "b")]
    assert not tables.recover_table(spark, name)


def test_drop_removes_leftover_files(spark, db, rows):
    name = f"{db}.t"
    rows.write.parquet(tables.leftover_dir(spark, name))
    with pytest.raises(Exception, match="LOCATION_ALREADY_EXISTS"):
        tables.create_table(rows, name)
    tables.drop_table(spark, name)
    assert not path_exists(spark, tables.leftover_dir(spark, name))
    tables.create_table(rows, name)
    tables.drop_table(spark, name, purge=True)
    tables.drop_table(spark, name)
    assert not tables.table_exists(spark, name)


def test_alter(spark, db, rows):
    tables.create_table(rows, f"{db}.a")
    tables.rename_table(spark, f"{db}.a", f"{db}.b")
    assert not tables.table_exists(spark, f"{db}.a")
    assert values(tables.add_column(spark, f"{db}.b", "n", "int")) == [(1, "a", None), (2, "b", None)]
    assert tables.keep_columns(spark, f"{db}.b", ["id"]).columns == ["id"]


def test_empty_typed_table(spark, db, rows):
    name = f"{db}.test"
    empty = tables.create_empty_table(spark, name, "id int, notes string")
    assert empty.isEmpty()
    assert empty.schema.simpleString() == "struct<id:int,notes:string>"
    assert values(tables.append_rows(rows.select("notes", "id"), name)) == [(1, "a"), (2, "b")]


def test_partitions(spark, db):
    name = f"{db}.t"
    data = spark.range(100).select("id", (F.col("id") % 4).cast("int").alias("part"))
    tables.create_partitioned(data, name, "part")
    changed = spark.createDataFrame([(-1, 2)], "id long, part int")
    out = tables.overwrite_partitions(changed, name, "part")
    assert out.where("part = 2").collect()[0]["id"] == -1
    assert out.count() == 76
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"
    plan = spark.table(name).where("part = 3")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan


def test_properties(spark, db, rows):
    tables.create_table(rows, f"{db}.t")
    assert tables.table_property(spark, f"{db}.t", "x.y") is None
    tables.set_table_property(spark, f"{db}.t", "x.y", "it's a \\ value")
    assert tables.table_property(spark, f"{db}.t", "x.y") == "it's a \\ value"
    tables.rename_table(spark, f"{db}.t", f"{db}.u")
    assert tables.table_property(spark, f"{db}.u", "x.y") == "it's a \\ value"


def test_partition_overwrite_leaves_the_session_alone(spark, db, monkeypatch):
    name = f"{db}.kinds"
    tables.create_partitioned(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, p string"), name, "p")
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)

    def touched(self, key, value):
        raise AssertionError(f"{key} was set")

    monkeypatch.setattr(type(spark.conf), "set", touched)
    tables.overwrite_partitions(spark.createDataFrame([(9, "a"), (8, "c")], "i int, p string"), name, "p")
    monkeypatch.undo()
    got = sorted((r["i"], r["p"]) for r in spark.table(name).collect())
    assert got == [(2, "b"), (3, None), (8, "c"), (9, "a")]
    assert spark.conf.get(mode) == before
    tables.rename_table(spark, name, f"{db}.sorts")
    assert spark.table(f"{db}.sorts").count() == 4
