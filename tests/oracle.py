"""Compare registered queries with their SQL, order-insensitively.

Run as a script with query names to check those only::

    python tests/oracle.py /root/testdata/sf0.01 merge_latest
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from queryset.base import TABLES  # noqa: E402


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return repr(value)
    return str(value)


def spark_rows(df):
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    return sorted(df.columns), sorted(tuple(_cell(r[i]) for i in order) for r in df.collect())


def sql_rows(con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = sorted(tuple(_cell(r[i]) for i in order) for r in result.fetchall())
    return sorted(names), rows


def differences(spark, con, name, query, sql, sf_dir):
    got_names, got = spark_rows(query(spark, sf_dir))
    if sql is None:
        return [], len(got)
    want_names, want = sql_rows(con, sql)
    if got_names != want_names:
        return [f"{name}: columns {got_names} instead of {want_names}"], len(got)
    if got == want:
        return [], len(got)
    extra, missing = [r for r in got if r not in set(want)], [r for r in want if r not in set(got)]
    return [
        f"{name}: {len(got)} rows instead of {len(want)}; extra {extra[:3]}, missing {missing[:3]}"
    ], len(got)


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", os.environ.get("TZ_CHECK", "UTC"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    con, sql = connect(sf_dir), entry.oracle_sql()
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        begin = time.time()
        try:
            bad, n = differences(spark, con, name, query, sql.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            bad, n = [f"{name}: {type(e).__name__} {str(e)[:1500]}"], 0
        mark = "BAD" if bad else ("ok" if name in sql else "rows only")
        print(f"{name:28s} {mark:9s} {n:8d} rows {time.time() - begin:6.2f}s", flush=True)
        for line in bad:
            print("   ", line)
