"""Job logs and application lists made of events, and the merge as a stream.

Each event is a task of a job: its user's. The tasks of a user and day ran in
one application; purchases succeeded, errors failed, sign-ups threw.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from queryset.base import fresh_path, table
from tableops.functions.scalars import format_seconds, time_to_millis
from tableops.operators import apps as applications
from tableops.operators import logs as joblogs
from tableops.sources import files
from tableops.streaming import upsert

_DAY = "translate(string(date(ts)), '-', '')"
_USER_DAY_APP = f"concat('application_', {_DAY}, '_', user_id)"
_DAY_APP = f"concat('application_', {_DAY})"


def log_lines(events: DataFrame, app: str) -> DataFrame:
    """The log lines the events' tasks wrote: ``app_id, log_type, line``."""
    job = F.md5(F.col("user_id").cast("string"))
    task = F.concat(F.lit("event_"), "event_id")
    at = F.concat(F.lit(" at time "), format_seconds(F.col("ts")), F.lit(" GMT..."))
    kind = F.col("event_type")

    def line(log_type: str, *parts) -> Column:
        text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        return F.struct(F.lit(log_type).alias("log_type"), text.alias("line"))

    value = F.col("value").cast("string")
    seconds = line("stdout", "Processing time for task ", task, " was ", value, " seconds")
    thrown = line("stderr", "java.lang.IllegalStateException: event ", F.col("event_id"))
    lines = F.concat(
        F.array(line("stdout", job, " STARTED"), line("stdout", "Starting task ", task, at)),
        F.when(
            kind == "purchase",
            F.array(
                line("stdout", job, " SUCCEEDED"),
                line("stdout", "Task ", task, " succeeded", at),
                seconds,
            ),
        )
        .when(
            kind == "error",
            F.array(line("stderr", job, " FAILED"), line("stderr", "Task ", task, " FAILED", at)),
        )
        .when(kind == "signup", F.array(thrown))
        .otherwise(F.array().cast("array<struct<log_type: string, line: string>>")),
    )
    return events.select(F.expr(app).alias("app_id"), F.inline(lines))


def app_rows(events: DataFrame, app: str) -> DataFrame:
    """The applications of those tasks: ``app_id, finished_time, final_status``."""
    return events.groupBy(F.expr(app).alias("app_id")).agg(
        F.max("ts").alias("finished_time"),
        F.when(F.count(F.lit(1)) % 2 == 0, "FINISHED").otherwise("KILLED").alias("final_status"),
    )


def log_search(spark, sf_dir):
    """The error log of the last day on which user 7 had a failure, from log files."""
    events = table(spark, sf_dir, "events")
    path = f"{fresh_path(spark, 'log_search')}/logs"
    log_lines(events, _DAY_APP).write.partitionBy("app_id", "log_type").text(path)
    logs = joblogs.read_logs(spark, path, partitioned=True)
    apps = app_rows(events, _DAY_APP).withColumn(
        "user", F.when(F.col("app_id").endswith("0"), "other").otherwise("me")
    )
    return joblogs.log_search(logs, apps, _job(7) + " FAILED", ("stderr",), "me")


def log_search_indexed(spark, sf_dir):
    """The same search by staged bitmaps: only folders that may hold the text are read, newest first."""
    events = table(spark, sf_dir, "events")
    place = fresh_path(spark, "log_search_indexed")
    log_lines(events, _DAY_APP).write.partitionBy("app_id", "log_type").text(f"{place}/logs")
    logs = joblogs.read_logs(spark, f"{place}/logs", partitioned=True)
    joblogs.log_index(logs).write.parquet(f"{place}/index")
    index = spark.read.parquet(f"{place}/index")
    apps = app_rows(events, _DAY_APP).withColumn(
        "user", F.when(F.col("app_id").endswith("0"), "other").otherwise("me")
    )
    return joblogs.log_search(logs, apps, _job(7) + " FAILED", ("stderr",), "me", index)


def failed_log(spark, sf_dir):
    """The log that tells how the job of user 7 failed."""
    events = table(spark, sf_dir, "events").where("event_type != 'purchase'")
    logs, apps = log_lines(events, _USER_DAY_APP), app_rows(events, _USER_DAY_APP)
    return joblogs.failed_log(logs, apps, _job(7)).select("app_id", "log_type", "line")


def _job(user: int) -> str:
    return hashlib.md5(str(user).encode()).hexdigest()


def log_status(spark, sf_dir):
    """How the job of user 7 ended, by each rule."""
    events = table(spark, sf_dir, "events")
    logs, apps = log_lines(events, _USER_DAY_APP), app_rows(events, _USER_DAY_APP)
    own = joblogs.log_status(logs, apps, _job(7))
    loose = joblogs.log_status(logs, apps, _job(7), strict_reference=True)
    return own.withColumn("rule", F.lit("own")).union(loose.withColumn("rule", F.lit("strict")))


def job_status(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return joblogs.job_status(log_lines(events, _USER_DAY_APP), app_rows(events, _USER_DAY_APP))


def log_events(spark, sf_dir):
    """Events of the logs, among them what every view's task depends on and what is missing."""
    events = table(spark, sf_dir, "events")
    task = F.concat(F.lit("Task event_"), "event_id")
    needs = events.where("event_type = 'view'").select(
        F.expr(_USER_DAY_APP).alias("app_id"),
        F.lit("stdout").alias("log_type"),
        F.explode(
            F.array(
                F.concat(task, F.lit(" depends on Task user_"), "user_id"),
                F.concat(F.lit("Task user_"), "user_id", F.lit(" missing as dependency")),
            )
        ).alias("line"),
    )
    found = joblogs.log_events(log_lines(events, _USER_DAY_APP).union(needs))
    return found.select("app_id", "log_type", "job", "task", "event", "event_time", "seconds",
                        "minutes", "hours", "depends_on")


def app_summary(spark, sf_dir):
    found = joblogs.log_events(log_lines(table(spark, sf_dir, "events"), _USER_DAY_APP))
    exact = found.withColumn("seconds", F.col("seconds").cast("decimal(18, 2)"))
    return joblogs.app_summary(exact).withColumn("seconds", F.col("seconds").cast("double"))


_LIST_ROWS = 500


def _app_fields() -> list[Column]:
    """Each event as an application of a cluster's list."""
    state = F.when(F.col("event_type") == "view", "RUNNING").otherwise(F.upper("event_type"))
    return [
        F.concat(F.lit("application_"), "event_id").alias("id"),
        F.concat(F.lit("job_"), "user_id").alias("name"),
        F.concat(F.lit("user_"), "user_id").alias("user"),
        F.concat(F.lit("queue_"), (F.col("user_id") % 3).cast("string")).alias("queue"),
        state.alias("state"),
        time_to_millis(F.col("ts")).alias("startedTime"),
    ]


def _app_list(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """Documents of at most ``_LIST_ROWS`` applications, written and read back."""
    path = f"{fresh_path(spark, query)}/apps"
    chunk = F.floor(F.col("event_id") / _LIST_ROWS)
    documents = (
        table(spark, sf_dir, "events")
        .groupBy(chunk.alias("chunk"))
        .agg(F.collect_list(F.struct(*_app_fields())).alias("app"))
        .select(F.to_json(F.struct(F.struct("app").alias("apps"))))
    )
    files.write_records(documents, path)
    return applications.read_apps(spark, path)


def app_inventory(spark, sf_dir):
    apps = _app_list(spark, sf_dir, "app_inventory")
    chosen = applications.filter_apps(apps, text="job_1", state="ERROR", queue="queue_1")
    return chosen.select("id", "name", "user", "queue", "state", "startedTime")


def long_running(spark, sf_dir):
    apps = _app_list(spark, sf_dir, "long_running")
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    return applications.long_running(apps, 10_000, now).select("id", "queue", "running_minutes")


def stream_merge_latest(spark, sf_dir):
    """Events that arrive in two lots, each taken in when it is there, the second by a
    stream that begins anew: the last row per user."""
    events = table(spark, sf_dir, "events")
    place = fresh_path(spark, "stream_merge_latest")
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    for i, lot in enumerate((events.where(early), events.where(~early))):
        lot.write.parquet(f"{place}/changes{i}")
        changes = spark.readStream.schema(events.schema).parquet(f"{place}/changes{i}")
        upsert.stream_merge_latest(
            changes, f"{place}/target", ["user_id"], "ts", f"{place}/checkpoint{i}"
        ).awaitTermination()
    return upsert.read_target(spark, f"{place}/target", ["user_id"], "ts")


QUERIES = {
    "log_search": log_search,
    "log_search_indexed": log_search_indexed,
    "failed_log": failed_log,
    "log_status": log_status,
    "job_status": job_status,
    "log_events": log_events,
    "app_summary": app_summary,
    "app_inventory": app_inventory,
    "long_running": long_running,
    "stream_merge_latest": stream_merge_latest,
}


def _sql_lines(app: str) -> str:
    at = "strftime(ts, '%Y-%m-%d %H:%M:%S') || ' GMT...'"
    job, task = "md5(CAST(user_id AS VARCHAR))", "'event_' || event_id"
    pieces = [
        ("stdout", "true", f"{job} || ' STARTED'"),
        ("stdout", "true", f"'Starting task ' || {task} || ' at time ' || {at}"),
        ("stdout", "event_type = 'purchase'", f"{job} || ' SUCCEEDED'"),
        ("stdout", "event_type = 'purchase'",
         f"'Task ' || {task} || ' succeeded at time ' || {at}"),
        ("stdout", "event_type = 'purchase'",
         f"'Processing time for task ' || {task} || ' was ' || CAST(value AS VARCHAR) || ' seconds'"),
        ("stderr", "event_type = 'error'", f"{job} || ' FAILED'"),
        ("stderr", "event_type = 'error'", f"'Task ' || {task} || ' FAILED at time ' || {at}"),
        ("stderr", "event_type = 'signup'",
         "'java.lang.IllegalStateException: event ' || event_id"),
    ]
    return " UNION ALL ".join(
        f"SELECT {app} AS app_id, '{kind}' AS log_type, {line} AS line FROM events WHERE {when}"
        for kind, when, line in pieces
    )


_SQL_DAY = "'application_' || strftime(ts, '%Y%m%d')"
_SQL_USER_DAY = f"{_SQL_DAY} || '_' || user_id"


def _sql_flags(job: str, where: str) -> str:
    """Flags of applications for one job, or for the job named in column ``job``."""
    flags = ", ".join(
        f"coalesce(bool_or(log_type = '{t}' AND {test}), false) AS {name}_{t}"
        for t in ("stderr", "stdout")
        for name, test in (
            ("failed", f"contains(line, {job} || ' FAILED')"),
            ("succeeded", f"contains(line, {job} || ' SUCCEEDED')"),
            ("exception", "contains(line, 'Exception')"),
            ("present", f"contains(line, {job})"),
        )
    )
    return f"SELECT app_id, {flags} FROM {where} GROUP BY app_id"


_SQL_VERDICT = "coalesce({})".format(
    ", ".join(
        f"CASE WHEN failed_{t} THEN 'FAILURE' WHEN succeeded_{t} THEN 'SUCCESS' "
        f"WHEN exception_{t} THEN 'FAILURE' WHEN present_{t} THEN final_status END"
        for t in ("stderr", "stdout")
    )
)


def _sql_apps(app: str) -> str:
    return f"""SELECT {app} AS app_id, max(ts) AS finished_time,
  CASE WHEN count(*) % 2 = 0 THEN 'FINISHED' ELSE 'KILLED' END AS final_status
FROM events GROUP BY 1"""


_SQL_EVENTS = f"""
SELECT {_SQL_USER_DAY} AS app_id, CASE event_type WHEN 'error' THEN 'stderr' ELSE 'stdout' END AS out,
  md5(CAST(user_id AS VARCHAR)) AS id, 'event_' || event_id AS name, event_type,
  date_trunc('second', ts) AS moment, value FROM events"""

_SQL_LOG_EVENTS = f"""WITH e AS ({_SQL_EVENTS}), l AS (
  SELECT app_id, 'stdout' AS log_type, id AS job, NULL AS task, 'STARTED' AS event,
    NULL AS event_time, NULL AS seconds FROM e
  UNION ALL SELECT app_id, 'stdout', NULL, name, 'STARTED', moment, NULL FROM e
  UNION ALL SELECT app_id, out, id, NULL,
    CASE event_type WHEN 'error' THEN 'FAILED' ELSE 'SUCCEEDED' END, NULL, NULL
    FROM e WHERE event_type IN ('error', 'purchase')
  UNION ALL SELECT app_id, out, NULL, name,
    CASE event_type WHEN 'error' THEN 'FAILED' ELSE 'SUCCEEDED' END, moment, NULL
    FROM e WHERE event_type IN ('error', 'purchase')
  UNION ALL SELECT app_id, 'stdout', NULL, name, 'TIMED', NULL, value
    FROM e WHERE event_type = 'purchase')"""

ORACLE = {
    "log_search": f"""WITH logs AS ({_sql_lines(_SQL_DAY)}), apps AS ({_sql_apps(_SQL_DAY)}),
newest AS (SELECT app_id FROM apps WHERE app_id IN
    (SELECT app_id FROM logs WHERE contains(line, md5('7') || ' FAILED') AND log_type = 'stderr')
  AND NOT app_id LIKE '%0' ORDER BY finished_time DESC, app_id DESC LIMIT 1)
SELECT app_id, log_type, line FROM logs
WHERE app_id IN (SELECT app_id FROM newest) AND log_type = 'stderr'""",
    "failed_log": f"""WITH e AS (SELECT * FROM events WHERE event_type != 'purchase'),
logs AS ({_sql_lines(_SQL_USER_DAY).replace("FROM events", "FROM e")}),
apps AS ({_sql_apps(_SQL_USER_DAY).replace("FROM events", "FROM e")}), f AS ({_sql_flags("md5('7')", "logs")}),
s AS (SELECT f.*, finished_time, {_SQL_VERDICT} AS status,
    CASE WHEN failed_stderr OR succeeded_stderr OR exception_stderr OR present_stderr
      THEN 'stderr' ELSE 'stdout' END AS log_type
  FROM f JOIN apps ON apps.app_id = f.app_id WHERE present_stderr OR present_stdout),
t AS (SELECT * FROM s WHERE status IS NOT NULL ORDER BY finished_time DESC, app_id DESC LIMIT 1)
SELECT logs.* FROM logs JOIN t USING (app_id, log_type) WHERE t.status = 'FAILURE'""",
    "log_status": f"""WITH logs AS ({_sql_lines(_SQL_USER_DAY)}),
apps AS ({_sql_apps(_SQL_USER_DAY)}), f AS ({_sql_flags("md5('7')", "logs")}),
s AS (SELECT f.app_id, finished_time, {_SQL_VERDICT} AS status,
    present_stderr OR present_stdout AS present FROM f JOIN apps ON apps.app_id = f.app_id)
SELECT * FROM (SELECT app_id, status, 'own' AS rule FROM s WHERE status IS NOT NULL AND present
  ORDER BY finished_time DESC, app_id DESC LIMIT 1)
UNION ALL SELECT * FROM (SELECT app_id, status, 'strict' FROM s WHERE status IS NOT NULL
  ORDER BY finished_time DESC, app_id DESC LIMIT 1)""",
    "job_status": f"""WITH logs AS ({_sql_lines(_SQL_USER_DAY)}),
apps AS ({_sql_apps(_SQL_USER_DAY)}),
jobs AS (SELECT app_id, any_value(regexp_extract(line, '([0-9a-f]{{32}})', 1)) AS job FROM logs
  WHERE regexp_matches(line, '[0-9a-f]{{32}}') GROUP BY app_id),
named AS (SELECT logs.*, job FROM logs JOIN jobs ON jobs.app_id = logs.app_id),
f AS ({_sql_flags("job", "named")})
SELECT f.app_id, job, {_SQL_VERDICT} AS status
FROM f JOIN apps ON apps.app_id = f.app_id JOIN jobs ON jobs.app_id = f.app_id""",
    "log_events": f"""{_SQL_LOG_EVENTS}
SELECT *, seconds / 60 AS minutes, seconds / 3600 AS hours, NULL AS depends_on FROM l
UNION ALL SELECT {_SQL_USER_DAY}, 'stdout', NULL, 'event_' || event_id, 'DEPENDS_ON', NULL, NULL,
  NULL, NULL, 'user_' || user_id FROM events WHERE event_type = 'view'
UNION ALL SELECT {_SQL_USER_DAY}, 'stdout', NULL, 'user_' || user_id, 'MISSING', NULL, NULL,
  NULL, NULL, NULL FROM events WHERE event_type = 'view'""",
    "app_summary": f"""{_SQL_LOG_EVENTS}
SELECT app_id, max(job) AS job, count(*) FILTER (job IS NOT NULL AND event = 'STARTED') AS started,
  count(*) FILTER (job IS NOT NULL AND event = 'SUCCEEDED') AS succeeded,
  count(*) FILTER (job IS NOT NULL AND event = 'FAILED') AS failed,
  min(event_time) FILTER (event = 'STARTED') AS first_start,
  max(event_time) FILTER (event IN ('SUCCEEDED', 'FAILED')) AS last_end,
  CAST(sum(CAST(seconds AS DECIMAL(18, 2))) AS DOUBLE) AS seconds FROM l GROUP BY app_id""",
    "app_inventory": """SELECT 'application_' || event_id AS id, 'job_' || user_id AS name,
  'user_' || user_id AS user, 'queue_1' AS queue, 'ERROR' AS state, epoch_us(ts) // 1000 AS startedTime
FROM events WHERE event_type = 'error' AND user_id % 3 = 1
  AND (contains('job_' || user_id, 'job_1'))""",
    "long_running": """SELECT * FROM (
  SELECT 'application_' || event_id AS id, 'queue_' || (user_id % 3) AS queue,
    (epoch_us(TIMESTAMP '2024-02-01') // 1000000 - epoch_us(ts) // 1000000) // 60 AS running_minutes
  FROM events WHERE event_type = 'view') WHERE running_minutes > 10000""",
    "stream_merge_latest": """SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1""",
}
ORACLE["log_search_indexed"] = ORACLE["log_search"]
