"""Job logs: search them, tell how jobs ended, extract their events.

A log is a frame ``app_id, log_type, line``; applications are a frame with
``app_id``, ``finished_time`` and ``final_status``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The line formats of job logs, the types that are looked at in
# this order, and the form of a job's id (32 hex digits).
LOG_TYPES = ("stderr", "stdout")
JOB_ID = r"([0-9a-f]{32})"
MARKER_LINE = r"^(\S+) (STARTED|SUCCEEDED|FAILED)$"
TIME_LINE = (
    r"^(?:Starting task|Task) (.+?)(?: (succeeded|FAILED|BROKEN))? "
    r"at time (\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) GMT\.\.\.$"
)
SECONDS_LINE = r"^Processing time for task (.+) was ([0-9.eE+-]+) seconds$"
DEPENDS_LINE = r"^Task (.+) depends on Task (.+)$"
MISSING_LINE = r"^Task (.+) missing as dependency$"
MARKERS = ("STARTED", "SUCCEEDED", "FAILED")


def read_logs(spark: SparkSession, path: str, partitioned: bool = False) -> DataFrame:
    """Log lines of files laid out as ``<path>/<app id>/<log type>/<file>``.

    With ``partitioned`` the folders are named ``app_id=<app id>`` and
    ``log_type=<log type>``. Then a filter on, or a join to, some applications
    or types lists and reads only their folders.
    """
    reader = spark.read.option("lineSep", "\n")
    if partitioned:
        lines = reader.schema("value string, app_id string, log_type string").text(path)
        return lines.select("app_id", "log_type", F.col("value").alias("line"))
    where = F.col("_metadata.file_path")
    parts = r"/([^/]+)/([^/]+)/[^/]+$"
    return (
        reader.option("recursiveFileLookup", True)
        .text(path)
        .select(
            F.regexp_extract(where, parts, 1).alias("app_id"),
            F.regexp_extract(where, parts, 2).alias("log_type"),
            F.col("value").alias("line"),
        )
    )


#: Bits of a log's bitmap; that of Spark's own bitmap functions.
_BITS = 32_768
#: Bytes of a run; its place is in the upper bits of its product, those above the spare ones.
_GRAM = 3
_MIXER = 0x9E3779B1
_SPARE = 32 - (_BITS - 1).bit_length()
#: Applications whose logs are read at first; each time none of them holds the text, four times as many.
_FIRST_READ = 4
_NAMED = 4_096
#: Bytes of lines marked at once, logs marked side by side, and logs whose bitmaps a task keeps.
_BLOCK, _ABREAST, _KEPT = 1 << 20, 64, 4_096


def log_index(logs: DataFrame) -> DataFrame:
    """``app_id, log_type, grams``: a bitmap of the runs of three bytes (in UTF-8) in each log.

    The bitmaps are built in the tasks that read the lines and have four kilobytes whatever the log's
    length, so the shuffle moves one a task and log. A text can only be in a log whose bitmap has
    the bits of all of its runs. Stage it, and add what ``log_index`` gives of new applications.
    """
    size, gram, mixer, spare = _BITS, _GRAM, _MIXER, _SPARE
    block, abreast, kept = _BLOCK, _ABREAST, _KEPT

    # Nested, with its imports inside: workers need no copy of this package.
    def marking(batches):
        import numpy as np
        import pyarrow as pa

        def marked(data, start, end, log, many):
            """Bitmaps of ``many`` logs; a row is ``data[start:end]`` of log number ``log``."""
            marks = np.zeros((many, size), dtype=bool)
            for low in range(int(start[0]), int(end[-1]), block):
                near = slice(np.searchsorted(end, low, side="right"), np.searchsorted(start, low + block))
                begin = np.maximum(start[near], low)
                runs = np.maximum(np.minimum(end[near] - gram + 1, low + block) - begin, 0)
                window = data[low : low + block + gram - 1].astype(np.uint32)
                found = np.zeros(max(0, len(window) - gram + 1), np.uint32)
                for i in range(gram):
                    found |= window[i : i + len(found)] << np.uint32(8 * i)
                found = (found * np.uint32(mixer)) >> np.uint32(spare)
                before = np.cumsum(runs) - runs
                place = np.arange(runs.sum()) + np.repeat(begin - low - before, runs)
                marks.ravel()[np.repeat(log[near] * size, runs) + found[place]] = True
            return np.packbits(marks, axis=1, bitorder="little")

        held: dict = {}

        def given():
            apps, kinds = zip(*held, strict=True)
            columns = [pa.array(x, t) for x, t in zip((apps, kinds, list(held.values())), types, strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["app_id", "log_type", "grams"])

        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(c).type for c in ("app_id", "log_type")] + [pa.binary()]
            apps, kinds = (batch[c].dictionary_encode("encode") for c in ("app_id", "log_type"))
            pair = apps.indices.to_numpy().astype(np.int64) * len(kinds.dictionary) + kinds.indices.to_numpy()
            pairs, log = np.unique(pair, return_inverse=True)
            names = [
                (apps.dictionary[i].as_py(), kinds.dictionary[j].as_py())
                for i, j in zip(*(x.tolist() for x in np.divmod(pairs, len(kinds.dictionary))), strict=True)
            ]
            lines = batch["line"].fill_null("").cast(pa.large_binary())
            _, edges, raw = lines.buffers()
            edges = np.frombuffer(edges, np.int64)[lines.offset : lines.offset + len(lines) + 1]
            data = np.frombuffer(raw or b"", np.uint8)
            for first in range(0, len(names), abreast):
                few = names[first : first + abreast]
                own = np.flatnonzero((log >= first) & (log < first + abreast))
                maps = marked(data, edges[own], edges[own + 1], log[own] - first, len(few))
                for name, bits in zip(few, maps, strict=True):
                    if name in held:
                        bits = bits | np.frombuffer(held[name], np.uint8)
                    held[name] = bits.tobytes()
                if len(held) >= kept:
                    yield given()
                    held.clear()
        if held:
            yield given()

    narrow = logs.select("app_id", "log_type", "line")
    fields = ", ".join(f"{c} {t}" for c, t in narrow.dtypes[:2])
    maps = narrow.mapInArrow(marking, f"{fields}, grams binary")
    return maps.groupBy("app_id", "log_type").agg(F.expr("bitmap_or_agg(grams)").alias("grams"))


def may_hold(grams: Column, text: str) -> Column:
    """Whether a log of this bitmap can hold ``text``; always, if that is shorter than a run."""
    raw = text.encode()
    runs = {int.from_bytes(raw[i : i + _GRAM], "little") for i in range(len(raw) - _GRAM + 1)}
    if not runs:
        return F.lit(True)

    def is_set(bit: int) -> Column:
        byte = F.conv(F.hex(F.substring(grams, bit // 8 + 1, 1)), 16, 10).cast("int")
        return byte.bitwiseAND(1 << bit % 8) != 0

    places = sorted({(run * _MIXER % (1 << 32)) >> _SPARE for run in runs})
    return reduce(lambda a, b: a & b, [is_set(p) for p in places])


def log_search(
    logs: DataFrame,
    apps: DataFrame,
    text: str,
    log_types: tuple[str, ...] = LOG_TYPES,
    user: str | None = None,
    index: DataFrame | None = None,
) -> DataFrame:
    """The log lines, of these types, of the newest application with ``text`` in one of them.

    ``user`` looks only at that user's applications (column ``user`` of ``apps``); their
    logs alone are then read, if the logs are laid out by application.

    With an ``index`` (of ``log_index``) of the logs, applications whose bitmaps rule the text out
    are not read, and the others are read newest first, a few at a time, until one holds it.
    Applications the index does not know may hold anything.
    """
    if "\n" in text:
        raise ValueError("the text to search for has to fit in one line")
    logs = logs.where(F.col("log_type").isin(*log_types))
    if index is not None:
        return _newest_first(logs, apps, text, log_types, user, index)
    if user is not None:
        apps = apps.where(F.col("user") == user)
    matching = logs.where(F.col("line").contains(text))
    if user is not None:
        matching = matching.join(apps.select("app_id"), "app_id", "left_semi")
    newest = (
        apps.join(matching.select("app_id").distinct(), "app_id", "left_semi")
        .orderBy(F.col("finished_time").desc_nulls_last(), F.col("app_id").desc())
        .limit(1)
        .select("app_id")
    )
    # One row by the limit above.
    return logs.join(F.broadcast(newest), "app_id", "left_semi")


def _newest_first(
    logs: DataFrame,
    apps: DataFrame,
    text: str,
    log_types: tuple[str, ...],
    user: str | None,
    index: DataFrame,
) -> DataFrame:
    if user is not None:
        apps = apps.where(F.col("user") == user)
    out = index.where(F.col("log_type").isin(*log_types)).groupBy("app_id").agg(
        F.max(may_hold(F.col("grams"), text)).alias("may")
    )
    unknown = apps.join(index.select("app_id").distinct(), "app_id", "left_anti")
    left = (
        apps.join(out.where("may"), "app_id", "left_semi")
        .unionByName(unknown)
        .select("app_id", "finished_time")
        .orderBy(F.col("finished_time").desc_nulls_last(), F.col("app_id").desc())
    )
    done, many = 0, _FIRST_READ
    while many <= _NAMED:
        # these few are named in the condition, so that a scan by folders opens no other
        names = [r.app_id for r in left.offset(done).limit(many).collect()]
        if not names:
            return logs.where(F.lit(False))
        near = logs.where(F.col("app_id").isin(names))
        holding = near.where(F.col("line").contains(text)).select("app_id").distinct().collect()
        if holding:
            newest = min((r.app_id for r in holding), key=names.index)
            return logs.where(F.col("app_id") == newest)
        done, many = done + len(names), 4 * many
    rest = left.offset(done)
    return log_search(logs.join(rest.select("app_id"), "app_id", "left_semi"), rest, text, log_types)


def _flags(log_types: tuple[str, ...] = LOG_TYPES, **tests: Column) -> list[Column]:
    """Aggregates ``<test>_<type>``: whether a line of that log passes the test."""
    return [
        F.coalesce(F.max(F.when(F.col("log_type") == t, test)), F.lit(False)).alias(f"{name}_{t}")
        for t in log_types
        for name, test in tests.items()
    ]


def _verdict() -> Column:
    """The job's status from the flags: that of the first log with one, or null."""
    return F.coalesce(*[_of(t) for t in LOG_TYPES])


def _of(log_type: str) -> Column:
    """What the flags of one log say."""
    return (
        F.when(F.col(f"failed_{log_type}"), "FAILURE")
        .when(F.col(f"succeeded_{log_type}"), "SUCCESS")
        .when(F.col(f"exception_{log_type}"), "FAILURE")
        .when(F.col(f"present_{log_type}"), F.col("final_status"))
    )


def log_status(
    logs: DataFrame, apps: DataFrame, job: str, strict_reference: bool = False
) -> DataFrame:
    """``app_id, status`` of the newest application that tells how ``job`` ended.

    In each log ``<job> FAILED`` counts before ``<job> SUCCEEDED``, then any
    ``Exception``, and last that the id appears at all, which yields the
    application's final status; ``stderr`` counts before ``stdout``. Only
    applications with the id in a log are looked at. ``strict_reference`` drops
    that rule, so an ``Exception`` of any newer application is a failure too.
    """
    return _told(logs, apps, job, strict_reference).select("app_id", "status")


def failed_log(
    logs: DataFrame, apps: DataFrame, job: str, strict_reference: bool = False
) -> DataFrame:
    """The lines of the log that tells of the failure ``log_status`` reports; none otherwise."""
    told = _told(logs, apps, job, strict_reference).where(F.col("status") == "FAILURE")
    # One row at most, like the status.
    return logs.join(F.broadcast(told.select("app_id", "log_type")), ["app_id", "log_type"])


def _told(logs: DataFrame, apps: DataFrame, job: str, strict_reference: bool) -> DataFrame:
    """One row: the application, its verdict and the log type that tells it."""
    line = F.col("line")
    told = (
        logs.where(F.col("log_type").isin(*LOG_TYPES))
        .where(line.contains(job) | line.contains("Exception"))
        .groupBy("app_id")
        .agg(
            *_flags(
                failed=line.contains(f"{job} FAILED"),
                succeeded=line.contains(f"{job} SUCCEEDED"),
                exception=line.contains("Exception"),
                present=line.contains(job),
            )
        )
    )
    if not strict_reference:
        told = told.where(reduce(lambda a, b: a | b, [F.col(f"present_{t}") for t in LOG_TYPES]))
    return (
        told.join(apps, "app_id")
        .withColumn("status", _verdict())
        .where(F.col("status").isNotNull())
        .orderBy(F.col("finished_time").desc_nulls_last(), F.col("app_id").desc())
        .limit(1)
        .withColumn("log_type", F.coalesce(*[F.when(_of(t).isNotNull(), t) for t in LOG_TYPES]))
    )


def job_status(logs: DataFrame, apps: DataFrame, id_pattern: str = JOB_ID) -> DataFrame:
    """``log_status`` of every job named in the logs: ``app_id, job, status``,
    one row per application and job.

    ``id_pattern`` finds the ids in a line (its group 1). The logs are read once: a line
    with an exception counts for each id in it and for the application as a whole (job
    null). Flags are aggregated map-side, so a chatty application sends few rows to
    the shuffle, and its few jobs then take over what holds for the application.
    """
    line = F.col("line")
    ids = F.array_distinct(F.regexp_extract_all("line", F.lit(id_pattern), F.lit(1)))
    whole = F.when(line.contains("Exception"), F.array(F.lit(None).cast("string"))).otherwise(
        F.array().cast("array<string>")
    )
    named = F.col("job").isNotNull()
    told = (
        logs.where(F.col("log_type").isin(*LOG_TYPES))
        .select("app_id", "log_type", F.explode(F.concat(ids, whole)).alias("job"), "line")
        .groupBy("app_id", "job")
        .agg(
            *_flags(
                failed=F.contains("line", F.concat("job", F.lit(" FAILED"))),
                succeeded=F.contains("line", F.concat("job", F.lit(" SUCCEEDED"))),
                exception=~named,
                present=named,
            )
        )
    )
    of_app = Window.partitionBy("app_id")
    for t in LOG_TYPES:
        told = told.withColumn(f"exception_{t}", F.max(f"exception_{t}").over(of_app))
    return (
        told.where(named)
        .join(apps.select("app_id", "final_status"), "app_id")
        .select("app_id", "job", _verdict().alias("status"))
    )


def log_events(logs: DataFrame) -> DataFrame:
    """The marker, time, duration and dependency lines: ``app_id, log_type, job, task,
    event, event_time, seconds, minutes, hours, depends_on``.

    ``DEPENDS_ON`` names the other task in ``depends_on``; ``MISSING`` is a task that
    others depend on and that is not there.
    """
    line = F.col("line")
    last_word = F.substring_index(line, " ", -1)
    # What a line can be by its ends alone, so that one pattern is tried on it.
    is_time = line.endswith(" GMT...")
    is_duration = line.startswith("Processing time for task ")
    is_marker = last_word.isin(*MARKERS)
    is_missing = line.endswith(" missing as dependency")
    is_depends = line.startswith("Task ") & line.contains(" depends on Task ")
    kind = (
        F.when(is_time, "time")
        .when(is_duration, "duration")
        .when(is_missing, "missing")
        .when(is_depends, "depends")
        .otherwise("marker")
    )
    known = (
        F.when(is_time, line.rlike(TIME_LINE))
        .when(is_duration, line.rlike(SECONDS_LINE))
        .when(is_missing, line.rlike(MISSING_LINE))
        .when(is_depends, line.rlike(DEPENDS_LINE))
        .otherwise(is_marker & line.rlike(MARKER_LINE))
    )

    def part(of: str, pattern: str, group: int) -> Column:
        return F.when(F.col("kind") == of, F.regexp_extract(line, pattern, group))

    matched = (
        logs.where(known)
        .withColumn("kind", kind)
        .select(
            "app_id",
            "log_type",
            "kind",
            part("marker", MARKER_LINE, 1).alias("job"),
            last_word.alias("marker"),
            F.coalesce(
                part("time", TIME_LINE, 1),
                part("duration", SECONDS_LINE, 1),
                part("missing", MISSING_LINE, 1),
                part("depends", DEPENDS_LINE, 1),
            ).alias("task"),
            part("depends", DEPENDS_LINE, 2).alias("depends_on"),
            part("time", TIME_LINE, 2).alias("end"),
            # The 19 characters before " GMT..." of a line of that pattern.
            F.when(F.col("kind") == "time", F.substring(line, -26, 19)).alias("moment"),
            part("duration", SECONDS_LINE, 2).try_cast("double").alias("seconds"),
        )
    )
    event = (
        F.when(F.col("kind") == "marker", F.col("marker"))
        .when(F.col("kind") == "duration", "TIMED")
        .when(F.col("kind") == "missing", "MISSING")
        .when(F.col("kind") == "depends", "DEPENDS_ON")
        .when(F.col("end") == "", "STARTED")
        .otherwise(F.upper("end"))
    )
    return matched.select(
        "app_id",
        "log_type",
        "job",
        "task",
        event.alias("event"),
        F.col("moment").try_cast("timestamp_ntz").alias("event_time"),
        "seconds",
        (F.col("seconds") / 60).alias("minutes"),
        (F.col("seconds") / 3600).alias("hours"),
        "depends_on",
    )


def app_summary(events: DataFrame) -> DataFrame:
    """One row per application of ``log_events``: how often each marker came,
    first start, last end and total seconds."""
    marked, event = F.col("job").isNotNull(), F.col("event")

    def times(kind: str) -> Column:
        return F.count(F.when(marked & (event == kind), 1))

    ended = event.isin("SUCCEEDED", "FAILED", "BROKEN")
    return events.groupBy("app_id").agg(
        F.max("job").alias("job"),
        times("STARTED").alias("started"),
        times("SUCCEEDED").alias("succeeded"),
        times("FAILED").alias("failed"),
        F.min(F.when(event == "STARTED", F.col("event_time"))).alias("first_start"),
        F.max(F.when(ended, F.col("event_time"))).alias("last_end"),
        F.sum("seconds").alias("seconds"),
    )
