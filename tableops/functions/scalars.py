"""Column functions: times, names, sizes, URLs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def event_time(df: DataFrame, name: str) -> Column:
    """``name`` as a time. Text is parsed; text that is no time becomes null."""
    if isinstance(df.schema[name].dataType, _TIME_TYPES):
        return F.col(name)
    return F.col(name).try_cast("timestamp")


def time_bound(dtype: T.DataType, value) -> Column:
    """``value`` (of ``high_watermark``) as a literal to compare a time of this type with.

    A time without zone stays without: as a plain literal it would be taken through
    the session's zone. A zoned one comes back from Spark in the zone of this process.
    """
    if isinstance(dtype, T.TimestampNTZType) and isinstance(value, datetime):
        return F.lit(value.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(dtype, (T.DateType, T.TimestampNTZType)):
        return F.lit(value).cast(dtype)
    return F.lit(value.astimezone() if isinstance(value, datetime) else value).cast("timestamp")


def between_times(df: DataFrame, name: str, low=None, high=None) -> Column:
    """Whether the time ``name`` is in these bounds, both included; pushed to a source."""
    dtype, time, inside = df.schema[name].dataType, event_time(df, name), F.lit(True)
    if low is not None:
        inside = time >= time_bound(dtype, low)
    if high is not None:
        upto = time <= time_bound(dtype, high)
        inside = upto if low is None else inside & upto
    return inside


def format_seconds(ts: Column) -> Column:
    """A time as text in whole seconds; fractions are cut off.

    A cast, unlike ``date_format``, takes a time without zone through no zone.
    """
    return F.substring(ts.cast("string"), 1, 19)


def millis_to_time(ms: Column) -> Column:
    """Epoch milliseconds as a UTC time without zone, whatever the session zone."""
    return F.timestamp_add("MILLISECOND", ms, F.lit("1970-01-01").cast("timestamp_ntz"))


def time_to_millis(ts: Column) -> Column:
    """A UTC time without zone as epoch milliseconds."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def elapsed_minutes(start: Column, end: Column) -> Column:
    """Whole minutes from ``start`` to ``end``, counted from whole seconds."""
    zero = F.lit("1970-01-01").cast("timestamp_ntz")
    seconds = F.timestamp_diff("SECOND", zero, end) - F.timestamp_diff("SECOND", zero, start)
    return F.floor(seconds / 60).cast("long")


def whole_gb(size: Column) -> Column:
    return F.floor(size / (1024**3)).cast("long")


_AROUND_NAMES = " \t\r\n"
_IN_NAMES, _BECOMES = " /", "__"


def normalize_name(name: Column) -> Column:
    """Trimmed, lower case, blanks and slashes as underscores."""
    return F.translate(F.lower(F.btrim(name, F.lit(_AROUND_NAMES))), _IN_NAMES, _BECOMES)


def normalized_names(names: list[str]) -> list[str]:
    """``normalize_name`` for a header; every name must be usable and unique."""
    table = str.maketrans(_IN_NAMES, _BECOMES)
    out = [n.strip(_AROUND_NAMES).lower().translate(table) for n in names]
    if "" in out:
        raise ValueError("a header cell is empty")
    if len(set(out)) < len(out):
        raise ValueError(f"header names are not unique: {sorted(out)}")
    return out


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*normalized_names(df.columns))


def url_host(url: Column) -> Column:
    """The host of a URL, null where the text is no URL."""
    return F.try_parse_url(url, F.lit("HOST"))


def url_segment(url: Column, position: int) -> Column:
    """One piece of a URL split at slashes; negative positions count from the end."""
    return F.try_element_at(F.split(url, "/"), F.lit(position))


def json_value(doc: Column, path: str) -> Column:
    return F.get_json_object(doc, path)


def split_names(names: Column) -> Column:
    """A comma list as an array of trimmed names."""
    return F.transform(F.split(names, ","), lambda name: F.trim(name))
