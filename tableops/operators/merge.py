"""Latest row per key: the merge at the heart of incremental replication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableops.functions.scalars import event_time, format_seconds

_TIME = "__merge_time"
_SIDE = "__merge_side"
_RANK = "__merge_rank"


def union_all(base: DataFrame, delta: DataFrame, by_position: bool = False) -> DataFrame:
    """Both row sets. By name, a column one side lacks is null there."""
    if by_position:
        return base.union(delta)
    return base.unionByName(delta, allowMissingColumns=True)


def latest_per_key(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The greatest ``ts`` of each key."""
    return df.groupBy(*keys).agg(F.max(event_time(df, ts)).alias(ts))


def watermark(df: DataFrame, ts: str) -> DataFrame:
    """One row: the greatest ``ts``, and the same as text in whole seconds."""
    top = df.agg(F.max(event_time(df, ts)).alias("watermark"))
    mark = F.col("watermark")
    if isinstance(top.schema["watermark"].dataType, T.DateType):
        mark = mark.cast("timestamp_ntz")
    return top.withColumn("watermark_text", format_seconds(mark))


def high_watermark(df: DataFrame, ts: str):
    """The greatest ``ts`` as a Python value; a table without one is an error."""
    value = watermark(df, ts).select("watermark").first()[0]
    if value is None:
        raise ValueError(f"no value of {ts}: the table is empty or holds only nulls")
    return value


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``tablename, row_count`` of many tables, counted by one job."""
    counts = [
        row_count(df).select(F.lit(name).alias("tablename"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.union, counts)


def _sortable(dtype: T.DataType) -> bool:
    if isinstance(dtype, (T.MapType, T.VariantType)):
        return False
    if isinstance(dtype, T.ArrayType):
        return _sortable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_sortable(f.dataType) for f in dtype.fields)
    return True


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def latest_rows(
    df: DataFrame,
    keys: list[str],
    ts: str,
    ties: str = "all",
    form: str | None = None,
    prefer: list[Column] | None = None,
    keep_null_ts: bool = False,
) -> DataFrame:
    """The rows that carry the greatest ``ts`` of their key.

    Rows with a null key drop out, and rows with a null ``ts`` too unless
    ``keep_null_ts`` is set and the key has no other time.

    ``ties="all"`` keeps every row at the greatest time, ``ties="one"`` a single
    row, picked by ``prefer`` and then by the other columns, so that a second
    run picks the same one.

    ``form`` names the plan:

    * ``"window"`` ranks rows in one scan. Spark cuts each map task's share of a
      key before the shuffle, so with ``ties="one"`` a hot key sends one row per
      map task. It is always used there.
    * ``"join"`` (for ``ties="all"`` the default) aggregates the greatest times
      map-side over the narrow columns and semi-joins on key *and* time. A key
      with many rows spreads over its times, and a key with many rows at one
      time is a skewed join partition, which adaptive execution splits; a window
      would take such a group through one task. ``df`` is read twice, so write a
      source that may change in between to a table first.
    """
    if ties not in ("all", "one"):
        raise ValueError(f"ties must be 'all' or 'one', not {ties!r}")
    form = form or ("window" if ties == "one" else "join")
    if form not in ("window", "join") or (form, ties) == ("join", "one"):
        raise ValueError(f"no form {form!r} for ties={ties!r}")
    rows = df.withColumn(_TIME, event_time(df, ts))
    needed = keys if keep_null_ts else [*keys, _TIME]
    rows = rows.where(_all([F.col(c).isNotNull() for c in needed]))

    if form == "join":
        top = rows.groupBy(*keys).agg(F.max(_TIME).alias(_TIME))
        if not keep_null_ts:
            return rows.join(top, [*keys, _TIME], "left_semi").drop(_TIME)
        left, right = rows.alias("r"), top.alias("t")
        same = [F.col(f"r.{k}") == F.col(f"t.{k}") for k in keys]
        same.append(F.col(f"r.{_TIME}").eqNullSafe(F.col(f"t.{_TIME}")))
        return left.join(right, _all(same), "left_semi").drop(_TIME)

    order = [F.col(_TIME).desc_nulls_last()]
    rank = F.rank()
    if ties == "one":
        rest = [f.name for f in df.schema.fields if f.name not in keys and _sortable(f.dataType)]
        order += [*(prefer or []), *[F.col(c).desc_nulls_last() for c in rest]]
        rank = F.row_number()
    ranked = rows.withColumn(_RANK, rank.over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(_RANK) == 1).drop(_RANK, _TIME)


def merge_latest(
    base: DataFrame,
    delta: DataFrame,
    keys: list[str],
    ts: str,
    ties: str = "all",
    form: str | None = None,
    by_position: bool = False,
    keep_null_ts: bool = False,
) -> DataFrame:
    """``latest_rows`` of ``base`` and ``delta`` together.

    With ``ties="one"`` a delta row wins over a base row of the same time. With
    ``ties="all"`` both stay, and so does a row that is in both inputs.
    """
    if ties == "all":
        both = union_all(base, delta, by_position)
        return latest_rows(both, keys, ts, ties, form, keep_null_ts=keep_null_ts)
    both = union_all(
        base.withColumn(_SIDE, F.lit(0)), delta.withColumn(_SIDE, F.lit(1)), by_position
    )
    out = latest_rows(
        both, keys, ts, ties, form, prefer=[F.col(_SIDE).desc()], keep_null_ts=keep_null_ts
    )
    return out.drop(_SIDE)


def row_content(df: DataFrame, columns: list[str]) -> Column:
    """Two 64-bit hashes of ``columns`` of a row; columns without an order count as JSON."""
    cells = [F.col(c) if _sortable(df.schema[c].dataType) else F.to_json(F.struct(c)) for c in columns]
    nulls = F.concat(*[F.col(c).isNull().cast("string") for c in columns])
    return F.struct(F.xxhash64(*cells, nulls).alias("one"), F.xxhash64(nulls, *cells).alias("two"))


def content_summary(df: DataFrame) -> tuple[int, str]:
    """The number of rows and a text that depends on all they hold, in whatever order."""
    content = row_content(df, df.columns)
    sums = [F.sum(content[part].cast("decimal(20,0)")).cast("string") for part in ("one", "two")]
    n, one, two = df.agg(F.count(F.lit(1)), *sums).first()
    return n, f"{one}/{two}"


def upsert_newer(
    base: DataFrame, delta: DataFrame, keys: list[str], ts: str, buckets: int | None = None
) -> DataFrame:
    """``merge_latest(ties="one")`` for a base that needs no reduction.

    Holds when ``base`` has one row per key, without null keys or times, and no
    row of ``delta`` is older than its key's row in ``base``:
    then every delta key simply replaces its base row. The base is read once and filtered by an
    anti-join, not ranked: a delta small enough for Spark's own broadcast limit
    leaves it unshuffled, and a base bucketed on ``keys`` (``buckets``, the
    table's number) stays in its buckets whatever the size of the delta.
    """
    newest = latest_rows(delta, keys, ts, ties="one")
    if buckets:
        newest = newest.repartition(buckets, *keys)
    kept = base.join(newest.select(*keys), keys, "left_anti").select(*base.columns)
    return union_all(kept, newest)
