"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Patterns give candidate spans. Every candidate's value is hashed, and each hash is
counted by the distinct owners and repositories that hold it: an example key that
is widely copied has many owners, or few with many repositories, a live credential is in a few
repositories of one or two. The counts are
summed by (hash, owner, repository) before hashes are shuffled, so a value that a
third of all documents repeat arrives as a row per map task and owner.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableops.llm.base import staged


@dataclass(frozen=True)
class Kind:
    """``group`` of the match is the secret; shorter than ``least`` it is dropped."""

    name: str
    pattern: str
    group: int
    least: int
    base: bool = True
    also: tuple[str, ...] = ()


KINDS = (
    Kind(
        "assign",
        "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        8,
    ),
    Kind("access", "AKIA[A-Z0-9]+", 0, 16),
    # a run this long is found whole, and shorter runs are no match to begin with
    Kind("hex", "[0-9a-f]{32,}", 0, 32),
    # long mixed runs: credentials only if few owners have them
    Kind("bare", "[A-Za-z0-9_-]{24,}", 0, 24, False, ("[0-9]", "[A-Z]", "[a-z]")),
)


def _found(text: Column, number: int, kind: Kind) -> Column:
    """All matches of one kind, each with the characters between it and the one before."""
    pattern = F.lit(kind.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.transform(F.split(text, kind.pattern, -1), F.length)
    rows = F.transform(
        matches,
        lambda m, i: F.struct(
            F.lit(number).alias("kind"), i.alias("i"), F.get(between, i).alias("gap"), m.alias("match")
        ),
    )
    return F.when(text.rlike(kind.pattern), rows).otherwise(
        F.array().cast("array<struct<kind:int,i:int,gap:int,match:string>>")
    )


def _value(kind: Kind) -> Column:
    return F.regexp_extract("match", kind.pattern, kind.group) if kind.group else F.col("match")


def candidates(
    docs: DataFrame, text: str, owner: Column, repository: Column, *keep: str
) -> tuple[DataFrame, DataFrame]:
    """``(rows, spans)``: the numbered rows of ``docs`` and the candidates in them.

    The texts are read once; what was found is staged. A span has ``row``, ``kind``
    (its place in ``KINDS``), ``start`` and ``end`` in characters, ``hash``, owner
    and repository.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    found = F.flatten(F.array(*[_found(body, n, k) for n, k in enumerate(KINDS)]))
    rows = staged(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)],
            owner.alias("owner"),
            repository.alias("repository"),
            found.alias("found"),
        ),
        "secret-candidates",
    )
    before = Window.partitionBy("row", "kind").orderBy("i")
    value = F.coalesce(*[F.when(F.col("kind") == n, _value(k)) for n, k in enumerate(KINDS)])
    passes = F.lit(False)
    for n, k in enumerate(KINDS):
        fits = (F.col("kind") == n) & (F.length("value") >= k.least)
        for needed in k.also:
            fits &= F.col("value").rlike(needed)
        passes |= fits
    spans = (
        rows.select("row", "owner", "repository", F.inline("found"))
        .withColumn("end", F.sum(F.col("gap") + F.length("match")).over(before))
        .withColumn("start", F.col("end") - F.length("match"))
        .withColumn("value", value)
        .where(passes)
        .select(
            "row", "kind", "start", "end", F.sha2("value", 256).alias("hash"), "owner", "repository"
        )
    )
    return rows, spans


def ownership(spans: DataFrame) -> DataFrame:
    """``hash`` with its distinct owners and repositories, and how often it was found.

    A null owner or repository counts as one of its own.
    """
    each = spans.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = each.groupBy("hash", "owner").agg(
        F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n")
    )
    return by_owner.groupBy("hash").agg(
        F.count(F.lit(1)).alias("n_owners"),
        F.sum("repositories").alias("n_repositories"),
        F.sum("n").alias("n_found"),
    )


def scan(
    docs: DataFrame,
    *keep: str,
    text: str = "text",
    owner: Column | None = None,
    repository: Column | None = None,
    most_owners: int = 2,
    most_repositories: int = 4,
) -> DataFrame:
    """One row per row of ``docs``: its ``keep`` columns and its secrets.

    ``spans`` lists every span that is a secret by pattern and, of the bare runs that
    overlap none of them, the live-looking. A value looks live if at most ``most_owners``
    owners and ``most_repositories`` repositories hold it; ``n_live`` and
    ``n_example`` split all spans so. ``most_held`` is the number of repositories of the most
    widely copied value. Null and empty texts have none.
    """
    owner = F.col("source") if owner is None else owner
    repository = owner if repository is None else repository
    rows, spans = candidates(docs, text, owner, repository, *keep)
    base = F.col("kind").isin([n for n, k in enumerate(KINDS) if k.base])
    ordered = Window.partitionBy("row").orderBy("start", "kind")
    until = F.max(F.when(base, F.col("end"))).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(ordered.rowsBetween(1, Window.unboundedFollowing))
    judged = (
        spans.withColumn("until", until)
        .withColumn("after", after)
        .where(
            base
            | ((F.coalesce("until", F.lit(0)) <= F.col("start")))
            & (F.col("after").isNull() | (F.col("after") >= F.col("end")))
        )
        .join(ownership(spans), "hash")
        .withColumn(
            "live", (F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= most_repositories)
        )
        .where(base | F.col("live"))
    )
    names = F.array(*[F.lit(k.name) for k in KINDS])
    tag = F.concat_ws(":", F.get(names, F.col("kind")), "start", "end")
    of_row = (
        judged.groupBy("row")
        .agg(
            F.sort_array(F.collect_list(F.struct("start", "kind", base.alias("base"), tag.alias("tag")))).alias("all"),
            *[
                F.count(F.when(F.col("kind") == n, 1)).alias(f"n_{k.name}")
                for n, k in enumerate(KINDS)
            ],
            F.count(F.when(F.col("live"), 1)).alias("n_live"),
            F.count(F.when(~F.col("live"), 1)).alias("n_example"),
            F.max("n_repositories").alias("most_held"),
        )
    )
    counts = [f"n_{k.name}" for k in KINDS] + ["n_live", "n_example", "most_held"]
    tags = lambda xs: F.array_join(F.transform(xs, lambda x: x["tag"]), ",")
    return (
        rows.select("row", *[F.col(f"k{i}") for i in range(len(keep))])
        .join(of_row, "row", "left")
        .select(
            *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
            *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
            F.coalesce(tags(F.filter("all", lambda x: x["base"])), F.lit("")).alias("base_spans"),
            F.coalesce(tags(F.col("all")), F.lit("")).alias("spans"),
        )
    )
