"""JSON APIs: fetch the endpoints on executors, shape the bodies in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableops.operators.tables import create_table, overwrite_table
from tableops.sources.paged import read_pages

_FETCHED = "url string, status int, body string"


def fetch(
    endpoints: DataFrame,
    base_url: str = "",
    user: str | None = None,
    token: str | None = None,
    partitions: int | None = None,
    timeout: float = 60.0,
) -> DataFrame:
    """GET ``base_url`` + each endpoint of a one-column frame: ``url, status, body``.

    The endpoints are spread over ``partitions`` tasks, by default one per core,
    which send the requests. A status other than 200 fails the job. ``file:`` and
    ``data:`` URLs are read as if they answered 200.
    """
    column = endpoints.columns[0]

    # Nested, with its imports inside: workers need no copy of this package.
    def get(batches):
        import base64
        import urllib.request
        from urllib.parse import urlsplit

        import pandas as pd

        class SameHost(urllib.request.HTTPRedirectHandler):
            """Follows redirects, but takes no credentials to another host."""

            def redirect_request(self, req, fp, code, msg, headers, newurl):
                new = super().redirect_request(req, fp, code, msg, headers, newurl)
                if new is not None and urlsplit(newurl)[:2] != urlsplit(req.full_url)[:2]:
                    new.remove_header("Authorization")
                return new

        opener = urllib.request.build_opener(SameHost)
        headers = {"Accept": "application/json"}
        if user is not None:
            pair = base64.b64encode(f"{user}:{token or ''}".encode()).decode()
            headers["Authorization"] = f"Basic {pair}"
        for batch in batches:
            for endpoint in batch[column]:
                url = base_url + endpoint
                request = urllib.request.Request(url, headers=headers)
                with opener.open(request, timeout=timeout) as response:
                    status = response.status or 200
                    if status != 200:
                        raise RuntimeError(f"{url} answered with status {status}")
                    body = response.read().decode("utf-8")
                yield pd.DataFrame({"url": [url], "status": [status], "body": [body]})

    tasks = partitions or endpoints.sparkSession.sparkContext.defaultParallelism
    return endpoints.repartition(tasks).mapInPandas(get, _FETCHED)


def records(
    bodies: DataFrame, element: str | T.StructType, body: str = "body", items: str | None = None
) -> DataFrame:
    """Rows of bodies that are lists of records; a missing field is null.

    ``element`` is the schema of a record. A body that is not JSON is an error. Bodies that are
    objects hold the list under ``items``, a dotted path; without it there they have no rows.
    """
    struct = element if isinstance(element, str) else element.simpleString()
    kind = "array<%s>" % (struct if struct.startswith("struct<") else f"struct<{struct}>")
    names = items.split(".") if items else []
    for name in reversed(names):
        kind = f"struct<`{name}`: {kind}>"
    parsed = F.from_json(F.col(body), kind, {"mode": "FAILFAST"})
    for name in names:
        parsed = parsed.getField(name)
    return bodies.select(F.inline(parsed))


def columns(bodies: DataFrame, fields: dict[str, str], body: str = "body") -> DataFrame:
    """Rows of bodies that are objects of equally long lists, one per column."""
    schema = ", ".join(f"`{name}`: array<{kind}>" for name, kind in fields.items())
    lists = bodies.select(
        F.from_json(F.col(body), f"struct<{schema}>", {"mode": "FAILFAST"}).alias("lists")
    )
    cells = [F.col(f"lists.`{name}`") for name in fields]
    sizes = F.array_distinct(F.array(*[F.coalesce(F.size(c), F.lit(-1)) for c in cells]))
    zipped = F.when(F.size(sizes) == 1, F.arrays_zip(*cells)).otherwise(
        F.raise_error("the lists of a body differ in length")
    )
    return lists.select(F.inline(zipped)).toDF(*fields)


def api_to_table(
    endpoints: DataFrame,
    name: str,
    element: str | T.StructType,
    overwrite: bool = False,
    **fetching,
) -> DataFrame:
    """Fetch record lists into table ``name``; one that is there is an error
    unless ``overwrite`` is set."""
    rows = records(fetch(endpoints, **fetching), element)
    return overwrite_table(rows, name) if overwrite else create_table(rows, name)


def paged_to_table(
    spark: SparkSession,
    endpoints: list[str],
    name: str,
    element: str | T.StructType,
    items: str | None = None,
    overwrite: bool = False,
    **reading,
) -> DataFrame:
    """``api_to_table`` for endpoints of many pages; ``reading`` as in ``read_pages``."""
    rows = records(read_pages(spark, endpoints, **reading), element, items=items)
    return overwrite_table(rows, name) if overwrite else create_table(rows, name)
