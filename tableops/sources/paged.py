"""A paged JSON API as a data source: a partition for each endpoint.

Imports nothing of this package: executors get this module's code with the job.
"""

from __future__ import annotations

import base64
import json
import sys
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "endpoint string, page int, url string, status int, body string"
#: Answers that may be other ones a little later.
PASSING = (408, 425, 429, 500, 502, 503, 504)
_LONGEST_WAIT = 60.0


class ApiError(RuntimeError):
    """An answer that is no page: its status, or links that go in a circle."""


class SameHost(urllib.request.HTTPRedirectHandler):
    """Follows redirects, but takes no credentials to another host."""

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        new = super().redirect_request(req, fp, code, msg, headers, newurl)
        if new is not None and urlsplit(newurl)[:2] != urlsplit(req.full_url)[:2]:
            new.remove_header("Authorization")
        return new


@dataclass(frozen=True)
class Reading:
    """How pages are asked for.

    ``link`` names where a page has the address of the next one: a dotted path in its
    body, or ``header`` for a ``Link`` header with ``rel="next"``; none reads one page. A request that fails on the
    way or answers one of ``PASSING`` is sent again up to ``retries`` times, after ``wait`` seconds that
    double each time, or what the answer asks for, a minute at most.
    """

    base_url: str = ""
    user: str | None = None
    token: str | None = None
    link: str | None = None
    retries: int = 3
    wait: float = 1.0
    timeout: float = 60.0

    def headers(self, url: str) -> dict[str, str]:
        """Credentials go to the host of ``base_url`` only."""
        out = {"Accept": "application/json"}
        if self.user is not None and urlsplit(url)[:2] == urlsplit(self.base_url)[:2]:
            pair = base64.b64encode(f"{self.user}:{self.token or ''}".encode()).decode()
            out["Authorization"] = f"Basic {pair}"
        return out


def _next_link(reading: Reading, body: str, headers) -> str | None:
    if reading.link is None:
        return None
    if reading.link == "header":
        for part in (headers.get("Link") or "").split(","):
            address, _, rest = part.partition(";")
            if 'rel="next"' in rest.replace(" ", "").replace("'", '"'):
                return address.strip().strip("<>")
        return None
    value = json.loads(body)
    for name in reading.link.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    return value or None


def _answer(reading: Reading, url: str, opener, sleep: Callable[[float], None]):
    """``(status, headers, body)`` of a page; anything but 200 is an error in the end."""
    for left in range(reading.retries, -1, -1):
        wait = reading.wait * 2 ** (reading.retries - left)
        try:
            request = urllib.request.Request(url, headers=reading.headers(url))
            with opener.open(request, timeout=reading.timeout) as response:
                status = response.status or 200
                if status == 200:
                    return status, response.headers, response.read().decode("utf-8")
                problem = f"{url} answered with status {status}"
        except urllib.error.HTTPError as e:
            status, problem = e.code, f"{url} answered with status {e.code}"
            asked = (e.headers or {}).get("Retry-After") or ""
            wait = float(asked) if asked.isdigit() else wait
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            status, problem = None, f"{url} can't be read: {e}"
            if isinstance(getattr(e, "reason", None), FileNotFoundError):
                left = 0
        if not left or status is not None and status not in PASSING:
            raise ApiError(problem)
        sleep(min(wait, _LONGEST_WAIT))
    raise AssertionError("unreachable")


def pages(
    reading: Reading, endpoint: str, opener=None, sleep: Callable[[float], None] = time.sleep
) -> Iterator[tuple[str, int, str, int, str]]:
    """The pages of an endpoint, one after the other: rows of ``SCHEMA``."""
    opener = opener or urllib.request.build_opener(SameHost)
    url: str | None = reading.base_url + endpoint
    seen: set[str] = set()
    while url is not None:
        if url in seen:
            raise ApiError(f"{url} comes again after {len(seen)} pages of {endpoint}")
        seen.add(url)
        status, headers, body = _answer(reading, url, opener, sleep)
        yield endpoint, len(seen), url, status, body
        after = _next_link(reading, body, headers)
        url = urljoin(url, after) if after else None


@dataclass
class Endpoint(InputPartition):
    name: str

    def __post_init__(self):
        super().__init__(self.name)


class ApiReader(DataSourceReader):
    def __init__(self, reading: Reading, endpoints: list[str]):
        self.reading, self.endpoints = reading, endpoints

    def partitions(self) -> list[InputPartition]:
        return [Endpoint(e) for e in self.endpoints]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if isinstance(partition, Endpoint):  # without endpoints Spark asks with none
            yield from pages(self.reading, partition.name)


class JsonApi(DataSource):
    """``spark.read.format("json_api")``; options ``endpoints`` (a JSON list) and those of ``Reading``."""

    @classmethod
    def name(cls) -> str:
        return "json_api"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        reading = Reading(
            o.get("base_url", ""), o.get("user"), o.get("token"), o.get("link"),
            int(o.get("retries", 3)), float(o.get("wait", 1.0)), float(o.get("timeout", 60.0)),
        )
        return ApiReader(reading, json.loads(o["endpoints"]))


def register(spark: SparkSession) -> None:
    """Make ``json_api`` known to the session; its code goes to the executors by value."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(JsonApi)


def read_pages(spark: SparkSession, endpoints: list[str], base_url: str = "", **reading) -> DataFrame:
    """All pages of all endpoints: ``endpoint, page, url, status, body``, a task for each endpoint.

    ``reading`` as in ``Reading``. Pages of an endpoint follow one another, so an API with
    many rows is read faster from many endpoints. An answer other than 200 that retries don't mend,
    an address without a page and links in a circle stop the job.
    """
    register(spark)
    options = {k: str(v) for k, v in reading.items() if v is not None}
    reader = spark.read.format("json_api").options(base_url=base_url, **options)
    return reader.option("endpoints", json.dumps(list(endpoints))).load()
