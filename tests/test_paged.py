"""Paged APIs: links, statuses and retries, without a server."""

import io
import json
import urllib.error
from email.message import Message

import pytest

from tableops.sources import api, paged


class Answers:
    """Stands for the network: what each request to an address is answered, in turn."""

    def __init__(self, answers):
        self.answers, self.asked = answers, []

    def open(self, request, timeout):
        url = request.full_url
        self.asked.append((url, request.get_header("Authorization")))
        answer = self.answers[url].pop(0) if isinstance(self.answers[url], list) else self.answers[url]
        if isinstance(answer, Exception):
            raise answer
        status, body, *rest = answer
        headers = Message()
        for name, value in (rest[0] if rest else {}).items():
            headers[name] = value
        if status >= 400:
            raise urllib.error.HTTPError(url, status, "no", headers, None)
        out = io.BytesIO(body.encode())
        out.status, out.headers = status, headers
        return out


def read(answers, endpoint="a", **reading):
    waits, net = [], Answers(answers)
    reading = paged.Reading(**{"base_url": "http://h/", "link": "meta.next", **reading})
    try:
        rows = list(paged.pages(reading, endpoint, net, waits.append))
    except Exception as e:
        rows = e
    return rows, waits, net.asked


def page(n, after=None):
    return json.dumps({"data": [{"n": n}], "meta": {"next": after}})


def test_links_are_followed():
    rows, waits, _ = read({"http://h/a": (200, page(1, "b?p=2")), "http://h/b?p=2": (200, page(2, "/c")), "http://h/c": (200, page(3))})
    assert [(r[0], r[1], r[2], r[3]) for r in rows] == [
        ("a", 1, "http://h/a", 200), ("a", 2, "http://h/b?p=2", 200), ("a", 3, "http://h/c", 200)
    ] and not waits
    header = {"Link": '<http://h/z>; rel="last", <x>; rel="next"'}
    rows, _, _ = read({"http://h/a": (200, "[]", header), "http://h/x": (200, "[]")}, link="header")
    assert [r[2] for r in rows] == ["http://h/a", "http://h/x"]
    rows, _, _ = read({"http://h/a": (200, page(1, "b"))}, link=None)
    assert len(rows) == 1
    rows, _, _ = read({"http://h/a": (200, "[1, 2]")}, link="meta.next")
    assert len(rows) == 1


def test_links_in_a_circle_stop():
    rows, _, _ = read({"http://h/a": (200, page(1, "b")), "http://h/b": (200, page(2, "a"))})
    assert isinstance(rows, paged.ApiError) and "comes again" in str(rows)


def test_passing_troubles_are_tried_again():
    answers = [(503, ""), (429, "", {"Retry-After": "7"}), urllib.error.URLError("reset"), (200, page(1))]
    rows, waits, asked = read({"http://h/a": list(answers)}, wait=0.5)
    assert len(rows) == 1 and waits == [0.5, 7.0, 2.0] and len(asked) == 4
    rows, waits, _ = read({"http://h/a": list(answers)}, retries=2)
    assert isinstance(rows, paged.ApiError) and len(waits) == 2
    rows, waits, _ = read({"http://h/a": (503, "", {"Retry-After": "9999"})}, retries=1)
    assert isinstance(rows, paged.ApiError) and waits == [60.0]


@pytest.mark.parametrize("status", [204, 301, 401, 404])
def test_other_statuses_stop_at_once(status):
    rows, waits, asked = read({"http://h/a": (status, "")})
    assert isinstance(rows, paged.ApiError) and str(status) in str(rows) and not waits and len(asked) == 1


def test_credentials_stay_with_their_host():
    pages = {"http://h/a": (200, page(1, "http://other/b")), "http://other/b": (200, page(2))}
    rows, _, asked = read(pages, user="me", token="secret")
    assert len(rows) == 2 and asked[0][1].startswith("Basic ") and asked[1][1] is None


def files(folder, n_endpoints, n_pages):
    for e in range(n_endpoints):
        for p in range(1, n_pages + 1):
            after = f"e{e}-{p + 1}.json" if p < n_pages else None
            (folder / f"e{e}-{p}.json").write_text(page(100 * e + p, after))
    return [f"e{e}-1.json" for e in range(n_endpoints)]


def test_a_task_for_each_endpoint(spark, tmp_path):
    names = files(tmp_path, 5, 4)
    df = paged.read_pages(spark, names, f"file://{tmp_path}/", link="meta.next")
    assert df.rdd.getNumPartitions() == 5
    got = sorted((r.endpoint, r.page, r.status) for r in df.collect())
    assert got == sorted((n, p, 200) for n in names for p in range(1, 5))
    rows = api.records(df, "n int", items="data")
    assert sorted(r.n for r in rows.collect()) == sorted(100 * e + p for e in range(5) for p in range(1, 5))
    assert paged.read_pages(spark, [], "file:///").collect() == []


def test_a_missing_page_stops_the_job(spark, tmp_path):
    (tmp_path / "a.json").write_text(page(1, "gone.json"))
    with pytest.raises(Exception, match="gone.json can't be read"):
        paged.read_pages(spark, ["a.json"], f"file://{tmp_path}/", link="meta.next", wait=0.01).collect()
