"""ARC and WARC records, there and back, and what the query returns."""

import base64
import gzip
import hashlib
import io

import pytest

from tableops.llm import archives
from tableops.llm import queries as registered
from tableops.llm.base import fresh_folder, table

SF_DIR = "/root/testdata/sf0.001"


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def through(spark, pages, min_bytes=0):
    arc, warc = fresh_folder(spark, "arc"), fresh_folder(spark, "warc")
    archives.write_arc(pages, arc)
    archives.convert(spark, arc, warc, min_bytes)
    return archives.warc_records(spark, warc, payloads=True), arc, warc


def plain(rows, min_bytes=0):
    first = {}
    for page, html in rows:
        body = (html or "").encode()
        if len(body) >= min_bytes and page is not None:
            first[body] = min(first.get(body, page), page)
    out = []
    for page, html in rows:
        body = (html or "").encode()
        again = body in first and first[body] != page
        kind, refers = ("revisit", first[body]) if again else ("response", None)
        out.append((page, len(body), digest(body), kind, refers))
    return sorted(out, key=str)


def values(df):
    names = "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_whole_table(spark):
    pages = table(spark, SF_DIR, "pages")
    rows = [(r.page_id, r.html) for r in pages.collect()]
    found, _, _ = through(spark, pages)
    assert values(found) == plain(rows)
    assert {r.page_id: r.payload.decode() for r in found.where("payload IS NOT NULL").collect()} == dict(rows)


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_copies_and_odd_rows(spark, min_bytes):
    rows = [(3, "same"), (1, "same"), (2, "same"), (4, ""), (5, None), (6, "WARC/1.1\r\n\r\nx"), (7, "a\n\r\n\r\nb"),
            (8, "é" * 10), (9, "é" * 10), (9, "é" * 10), (10, "filedesc://x 0 1\n"), (11, "x" * 3_000_000), (None, "lone")]
    urls = ["http://a.example/x y", None, "", "dns:host", "HTTPS://b.example/é\n", "filedesc://x.arc", "ftp://c/"]
    pages = spark.createDataFrame(
        [(p, urls[i % 7], h, i) for i, (p, h) in enumerate(rows)], "page_id long, url string, html string, block int"
    )
    found, _, _ = through(spark, pages.repartition(3), min_bytes)
    assert values(found) == plain(rows, min_bytes)
    kept = {r.uri for r in found.collect()}
    assert {"unknown:", "dns:host", "%66iledesc://x.arc", "ftp://c/"} <= kept


def test_query(spark):
    """Every kind of address is a response or a revisit; the rows are the contract's."""
    rows = [(r.page_id, r.html) for r in table(spark, SF_DIR, "pages").collect()]
    assert values(registered.op8_arc_to_warc(spark, SF_DIR)) == plain(rows)


def test_a_page_that_looks_like_a_version_block():
    """An address of that form alone, or the block's text alone, does not make one."""
    text = archives.arc_version_block(2, "x.arc", "20240101000000")
    stream = archives.arc_version_block(1, "f.arc", "20240101000000") + b"\n"
    for url, block in (("filedesc://x.arc", b"HTTP/1.1 200 OK\r\n\r\nhi"), ("http://a/", text)):
        stream += archives.arc_record(1, url, "20240101000000", "text/plain", block, 0, "f.arc") + b"\n"
    stream += f"filedesc://y.arc 0.0.0.0 20240101000000 text/html {len(b'HTTP/1.1 200')}\nHTTP/1.1 200\n".encode()
    records = list(archives.read_arc(io.BytesIO(stream)))
    assert [archives.warc_type(r) for r in records] == ["warcinfo", "response", "resource", "response"]
    assert {r.version for r in records} == {1}


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    found, _, _ = through(spark, pages)
    assert found.collect() == []


def test_files_are_plain_archives(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x"), (2, "http://b/", "<p>x")], "page_id long, url string, html string")
    _, arc, warc = through(spark, pages.coalesce(1))
    kinds = []
    for path, content in spark.read.format("binaryFile").load(warc).select("path", "content").collect():
        data = gzip.decompress(content)
        assert path.endswith(".gz") and data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")
        for fields, block in archives.read_warc(io.BytesIO(data)):
            kinds.append(fields["warc-type"])
            if "warc-block-digest" in fields:
                assert fields["warc-block-digest"] == f"sha1:{digest(block)}"
            if fields["warc-type"] == "revisit":
                assert block.startswith(b"HTTP/1.1 200 OK") and block.endswith(b"\r\n\r\n")
    assert sorted(kinds) == ["response", "revisit", "warcinfo"] or sorted(kinds) == ["response", "revisit", "warcinfo", "warcinfo"]
    stored = spark.read.format("binaryFile").load(arc).select("content").collect()
    assert gzip.decompress(stored[0][0]).startswith(b"filedesc://part-00000.arc 0.0.0.0 20240101000000 text/plain")


def test_both_arc_versions():
    for version in (1, 2):
        stream = archives.arc_version_block(version, "f.arc", "20240102030405") + b"\n"
        for i, block in enumerate((b"HTTP/1.1 200 OK\r\n\r\nbody\n", b"", b"raw\n\n")):
            stream += archives.arc_record(version, f"http://a/{i}", "2024010203", "text/html", block, 0, "f.arc") + b"\n"
        records = list(archives.read_arc(io.BytesIO(stream + stream)))
        assert [r.version for r in records] == [version] * 8
        assert [r.block for r in records[1:4]] == [b"HTTP/1.1 200 OK\r\n\r\nbody\n", b"", b"raw\n\n"]
        assert archives.warc_date(records[1].date) == "2024-01-02T03:00:00Z"
        with pytest.raises(ValueError, match="cut short"):
            list(archives.read_arc(io.BytesIO(stream[:-6])))
    with pytest.raises(ValueError, match="no ARC version block"):
        list(archives.read_arc(io.BytesIO(b"http://a 0.0.0.0 2024 x text/html 0\n\n")))
    with pytest.raises(ValueError, match="header line"):
        odd = archives.arc_version_block(1, "f.arc", "2024") + b"\nhttp://a 0.0.0.0 2024 x text/html 0\n\n"
        list(archives.read_arc(io.BytesIO(odd)))
