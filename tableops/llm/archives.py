"""Web archives: legacy ARC files, and their conversion to WARC.

An ARC file holds records of one header line, a declared length and that many
bytes; which fields the line has is said by the version block that comes first
(``filedesc://``, versions 1 and 2). The converter reads these lines and lengths
and makes up what a WARC record has beyond them: an identifier, a date in ISO form,
a record type and digests of block and payload.

Spark writes and reads the files with its own text and binary file formats, so they
may lie in any store. Archives are cut by the input partitions, and a file is
unpacked record by record, so memory follows the largest record and the packed file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableops.llm.base import slices

# Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename "
    "Archive-length",
}
_VERSION_BLOCK = re.compile(rb"([12]) \d+ [^\n]*\nURL IP-address ")
WARC_VERSION = "WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Level of gzip, as Hadoop names it. ``BEST_COMPRESSION`` takes several times the CPU.
FAST = "BEST_SPEED"

_BATCH_BYTES = 4 << 20
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


@dataclass
class ArcRecord:
    version: int
    url: str
    ip: str
    date: str
    mime: str
    block: bytes
    describes: bool = False  # a version block


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _field(value: str | None, empty: str = "-") -> str:
    """One field of a header line: no white space, never empty, never that of a version block."""
    plain = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "") or empty
    return f"%66{plain[1:]}" if plain.startswith("filedesc://") else plain


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 tableops\n{ARC_FIELDS[version]}\n".encode()
    line = [f"filedesc://{name}", "0.0.0.0", date, "text/plain"]
    if version == 2:
        line += ["200", "-", "-", "0", name]
    return " ".join([*line, str(len(body))]).encode() + b"\n" + body


def arc_record(
    version: int, url: str | None, date: str, mime: str, block: bytes, offset: int, name: str
) -> bytes:
    line = [_field(url, "unknown:"), "0.0.0.0", date, _field(mime)]
    if version == 2:
        line += ["200", sha1_base32(block), "-", str(offset), name]
    return " ".join([*line, str(len(block))]).encode("utf-8", "surrogatepass") + b"\n" + block


def read_arc(stream: io.BufferedIOBase) -> Iterator[ArcRecord]:
    """The records of an unpacked ARC stream, version blocks included.

    A stream may hold several archives one after the other. A version block is known by its
    place, at the start or where the line has its address and the block its form; a page of
    such an address is a page. Empty lines between
    records are skipped. A record cut short or a line that does not fit the version is an error.
    """
    version, first = 1, True
    while line := stream.readline():
        if line in (b"\n", b"\r\n"):
            continue
        parts = line.decode("utf-8", "surrogateescape").rstrip("\r\n").split(" ")
        length = int(parts[-1])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError(f"ARC record cut short: {parts[0]}")
        described = _VERSION_BLOCK.match(block) if parts[0].startswith("filedesc://") else None
        if first and described is None:
            raise ValueError(f"no ARC version block: {line[:200]!r}")
        first = False
        if described:
            version = int(described[1])
        if len(parts) != len(ARC_FIELDS[version].split(" ")):
            raise ValueError(f"not a header line of ARC version {version}: {line[:200]!r}")
        yield ArcRecord(version, parts[0], parts[1], parts[2], parts[3], block, described is not None)


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """``(head, payload)``; without an HTTP head the block is all payload."""
    if block[:5] != b"HTTP/":
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[: end + 4], block[end + 4 :])


def warc_type(record: ArcRecord) -> str:
    """Blocks with an HTTP head are responses, whatever the address; others, as of dns, resources."""
    if record.describes:
        return "warcinfo"
    return "response" if record.block[:5] == b"HTTP/" else "resource"


def warc_date(arc_date: str) -> str:
    """The 14 digits of an ARC date (missing ones: the start) in ISO form."""
    d = arc_date + "00000101000000"[len(arc_date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, key: str) -> str:
    """The same record gets the same identifier in every run."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{key} {date} {url}')}>"


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """Header and block, without the two empty lines that end a record."""
    lines = [WARC_VERSION, *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block


def read_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:200]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            fields[name.lower()] = value.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError(f"WARC record cut short: {fields.get('warc-record-id')}")
        yield fields, block


def _unpacked(path: str, content: bytes) -> io.BufferedIOBase:
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw)) if path.endswith(".gz") else raw


def _batched(rows: Iterator[tuple], schema: pa.Schema, sized: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches of some megabytes of column ``sized``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[sized] or b"") + 200
        if size >= _BATCH_BYTES:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)],
                schema=schema,
            )
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)],
            schema=schema,
        )


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, io.BufferedIOBase]]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            yield path.as_py(), _unpacked(path.as_py(), content.as_py())


_LINE = pa.schema([("value", pa.binary())])


def write_arc(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    date: str = "20240101000000",
    level: str = FAST,
) -> None:
    """A gzipped ARC file for each partition of ``pages``, of version 1 and 2 in turn.

    The block is an HTTP response with the html in UTF-8 (null: empty) and the
    page's id (null: empty) in a header of its own.
    """
    rows = pages.select(
        F.coalesce(F.col(page_id).cast("string"), F.lit("")).alias("page_id"),
        F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("html"),
    )

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"part-{part:05d}.arc"

        def records():
            head = arc_version_block(version, name, date)
            offset = len(head) + 1
            for batch in slices(batches, "html"):
                for row in batch.to_pylist():
                    http = (
                        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                        f"X-Page-Id: {row['page_id']}\r\nContent-Length: {len(row['html'])}\r\n\r\n"
                    ).encode()
                    record = arc_record(
                        version, row["url"], date, "text/html", http + row["html"], offset, name
                    )
                    if head:
                        yield (head,)
                        head = b""
                    offset += len(record) + 1
                    yield (record,)

        yield from _batched(records(), _LINE, 0)

    (
        rows.mapInArrow(written, "value binary")
        .select(F.col("value").cast("string").alias("value"))
        .write.option("lineSep", "\n")
        .options(compression="gzip", **{"zlib.compress.level": level})
        .text(path)
    )


def _files(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "part-*")
        .load(path)
        .select("path", "content")
    )


_NARROW = [
    ("version", pa.int32()),
    ("page_id", pa.int64()),
    ("uri", pa.string()),
    ("warc_date", pa.string()),
    ("warc_type", pa.string()),
    ("record_id", pa.string()),
    ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()),
]
_NARROW_DDL = (
    "version int, page_id long, uri string, warc_date string, warc_type string, "
    "record_id string, payload_bytes long, payload_digest string"
)


def arc_records(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """The records of all ARC files under ``path`` with their WARC fields.

    One row per record but for version blocks; ``block`` (the bytes as archived) and
    ``block_digest`` only if asked for.
    """
    fields = [*_NARROW, ("block_digest", pa.string()), ("block", pa.binary())]
    schema = pa.schema(fields if blocks else _NARROW)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for _, stream in _blobs(batches):
                for r in read_arc(stream):
                    kind = warc_type(r)
                    if kind == "warcinfo":
                        continue
                    head, payload = split_http(r.block)
                    found = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", head)
                    page = int(found[1]) if found else None
                    digest, when = sha1_base32(payload), warc_date(r.date)
                    row = (
                        r.version, page, r.url, when, kind,
                        record_id(r.url, when, f"{'' if page is None else page} {digest}"),
                        len(payload), digest,
                    )
                    yield (*row, sha1_base32(r.block), r.block) if blocks else row

        yield from _batched(records(), schema, -1)

    ddl = _NARROW_DDL + (", block_digest string, block binary" if blocks else "")
    return _files(spark, path).mapInArrow(parsed, ddl)


def originals(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """For payloads of ``min_bytes`` or more that occur twice or more: the record kept whole.

    That is the one with the smallest page id (a null id comes last, then the record
    id decides). Only digests are shuffled, summed up before.
    """
    first = F.min(
        F.struct(
            F.col("page_id").isNull().alias("last"), "page_id", "record_id", "uri", "warc_date"
        )
    )
    return (
        records.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("payload_digest", "payload_bytes", "first")
    )


def convert(
    spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = 0, level: str = FAST
) -> None:
    """ARC files to gzipped WARC files of responses and revisits.

    A revisit holds the HTTP head only and names the response with the same payload.
    A record repeated with the same page id as the response stays a response.
    """
    firsts = originals(arc_records(spark, arc_path, blocks=False), min_bytes)
    rows = (
        arc_records(spark, arc_path)
        .join(firsts, ["payload_digest", "payload_bytes"], "left")
        .withColumn("again", ~F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("first").isNotNull())
        .select(
            "page_id", "uri", "warc_date", "warc_type", "record_id", "payload_bytes",
            "payload_digest", "block_digest", "again",
            F.col("first.page_id").alias("first_page"), F.col("first.record_id").alias("first_id"),
            F.col("first.uri").alias("first_uri"), F.col("first.warc_date").alias("first_date"),
            "block",
        )
    )

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            info = b"software: tableops\r\nformat: WARC File Format 1.1\r\n"
            for batch in slices(batches, "block"):
                for r in batch.to_pylist():
                    if info:
                        yield (warc_record(_info_headers(r), info),)
                        info = b""
                    yield (_converted(r),)

        yield from _batched(records(), _LINE, 0)

    (
        rows.mapInArrow(written, "value binary")
        .select(F.col("value").cast("string").alias("value"))
        .write.option("lineSep", "\r\n\r\n")
        .options(compression="gzip", **{"zlib.compress.level": level})
        .text(warc_path)
    )


def _info_headers(row: dict) -> list[tuple[str, str]]:
    return [
        ("WARC-Type", "warcinfo"),
        ("WARC-Record-ID", record_id("warcinfo", row["warc_date"], row["record_id"])),
        ("WARC-Date", row["warc_date"]),
        ("Content-Type", "application/warc-fields"),
    ]


def _converted(row: dict) -> bytes:
    head, payload = split_http(row["block"])
    again = bool(row["again"])
    headers = [
        ("WARC-Type", "revisit" if again else row["warc_type"]),
        ("WARC-Record-ID", row["record_id"]),
        ("WARC-Date", row["warc_date"]),
        ("WARC-Target-URI", row["uri"]),
        ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
        ("X-Payload-Length", str(row["payload_bytes"])),
    ]
    if row["page_id"] is not None:
        headers.append(("X-Page-Id", str(row["page_id"])))
    if head:
        headers.append(("Content-Type", "application/http; msgtype=response"))
    if again:
        headers += [
            ("WARC-Profile", IDENTICAL),
            ("WARC-Refers-To", row["first_id"]),
            ("WARC-Refers-To-Target-URI", row["first_uri"]),
            ("WARC-Refers-To-Date", row["first_date"]),
        ]
        if row["first_page"] is not None:
            headers.append(("X-Refers-To-Page", str(row["first_page"])))
        headers.append(("WARC-Block-Digest", f"sha1:{sha1_base32(head)}"))
        return warc_record(headers, head)
    headers.append(("WARC-Block-Digest", f"sha1:{row['block_digest']}"))
    return warc_record(headers, head + payload)


_READ = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("record_id", pa.string()),
        ("uri", pa.string()),
        ("warc_date", pa.string()),
        ("payload", pa.binary()),
    ]
)


def warc_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of all WARC files under ``path`` but warcinfo.

    Digests and lengths of what is stored are checked; a wrong one stops the job.
    ``payload`` is null for revisits, and for all without ``payloads``.
    """

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for file, stream in _blobs(batches):
                for h, block in read_warc(stream):
                    if h["warc-type"] == "warcinfo":
                        continue
                    head, payload = split_http(block)
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    length, again = int(h["x-payload-length"]), h["warc-type"] == "revisit"
                    if not again and (sha1_base32(payload), len(payload)) != (digest, length):
                        raise ValueError(f"{file}: wrong digest in {h['warc-record-id']}")
                    yield (
                        int(h["x-page-id"]) if "x-page-id" in h else None, length, digest,
                        h["warc-type"],
                        int(h["x-refers-to-page"]) if "x-refers-to-page" in h else None,
                        h["warc-record-id"], h.get("warc-target-uri"), h["warc-date"],
                        payload if payloads and not again else None,
                    )

        yield from _batched(records(), _READ, -1)

    return _files(spark, path).mapInArrow(
        parsed,
        "page_id long, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long, record_id string, uri string, warc_date string, payload binary",
    )
