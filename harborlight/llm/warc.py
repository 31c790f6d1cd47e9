"""Web archives: a converter from legacy ARC to WARC, a WARC writer and a reader.

ARC (the older format) starts a file with a ``filedesc`` record whose body names
the version and its fields; each record is one header line of space-separated
fields ending in a declared length, then so many bytes. Version 1 has five
fields (url, ip, date, type, length), version 2 has ten (result code, checksum,
location, offset and file name besides). The converter reads either by its
declared lengths and makes the WARC record that says the same: a record id
derived from the content (so running again gives the same id), the date in ISO
form, the type (response, or revisit where the payload is already held by
another record) and SHA-1 digests.

Archives are ordinary ``.warc`` text files, one per task, written by Spark's own
writer, so they go wherever Spark can write, and a lost executor's file is
written again. Files are read back whole, so they hold at most ``FILE_RECORDS``
records, and records of over ``FILE_BYTES / FILE_RECORDS`` bytes go to files of
their own, with as many as ``FILE_BYTES`` hold of the largest. (A single record
must fit into one value: 2 GB.)

Duplicates: of records with one digest and at least ``least`` bytes the one with
the largest id is the response. One row per digest comes from a hash aggregate,
so a payload shared by a third of all pages costs one row per task; that table is
stored, so the pages of one digest can be split when they meet it. A revisit
names the response's record id, address and page id.

Defined results: null payloads are empty; null urls become ``urn:unknown``; null
ids are kept (their records neither win nor lose against others by id: nulls
rank lowest); repeated rows (same id, same payload) are one response and are
both reported as such (of several addresses, revisits name the largest); ids are
integers; an empty table gives archives without records. Other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, sliced, small_batches, stored

LEAST = 1000
FILE_RECORDS, FILE_BYTES = 5000, 256 << 20
V1_FIELDS = "URL IP-address Archive-date Content-type Archive-length"
V2_FIELDS = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
DATE = "20240101000000"


def arc_url(url: str | None) -> str:
    """A url as one field of a header line: white space and controls are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "urn:unknown"


def write_arc(records: Iterator[tuple[str, str, bytes]], version: int = 1, name: str = "pages.arc") -> bytes:
    """An ARC file of (url, media type, payload) records."""
    fields = f"{version} 0 harborlight\n{V1_FIELDS if version == 1 else V2_FIELDS}\n".encode()
    extra = "" if version == 1 else f" 200 - - 0 {name}"
    out = [f"filedesc://{name} 0.0.0.0 {DATE} text/plain{extra} {len(fields)}\n".encode(), fields, b"\n"]
    for url, kind, body in records:
        extra = "" if version == 1 else f" 200 {hashlib.md5(body).hexdigest()} - {sum(map(len, out))} {name}"
        out += [f"{arc_url(url)} 0.0.0.0 {DATE} {kind}{extra} {len(body)}\n".encode(), body, b"\n"]
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of an ARC file: field name -> value, and ``body``. Raises ValueError where it isn't one."""
    at, fields = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        stop = data.find(b"\n", at)
        if stop < 0:
            raise ValueError(f"header line without an end at byte {at}")
        line = data[at:stop].decode("utf-8", "replace").rstrip("\r")
        values = line.split(" ")
        if not values[-1].isdigit():
            raise ValueError(f"no declared length at byte {at}: {line[:80]!r}")
        start, n = stop + 1, int(values[-1])
        body = data[start : start + n]
        if len(body) < n:
            raise ValueError(f"record at byte {at} declares {n} bytes, {len(body)} are left")
        at = start + n
        if fields is None:
            if not line.startswith("filedesc://"):
                raise ValueError("the first record isn't a filedesc")
            told = body.decode("utf-8", "replace").split("\n")
            if told[0].split(" ")[0] not in ("1", "2"):
                raise ValueError(f"unknown version {told[0][:20]!r}")
            fields = told[1].strip().split(" ")
            continue
        if len(values) != len(fields):
            raise ValueError(f"{len(values)} fields where the version has {len(fields)}: {line[:80]!r}")
        yield dict(zip(fields, values, strict=True)) | {"body": body}


def record_id(url: str, date: str, page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{url} {date} {page_id} {digest}')}>"


def to_warc(record: dict, page_id: object, record_type: str = "response", refers_to: object = None, refers_url: str | None = None) -> bytes:
    """The WARC record for an ARC record, without the two line ends that close it. A revisit's response has the same date."""
    body, d = record["body"], record["Archive-date"]
    digest = hashlib.sha1(body).hexdigest()
    when = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    head = [
        "WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {record_id(record['URL'], d, page_id, digest)}",
        f"WARC-Date: {when}", f"WARC-Target-URI: {record['URL']}",
        f"WARC-IP-Address: {record['IP-address']}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(body)}",
        *([] if page_id is None else [f"X-Page-ID: {page_id}"]),
    ]
    if record_type == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
        head += [f"WARC-Refers-To: {record_id(arc_url(refers_url), d, refers_to, digest)}", f"WARC-Refers-To-Target-URI: {arc_url(refers_url)}", f"WARC-Refers-To-Date: {when}"]
        body = b""
    head += [f"Content-Type: {record['Content-type']}", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, body) of each record, by declared lengths. Raises ValueError on a broken file."""
    at = 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in data[at:stop].decode().split("\r\n")[1:])
        start = stop + 4
        at = start + int(head["Content-Length"])
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"the record that ends at byte {at} isn't closed")
        yield head, data[start:at]
        at += 4


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, version: int = 1) -> str:
    """Write one WARC record per row under the shared folder; returns the folder."""
    small_batches(pages.sparkSession)
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn("sha", F.sha1("html"))
    # Only digests that occur twice come back to the pages: a small table, though a hot digest has many pages.
    sized = p.where(F.octet_length("html") >= least).groupBy("sha")
    held = stored(sized.agg(F.max(F.struct("page_id", "url")).alias("winner"), F.count("*").alias("copies")).where("copies > 1 and winner.page_id is not null").select("sha", "winner"), "warc-held")
    revisit = F.col("winner").isNotNull() & ~F.col("winner.page_id").eqNullSafe(F.col("page_id"))
    told = p.join(held, "sha", "left").select("page_id", "url", "html", *[F.when(revisit, F.col(f"winner.{c}")).alias(f"refers_{c}") for c in ("page_id", "url")])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html"):
            ids, urls, html, refers, refers_url = (batch.column(k).to_pylist() for k in range(5))
            arc = write_arc(((u, "text/html", h.encode()) for u, h in zip(urls, html, strict=True)), version)
            out = [to_warc(r, i, "response" if ref is None else "revisit", ref, at) for r, i, ref, at in zip(parse_arc(arc), ids, refers, refers_url, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in out], pa.string())], ["value"])

    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    long = F.octet_length("html") > FILE_BYTES // FILE_RECORDS
    largest = p.where(long).agg(F.max(F.octet_length("html"))).first()[0]
    parts = [(told, FILE_RECORDS)] if largest is None else [(told.where(~long), FILE_RECORDS), (told.where(long), max(1, FILE_BYTES // largest))]
    for part, records in parts:
        # Every record closes with two line ends: the writer's line separator.
        part.mapInArrow(convert, "value string").write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records).text(folder)
    return folder


def read_archives(spark, folder: str) -> DataFrame:
    """Per record: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for head, body in parse_warc(gzip.decompress(content.as_py())):
                    page, ref = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")
                    rows.append((page and int(page), head["WARC-Target-URI"], head["WARC-Type"], ref and int(ref), head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"]), body))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(7)], names)
                        rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(7)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInArrow(parse, "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary")
