"""Legacy archives to WARC.

``parse_arc`` reads ARC files of versions 1 and 2: the version block names the
fields of every later header line, and each line declares its record's length.
``convert`` gives each record the identifiers, timestamp, type and digests that
a WARC record has; ``read_arc`` does so for stored files.  ``write`` and
``read_back`` put WARC archives into any store that Spark reaches: a gzip member
for each record, files bounded in bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, small_batches

# Fixed values of the formats: field names of the ARC URL record by version.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122, for URLs
#: Compressed bytes after which an archive file ends; a task holds one file.
FILE_BYTES = 32 << 20

CONVERTED = "record_id string, url string, warc_date string, content_type string, http string, payload binary, payload_bytes long, payload_digest string, block_digest string, page_id long"


class ArchiveError(ValueError):
    """A malformed archive: which record and why."""


@dataclass(frozen=True)
class ArcRecord:
    fields: dict[str, str]
    content: bytes


def base32_sha1(data: bytes) -> str:
    """Bare upper-case base32 of the SHA-1; 20 bytes need no padding."""
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def _token(value: str) -> str:
    """A header field: white space and controls percent-encoded, ``-`` if empty."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value) or "-"


def arc_header(version: int, name: str, date: str) -> bytes:
    """The version block that opens an archive."""
    names = " ".join(FIELDS[version]) + "\n"
    body = f"{version} 0 lamella\n{names}".encode()
    fields = [f"filedesc://{_token(name)}", "0.0.0.0", date, "text/plain"]
    fields += ["200", "-", "-", "0", _token(name)] if version == 2 else []
    return " ".join([*fields, str(len(body))]).encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str, date: str, mime: str, content: bytes, *, ip: str = "0.0.0.0", status: str = "200", offset: int = 0, name: str = "-") -> bytes:
    fields = [_token(url), ip, date, _token(mime)]
    fields += [status, "-", "-", str(offset), _token(name)] if version == 2 else []
    return " ".join([*fields, str(len(content))]).encode() + b"\n" + content + b"\n"


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of one archive in order, without the version block.

    Empty input has none.  A missing version block, a field count that differs
    from the version's or a length beyond the end raise ArchiveError.
    """
    at, names = 0, None
    while at < len(data):
        if data[at : at + 1] == b"\n":  # the line end after a record
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ArchiveError(f"header line at {at} has no end")
        parts = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if names is None and not parts[0].startswith("filedesc://"):
            raise ArchiveError("no version block")
        if not parts[-1].isdigit():
            raise ArchiveError(f"header line at {at} declares no length")
        start, stop = end + 1, end + 1 + int(parts[-1])
        if stop > len(data):
            raise ArchiveError(f"record at {at} is cut off")
        content = data[start:stop]
        if names is None:
            lines = content.decode("utf-8", "replace").split("\n")
            version = lines[0].split(" ")[0]
            if not version.isdigit() or int(version) not in FIELDS:
                raise ArchiveError(f"unknown version {version!r}")
            names = tuple(lines[1].split(" ")) if len(lines) > 1 and lines[1] else FIELDS[int(version)]
            if len(parts) != len(names):
                raise ArchiveError("the version block's line doesn't match its fields")
        elif len(parts) != len(names):
            raise ArchiveError(f"header line at {at} has {len(parts)} fields, not {len(names)}")
        else:
            yield ArcRecord(dict(zip(names, parts, strict=True)), content)
        at = stop


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP header block (with its blank line) and payload; no header: all payload."""
    if content[:5] != b"HTTP/":
        return b"", content
    end = content.find(b"\r\n\r\n")
    return (content, b"") if end < 0 else (content[: end + 4], content[end + 4 :])


def http_field(http: bytes, name: str) -> str | None:
    m = re.search(rb"^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", http, re.I | re.M)
    return m[1].decode("utf-8", "replace").strip() if m else None


def iso_date(arc_date: str) -> str:
    """14 digits as an ISO timestamp in UTC; shorter ones are filled with the first instant."""
    d = re.sub(r"\D", "", arc_date)[:14]
    d += "00000101000000"[len(d) :] if len(d) >= 4 else ""
    if len(d) != 14:
        return "1970-01-01T00:00:00Z"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def convert(record: ArcRecord) -> tuple:
    """The values of CONVERTED for one ARC record.

    The identifier is a name-based UUID of URL, date and block digest: the same
    record always gets the same one.
    """
    http, payload = split_http(record.content)
    url, date = record.fields["URL"], iso_date(record.fields["Archive-date"])
    block = "sha1:" + base32_sha1(record.content)
    page = http_field(http, "X-Page-Id")
    ident = uuid.uuid5(NAMESPACE, f"{url} {date} {block}")
    mime = "application/http; msgtype=response" if http else record.fields["Content-type"]
    return (f"<urn:uuid:{ident}>", url, date, mime, http.decode("latin-1"), payload, len(payload), base32_sha1(payload), block, int(page) if page and re.fullmatch(r"-?\d+", page) else None)


def members(data: bytes) -> Iterator[bytes]:
    """Contents of the gzip members of ``data``, one at a time; data that isn't gzip as it is."""
    if data[:2] != b"\x1f\x8b":
        if data:
            yield data
        return
    while data:
        d = zlib.decompressobj(31)
        out = d.decompress(data)
        if not d.eof:
            raise ArchiveError("a gzip member is cut off")
        yield out
        data = d.unused_data.lstrip(b"\0")


CONVERTED_TYPES = [pa.string()] * 5 + [pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """(path, CONVERTED..., error) of the ARC files that ``path`` names, plain or gzip.

    Whatever breaks a file gives a row with ``error`` and nothing else, after
    the records before it; other files go on.  A file is read as a whole (2 GB
    at most).
    """
    names = ["path", *(c.split()[0] for c in CONVERTED.split(", ")), "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.string(), *CONVERTED_TYPES, pa.string()], strict=True)], names=names)

        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows, size = [], 0
                try:
                    for record in parse_arc(b"".join(members(content))):
                        rows.append((name, *convert(record), None))
                        size += len(record.content)
                        if size > FILE_BYTES:
                            yield batch(rows)
                            rows, size = [], 0
                except (ArchiveError, zlib.error, KeyError) as e:
                    rows.append((name, *[None] * len(CONVERTED_TYPES), f"{type(e).__name__}: {e}"))
                yield batch(rows)

    small_batches(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"path string, {CONVERTED}, error string")


def pages_to_arc(ids: list, urls: list, htmls: list[bytes], version: int) -> bytes:
    """One archive of HTTP responses, a record for each page."""
    name, date = f"pages-v{version}.arc", "20000101000000"
    out = [arc_header(version, name, date)]
    offset = len(out[0])
    for i, url, html in zip(ids, urls, htmls, strict=True):
        page = "" if i is None else f"X-Page-Id: {i}\r\n"
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n{page}\r\n"
        out.append(arc_record(version, url or "-", date, "text/html", http.encode() + html, offset=offset, name=name))
        offset += len(out[-1])
    return b"".join(out)


def convert_pages(pages: DataFrame) -> DataFrame:
    """Pages through legacy archives: each Arrow batch becomes an ARC file, in
    turn of version 1 and 2, and is parsed and converted again (CONVERTED)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, urls = batch.column("page_id").to_pylist(), batch.column("url").to_pylist()
        htmls = [x or b"" for x in batch.column("html").cast(pa.binary()).to_pylist()]
        half = len(ids) // 2
        rows = []
        for version, part in ((1, slice(0, half)), (2, slice(half, None))):
            rows += map(convert, parse_arc(pages_to_arc(ids[part], urls[part], htmls[part], version)))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 10
        names = [c.split()[0] for c in CONVERTED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, CONVERTED_TYPES, strict=True)], names=names)

    return map_arrow(pages.select("page_id", "url", "html"), run, CONVERTED)


def warc_record(kind: str, row: dict, refers_to: dict | None) -> bytes:
    """One WARC 1.1 record; a revisit keeps the HTTP header and drops the payload."""
    http = row["http"].encode("latin-1")
    block = http if kind == "revisit" else http + row["payload"]
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {row['record_id']}", f"WARC-Date: {row['warc_date']}", f"WARC-Target-URI: {row['url']}", f"WARC-Payload-Digest: sha1:{row['payload_digest']}"]
    head.append(f"WARC-Block-Digest: {row['block_digest'] if kind == 'response' else 'sha1:' + base32_sha1(block)}")
    if refers_to:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {refers_to['record_id']}", f"WARC-Refers-To-Target-URI: {refers_to['url']}", f"WARC-Refers-To-Date: {refers_to['warc_date']}", f"WARC-Refers-To-Page: {refers_to['page_id']}"]
    head += [f"Content-Type: {row['content_type']}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info_record(name: str) -> bytes:
    """The ``warcinfo`` record that opens a file; its identifier follows from ``name``."""
    block = b"software: lamella\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMESPACE, name)}>", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """``data`` as a gzip member whose last byte is 0: beyond 16 MB an empty member follows."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = c.compress(data) + c.flush()
    return out if out[-1] == 0 else out + gzip_member(b"")


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record, cut by declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or data[at : at + 5] != b"WARC/":
            raise ArchiveError(f"no record at {at}")
        lines = data[at:end].decode().split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:])
        start = end + 4
        stop = start + int(head["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ArchiveError(f"record at {at} is cut off")
        yield head, data[start:stop]
        at = stop + 4


def write(converted: DataFrame, path: str, *, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """WARC archives below ``path``.

    Among records of equal payload (by digest and length) of ``least_bytes``
    bytes at least, the smallest page_id is the response and the others revisit
    it.  Shorter payloads and records without a page_id are responses.
    The first of each payload is a partial-then-final minimum, and the join to
    it is an equi-join that adaptive execution splits where a payload is hot.
    Spark's writer commits the files, so a lost executor leaves none half
    written: a row is a file, a string cast from bytes keeps them as they are,
    and the line end is the 0 byte that ends its last gzip member.
    """
    key = ["payload_digest", "payload_bytes"]
    firsts = (
        converted.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull())
        .groupBy(*key)
        .agg(F.min(F.struct("page_id", "record_id", "url", "warc_date")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select(*key, "first")
    )
    rows = converted.join(firsts, key, "left")
    wanted = converted.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        size = 0

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-1]], pa.binary())], names=["value"])

        for batch in batches:
            first = batch.column("first").to_pylist()
            for row, ref in zip(batch.select(wanted).to_pylist(), first, strict=True):
                again = ref is not None and row["page_id"] is not None and ref["page_id"] != row["page_id"]
                if not parts:
                    parts.append(gzip_member(info_record(row["record_id"])))
                parts.append(gzip_member(warc_record("revisit" if again else "response", row, ref if again else None)))
                size += len(parts[-1])
                if size >= file_bytes:
                    yield file()
                    parts, size = [], 0
        if parts:
            yield file()

    small_batches(converted.sparkSession)
    files = rows.select(*wanted, "first").mapInArrow(run, "value binary")
    files.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).option("compression", "none").text(path)
    _rename(converted.sparkSession, path, ".txt", ".warc.gz")


def _rename(spark: SparkSession, path: str, old: str, new: str) -> None:
    """Give the files below ``path`` another ending: one step in the store's directory each."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = hadoop(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.endswith(old):
            fs.rename(status.getPath(), hadoop(folder, name.removesuffix(old) + new))


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, error string"
RECORD_ROWS = 1000


def read_record(head: dict[str, str], block: bytes) -> tuple:
    """The values of RECORDS: of a response, length and digest are computed anew from the payload."""
    http, payload = split_http(block)
    kind, digest, error = head["WARC-Type"], head.get("WARC-Payload-Digest", "").removeprefix("sha1:"), None
    size = int(http_field(http, "Content-Length") or len(payload))
    if kind == "response":
        size, own = len(payload), base32_sha1(payload)
        if digest and own != digest:
            error = f"the payload's digest is {own}, not {digest}"
        digest = own
    page, ref = http_field(http, "X-Page-Id"), head.get("WARC-Refers-To-Page")
    return (int(page) if page else None, size, digest, kind, int(ref) if ref else None, head["WARC-Record-ID"], head.get("WARC-Target-URI"), error)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below ``path`` (RECORDS), ``warcinfo`` left out.

    A record that can't be read gives a row with ``error``, and so does a
    response whose payload differs from its digest; what follows in the file
    goes on with its next gzip member.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in RECORDS.split(", ")])
            rows.clear()
            return out

        def failed(e: Exception) -> tuple:
            return (*[None] * 7, f"{type(e).__name__}: {e}")

        for batch in batches:
            for content in batch.column("content").to_pylist():
                try:
                    for member in members(content):
                        try:
                            rows.extend(read_record(h, b) for h, b in parse_warc(member) if h.get("WARC-Type") != "warcinfo")
                        except (ArchiveError, KeyError, ValueError) as e:
                            rows.append(failed(e))
                        if len(rows) >= RECORD_ROWS:
                            yield flush()
                except (ArchiveError, zlib.error) as e:
                    rows.append(failed(e))
        yield flush()

    files = spark.read.format("binaryFile").load(path).select("content")
    small_batches(spark)  # the byte limit ends a batch after a file
    return files.mapInArrow(run, RECORDS)


def archive(pages: DataFrame, path: str, *, least_bytes: int = 0) -> DataFrame:
    """Convert, write and read back; one row for each row of ``pages``.

    A null html is an empty payload, a null page_id stays null and is never
    referred to; repeated page_ids give repeated records.
    """
    write(convert_pages(pages), path, least_bytes=least_bytes)
    return read_back(pages.sparkSession, path)


#: Four letters from each five hexadecimal digits of the SHA-1.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS s FROM p),
b AS (SELECT page_id, n, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(s, 5 * (i // 4)::INT + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS g FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY g, n) AS first FROM b)
SELECT page_id, n::BIGINT AS payload_bytes, g AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
