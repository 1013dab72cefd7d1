"""Deflate, zlib and gzip buffers and files, their recognition, header fields and checksums."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

_WBITS = {"deflate": -15, "zlib": 15, "gzip": 31}


def kind_of(data: bytes) -> str:
    """gzip by its magic number, zlib by its check bits, else deflate."""
    if data[:2] == b"\x1f\x8b":
        return "gzip"
    if len(data) >= 2 and data[0] & 15 == 8 and int.from_bytes(data[:2], "big") % 31 == 0:
        return "zlib"
    return "deflate"


def compress(data: bytes, kind: str = "gzip", level: int = 6) -> bytes:
    if kind not in _WBITS:
        raise ValueError(f"unknown codec {kind!r}")
    c = zlib.compressobj(level, zlib.DEFLATED, _WBITS[kind])
    return c.compress(data) + c.flush()


def decompress(data: bytes, kind: str | None = None) -> bytes:
    """All members of ``data``; checksums and lengths are verified, zero padding after gzip is skipped."""
    kind = kind or kind_of(data)
    out = []
    while data:
        d = zlib.decompressobj(_WBITS[kind])
        out.append(d.decompress(data) + d.flush())
        if not d.eof:
            raise ValueError("compressed data is cut off")
        data = d.unused_data.lstrip(b"\0") if kind == "gzip" else d.unused_data
        if kind != "gzip":
            break
    return b"".join(out)


#: Flags of a gzip header.
HEADER_CRC, EXTRA, NAME, COMMENT = 2, 4, 8, 16


def gzip_member(data: bytes, *, name: str | None = None, comment: str | None = None, extra: bytes | None = None, mtime: int = 0, header_crc: bool = False, level: int = 6) -> bytes:
    """A gzip member with the header fields given (RFC 1952); texts are Latin-1."""
    flags = (HEADER_CRC if header_crc else 0) | (EXTRA if extra is not None else 0) | (NAME if name is not None else 0) | (COMMENT if comment is not None else 0)
    head = struct.pack("<2sBBIBB", b"\x1f\x8b", 8, flags, mtime, 2 if level == 9 else 4 if level == 1 else 0, 255)
    if extra is not None:
        head += struct.pack("<H", len(extra)) + extra
    for text in (name, comment):
        if text is not None:
            if "\0" in text:
                raise ValueError("a gzip header text can't hold a zero")
            head += text.encode("latin-1") + b"\0"
    if header_crc:
        head += struct.pack("<H", zlib.crc32(head) & 0xFFFF)
    return head + compress(data, "deflate", level) + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def gzip_header(data: bytes) -> dict[str, object]:
    """name, comment, extra and mtime of a gzip member, None where it has none, and ``size`` of its header."""
    if len(data) < 10 or data[:3] != b"\x1f\x8b\x08":
        raise ValueError("not a gzip header")
    flags, at = data[3], 10
    out: dict[str, object] = {"mtime": struct.unpack_from("<I", data, 4)[0], "extra": None, "name": None, "comment": None}
    if flags & EXTRA:
        n = struct.unpack_from("<H", data, at)[0]
        out["extra"], at = data[at + 2 : at + 2 + n], at + 2 + n
    for flag, key in ((NAME, "name"), (COMMENT, "comment")):
        if flags & flag:
            end = data.find(b"\0", at)
            if end < 0:
                raise ValueError("a gzip header is cut off")
            out[key], at = data[at:end].decode("latin-1"), end + 1
    if flags & HEADER_CRC:
        if struct.unpack_from("<H", data, at)[0] != zlib.crc32(data[:at]) & 0xFFFF:
            raise ValueError("a gzip header's checksum is wrong")
        at += 2
    return out | {"size": at}


ENDINGS = {"gzip": ".gz", "zlib": ".zlib", "deflate": ".deflate"}


def compress_files(spark: SparkSession, path: str, folder: str, kind: str = "gzip", level: int = 6) -> DataFrame:
    """(path, target, bytes): each file that ``path`` names, compressed into ``folder``; gzip keeps its name in the header."""

    def pack(name: str, data: bytes) -> tuple[str, bytes]:
        return name + ENDINGS[kind], gzip_member(data, name=name, level=level) if kind == "gzip" else compress(data, kind, level)

    return _files(spark, path, folder, pack)


def decompress_files(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """(path, target, bytes): each file unpacked; its name is that in the header, else its own without the ending."""

    def unpack(name: str, data: bytes) -> tuple[str, bytes]:
        kind = next((k for k, e in ENDINGS.items() if name.endswith(e)), None) or kind_of(data)
        kept = gzip_header(data)["name"] if kind == "gzip" else None
        # a name in a header never leads out of the folder
        kept = str(kept).replace("\\", "/").rpartition("/")[2] if kept else ""
        return kept or name.removesuffix(ENDINGS[kind]) or "unpacked", decompress(data, kind)

    return _files(spark, path, folder, unpack)


def _files(spark: SparkSession, path: str, folder: str, change) -> DataFrame:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                target, out = change(name.rpartition("/")[2], data)
                store.write(store.join(folder, target), out)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([target]), pa.array([len(out)], pa.int64())], names=["path", "target", "bytes"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, target string, bytes long")


def crc32(data: Column) -> Column:
    return F.crc32(data.cast("binary"))


def adler32(data: Column) -> Column:
    """No built-in function has it: Arrow batches through zlib."""

    @F.pandas_udf("long")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else zlib.adler32(x))

    return fold(data.cast("binary"))
