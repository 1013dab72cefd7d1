"""MRC stacks as a Spark data source (``format("mrc")``), read and write.

A reader partition is a range of sections and opens the file at its own
offset.  Filters on ``z`` reach the reader, which then skips sections.  In a
local or mounted folder tasks write their sections to their final places and the
commit adds the header; in other stores, which can't write into the middle of a
file, tasks write parts and the commit streams them into one.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..functions.dtypes import TYPES, itemsize
from . import store

# Fixed values of the MRC header: struct formats, field names and marks.
NEW_FORMAT = "10i6f3i3fiih30xhh20xii6h6f3f2ifi"
OLD_FORMAT = "10i6f3i3fiih30xhh20xii6h6f6h3fi"
COMMON = "nx ny nz mode nxstart nystart nzstart mx my mz xlen ylen zlen alpha beta gamma mapc mapr maps amin amax amean ispg next creatid nint nreal imod_stamp imod_flags idtype lens nd1 nd2 vd1 vd2 tilt0 tilt1 tilt2 tilt3 tilt4 tilt5".split()
NEW_TAIL = "xorg yorg zorg cmap stamp rms nlabl".split()
OLD_TAIL = "nwave wave1 wave2 wave3 wave4 wave5 xorg yorg zorg nlabl".split()
MAP_MARK = 0x2050414D
LITTLE_STAMP, BIG_STAMP = 0x00004144, 0x00001717
IMOD_STAMP, SIGNED_FLAG = 1146047817, 1
HEADER_BYTES, LABELS, LABEL_BYTES = 1024, 10, 80
FIXED = 224
SECTIONS_PER_PARTITION = 16

HEADER_SCHEMA = (
    ", ".join(f"{n} {'float' if n[:4] in ('xlen', 'ylen', 'zlen', 'alph', 'beta', 'gamm', 'amin', 'amax', 'amea', 'tilt') else 'smallint' if n in ('creatid', 'nint', 'nreal', 'idtype', 'lens', 'nd1', 'nd2', 'vd1', 'vd2') else 'int'}" for n in COMMON)
    + ", xorg float, yorg float, zorg float, version string, endian string, dtype string, labels array<string>, data_offset long"
)


class MrcError(ValueError):
    """Not an MRC file, or one of a kind that isn't supported."""


@dataclass
class Header:
    fields: dict
    labels: list[str]
    extra: bytes
    endian: str
    new: bool

    @property
    def data_offset(self) -> int:
        return HEADER_BYTES + self.fields["next"]

    @property
    def dtype(self) -> str:
        mode = self.fields["mode"]
        if mode == 0:
            signed = self.fields["imod_stamp"] == IMOD_STAMP and self.fields["imod_flags"] & SIGNED_FLAG
            return "sbyte" if signed else "byte"
        names = {1: "short", 2: "float", 6: "ushort", 16: "rgb24"}
        if mode not in names:
            raise MrcError(f"mode {mode} is complex or unknown")
        return names[mode]

    @property
    def section_bytes(self) -> int:
        return self.fields["nx"] * self.fields["ny"] * itemsize(TYPES[self.dtype])


#: Largest plausible dimension and mode: their bytes in the wrong order make far larger numbers.
MOST_SIDE, MOST_MODE = 1 << 24, 127
LITTLE_MARKS, BIG_MARKS = frozenset(b"\x44\x41"), frozenset(b"\x11\x17")


def byte_order(data: bytes, new: bool) -> str:
    """``<`` or ``>``: the one that makes dimensions and mode plausible, else what the stamp says.

    The stamp's marks may stand at either end of its four bytes.
    """
    marks = {*data[212:216]} - {0}
    if new and not (marks and (marks <= LITTLE_MARKS or marks <= BIG_MARKS)):
        raise MrcError(f"unknown byte-order stamp {data[212:216].hex()}")
    likely = []
    for e in "<>":
        *sides, mode = struct.unpack_from(e + "4i", data)
        if all(0 < x <= MOST_SIDE for x in sides) and 0 <= mode <= MOST_MODE:
            likely.append(e)
    if len(likely) == 1:
        return likely[0]
    return ">" if new and marks <= BIG_MARKS else "<"


def parse_header(data: bytes) -> Header:
    """The header in the first 1024 bytes (and the extra part after them, if given)."""
    if len(data) < HEADER_BYTES:
        raise MrcError("shorter than a header")
    new = any(struct.unpack_from(e + "i", data, 208)[0] == MAP_MARK for e in "<>")
    endian = byte_order(data, new)
    values = struct.unpack_from(endian + (NEW_FORMAT if new else OLD_FORMAT), data)
    f = dict(zip(COMMON + (NEW_TAIL if new else OLD_TAIL), values, strict=True))
    if min(f["nx"], f["ny"], f["nz"]) <= 0:
        raise MrcError("a dimension isn't positive")
    if f["next"] < 0 or not 0 <= f["nlabl"] <= LABELS:
        raise MrcError("bad size of the extra header or number of labels")
    if any(f[k] for k in ("nxstart", "nystart", "nzstart")):
        raise MrcError("sub-images aren't supported")
    if any(f[k] != 90 for k in ("alpha", "beta", "gamma")):
        raise MrcError("cell angles other than 90 aren't supported")
    if (f["mapc"], f["mapr"], f["maps"]) != (1, 2, 3):
        raise MrcError("axes in another order than x, y, z aren't supported")
    labels = [data[FIXED + LABEL_BYTES * k : FIXED + LABEL_BYTES * (k + 1)].decode("latin-1") for k in range(f["nlabl"])]
    head = Header(f, labels, data[HEADER_BYTES : HEADER_BYTES + f["next"]], endian, new)
    _ = head.dtype
    return head


def new_header(nx: int, ny: int, nz: int, dtype: str, stats: tuple[float, float, float] = (0.0, 0.0, 0.0), label: str = "Made by lamella", endian: str = "<") -> Header:
    t = TYPES[dtype]
    if t.mrc is None:
        raise MrcError(f"MRC can't hold {dtype}")
    f = dict.fromkeys(COMMON + NEW_TAIL, 0)
    f |= {"nx": nx, "ny": ny, "nz": nz, "mode": t.mrc, "mx": nx, "my": ny, "mz": nz, "xlen": float(nx), "ylen": float(ny), "zlen": float(nz), "alpha": 90.0, "beta": 90.0, "gamma": 90.0, "mapc": 1, "mapr": 2, "maps": 3, "cmap": MAP_MARK, "stamp": LITTLE_STAMP if endian == "<" else BIG_STAMP, "nlabl": 1}
    f |= dict(zip(("amin", "amax", "amean"), map(float, stats), strict=True))
    if dtype == "sbyte":
        f |= {"imod_stamp": IMOD_STAMP, "imod_flags": SIGNED_FLAG}
    return Header(f, [label.ljust(LABEL_BYTES)], b"", endian, True)


def pack_header(h: Header) -> bytes:
    names = COMMON + (NEW_TAIL if h.new else OLD_TAIL)
    data = struct.pack(h.endian + (NEW_FORMAT if h.new else OLD_FORMAT), *(h.fields[n] for n in names))
    labels = b"".join(x.encode("latin-1")[:LABEL_BYTES].ljust(LABEL_BYTES) for x in h.labels[-LABELS:])
    return data + labels.ljust(LABELS * LABEL_BYTES) + h.extra


def read_header(path: str) -> Header:
    data = store.read(path, 0, HEADER_BYTES)
    head = parse_header(data)
    head.extra = store.read(path, HEADER_BYTES, head.fields["next"]) if head.fields["next"] else b""
    return head


def header_row(h: Header) -> tuple:
    return (*(h.fields[n] for n in COMMON), h.fields["xorg"], h.fields["yorg"], h.fields["zorg"], "new" if h.new else "old", h.endian, h.dtype, h.labels, h.data_offset)


@dataclass
class Sections(InputPartition):
    first: int
    last: int


class MrcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.low, self.high, self.only = 0, None, None
        self.per = int(options.get("sectionsperpartition", SECTIONS_PER_PARTITION))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Ranges of z cut the partitions; all filters also run in Spark."""
        for f in filters:
            if getattr(f, "attribute", None) == ("z",):
                match f:
                    case EqualTo():
                        self.low, self.high = max(self.low, f.value), min(f.value, f.value if self.high is None else self.high)
                    case GreaterThan() | GreaterThanOrEqual():
                        self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                    case LessThan() | LessThanOrEqual():
                        top = f.value - isinstance(f, LessThan)
                        self.high = top if self.high is None else min(self.high, top)
                    case In():
                        self.only = set(f.value) if self.only is None else self.only & set(f.value)
            yield f

    def partitions(self) -> list[Sections]:
        nz = read_header(self.path).fields["nz"]
        high = nz - 1 if self.high is None else min(self.high, nz - 1)
        out = []
        for a in range(self.low, high + 1, self.per):
            b = min(a + self.per - 1, high)
            if self.only is None or any(a <= z <= b for z in self.only):
                out.append(Sections(a, b))
        return out or [Sections(0, -1)]

    def read(self, partition: Sections) -> Iterator[tuple]:
        h = read_header(self.path)
        size, kind = h.section_bytes, np.dtype(h.endian + TYPES[h.dtype].numpy)
        files, at = store.locate(self.path)
        with files.open_input_file(at) as f:
            for z in range(partition.first, partition.last + 1):
                if self.only is not None and z not in self.only:
                    continue
                f.seek(h.data_offset + z * size)
                data = f.read(size)
                if len(data) != size:
                    raise MrcError(f"section {z} is cut off")
                data = np.frombuffer(data, kind).astype(kind.newbyteorder("<")).tobytes()
                yield z, h.fields["ny"], h.fields["nx"], h.dtype, data


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: list[tuple]


ORDERS = {"little": "<", "big": ">"}


class MrcWriter(DataSourceWriter):
    """Sections must have one shape and type and z from 0 without gaps; option ``endian``: little or big.

    Columns vmin, vmax and vmean, if there, are the sections' statistics for the header; else those of all pixels are taken.
    """

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path = options["path"]
        self.endian = ORDERS[options.get("endian", "little")]
        files, self.at = store.locate(self.path)
        self.in_place = isinstance(files, fs.LocalFileSystem)
        if store.exists(self.path) and not overwrite:
            raise FileExistsError(self.path)
        self.draft = self.at + ".draft" if self.in_place else self.path + ".parts"
        if self.in_place:
            os.makedirs(os.path.dirname(os.path.abspath(self.at)), exist_ok=True)

    def write(self, rows: Iterator) -> Part:
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().taskAttemptId()}"
        found, at = [], 0
        if self.in_place:
            out = os.open(self.draft, os.O_WRONLY | os.O_CREAT, 0o644)
        else:
            files, folder = store.locate(self.draft)
            files.create_dir(folder)
            out = files.open_output_stream(f"{folder}/{name}", compression=None)
        try:
            for r in rows:
                kind = TYPES[r["dtype"]].numpy
                v = np.frombuffer(r["pixels"], "<" + kind)
                data = v.astype(self.endian + kind).tobytes()
                if r["z"] < 0:
                    raise MrcError("sections must be numbered from 0 without gaps")
                if self.in_place:  # the same bytes at the same place, however often a task runs
                    left, to = memoryview(data), HEADER_BYTES + r["z"] * len(data)
                    while left:
                        n = os.pwrite(out, left, to)
                        left, to = left[n:], to + n
                else:
                    out.write(data)
                if "vmean" in r:
                    ends = r["vmin"], r["vmax"], r["vmean"]
                else:
                    v = v.astype(np.float64)
                    ends = float(v.min()), float(v.max()), float(v.mean())
                found.append((r["z"], r["ny"], r["nx"], r["dtype"], at, len(data), *ends))
                at += len(data)
        finally:
            os.close(out) if self.in_place else out.close()
        return Part(name, found)

    def commit(self, messages: list[Part | None]) -> None:
        rows = sorted((r, m.name) for m in messages if m for r in m.rows)
        if [r[0] for r, _ in rows] != list(range(len(rows))) or not rows:
            raise MrcError("sections must be numbered from 0 without gaps")
        if len({r[1:4] for r, _ in rows}) != 1:
            raise MrcError("sections differ in shape or type")
        _, ny, nx, dtype, _, size = rows[0][0][:6]
        stats = (min(r[6] for r, _ in rows), max(r[7] for r, _ in rows), sum(r[8] for r, _ in rows) / len(rows))
        head = pack_header(new_header(nx, ny, len(rows), dtype, stats, endian=self.endian))
        if self.in_place:
            with open(self.draft, "r+b") as f:
                f.write(head)
                f.truncate(HEADER_BYTES + len(rows) * size)
            os.replace(self.draft, self.at)
            return
        files, folder = store.locate(self.draft)
        with files.open_output_stream(self.at, compression=None) as out:
            out.write(head)
            for r, name in rows:
                with files.open_input_file(f"{folder}/{name}") as f:
                    f.seek(r[4])
                    left = r[5]
                    while left:
                        block = f.read(min(left, 10 << 20))
                        out.write(block)
                        left -= len(block)
        store.remove(self.draft)

    def abort(self, messages: list[Part | None]) -> None:
        store.remove(self.draft)


class MrcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mrc"

    def schema(self) -> str:
        from .sections import SECTION

        return SECTION

    def reader(self, schema) -> MrcReader:  # noqa: ANN001
        return MrcReader(self.options)

    def writer(self, schema, overwrite: bool) -> MrcWriter:  # noqa: ANN001
        return MrcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MrcSource)


def headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row of header fields for each file, read by the executors; pixels stay unread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                h = read_header(path)
                yield pa.RecordBatch.from_pylist([dict(zip(names, header_row(h), strict=True))], schema=kinds)

    fields = [f.split() for f in HEADER_SCHEMA.split(", ")]
    names = [n for n, _ in fields]
    arrow = {"int": pa.int32(), "smallint": pa.int16(), "float": pa.float32(), "long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    kinds = pa.schema([(n, arrow[k]) for n, k in fields])
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 1000)))
    return files.mapInArrow(run, HEADER_SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Sections of one stack.

    A store that only Spark reaches has no ranges: the file, 2 GB at most, then
    comes as a whole and one task cuts it into sections.
    """
    register(spark)
    try:
        store.locate(path)
    except (OSError, ValueError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
        pass
    else:
        return spark.read.format("mrc").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content").to_pylist():
                yield from decode(data)

    from .sections import SECTION

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SECTION)


def decode(data: bytes) -> Iterator[pa.RecordBatch]:
    """Sections of a whole file, a batch each."""
    h = parse_header(data)
    size, kind = h.section_bytes, np.dtype(h.endian + TYPES[h.dtype].numpy)
    for z in range(h.fields["nz"]):
        part = data[h.data_offset + z * size : h.data_offset + (z + 1) * size]
        if len(part) != size:
            raise MrcError(f"section {z} is cut off")
        pixels = np.frombuffer(part, kind).astype(kind.newbyteorder("<")).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([z], pa.int32()), pa.array([h.fields["ny"]], pa.int32()), pa.array([h.fields["nx"]], pa.int32()), pa.array([h.dtype]), pa.array([pixels], pa.binary())], names=["z", "ny", "nx", "dtype", "pixels"])


def shape(h: Header) -> tuple[int, ...]:
    """(sections, rows, columns), and 3 for colours."""
    return (h.fields["nz"], h.fields["ny"], h.fields["nx"], *([3] if h.dtype == "rgb24" else []))
