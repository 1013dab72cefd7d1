"""MetaImage files (.mha, .mhd): header text, pixels inside or in files beside it."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.dtypes import TYPES, itemsize
from . import store
from .sections import SECTION

# Tags that have a meaning of their own, tags that only describe, and spellings that exclude each other.
RESERVED = ("ObjectType", "NDims", "DimSize", "ElementType", "ElementDataFile", "ElementNumberOfChannels", "BinaryData", "BinaryDataByteOrderMSB", "ElementByteOrderMSB", "HeaderSize", "CompressedData", "CompressedDataSize")
SYNONYMS = (("Position", "Offset", "Origin"), ("Rotation", "Orientation", "TransformMatrix"))
LISTS = {"ElementSpacing": 1, "ElementSize": 1, "Position": 1, "Offset": 1, "Origin": 1, "CenterOfRotation": 1, "Rotation": 2, "Orientation": 2, "TransformMatrix": 2}
BY_META = {t.meta: t for t in TYPES.values() if t.meta}
CHUNK = 10 << 20


class MetaError(ValueError):
    """A header that breaks a rule."""


def split_list(text: str) -> list[str]:
    """Cut at the first of , ; : that occurs, else at white space."""
    for mark in ",;:":
        if mark in text:
            return [p.strip() for p in text.split(mark)]
    return text.split()


def flag(text: str) -> bool:
    value = text.strip().lower()
    if value not in ("t", "true", "f", "false"):
        raise MetaError(f"not a boolean: {text!r}")
    return value in ("t", "true")


def parse_header(data: bytes) -> tuple[dict[str, str], int]:
    """(tags as written, offset of what follows the header)."""
    tags: dict[str, str] = {}
    at = 0
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end].decode("latin-1").strip()
        at = end + 1
        if not line:
            continue
        key, eq, value = line.partition("=")
        if not eq:
            raise MetaError(f"not a tag: {line[:80]!r}")
        tags[key.strip()] = value.strip()
        if key.strip().lower() == "elementdatafile":
            return tags, at
    raise MetaError("ElementDataFile is missing")


class Layout:
    """What the tags say about the pixels."""

    def __init__(self, tags: dict[str, str]) -> None:
        low = {k.lower(): v for k, v in tags.items()}
        for k in ("objecttype", "ndims", "dimsize", "elementtype", "elementdatafile"):
            if k not in low:
                raise MetaError(f"{k} is missing")
        if low["objecttype"].lower() != "image":
            raise MetaError("only ObjectType Image is supported")
        self.ndims = int(low["ndims"])
        self.dims = [int(x) for x in split_list(low["dimsize"])]
        if self.ndims < 1 or len(self.dims) != self.ndims or min(self.dims) <= 0:
            raise MetaError("NDims and DimSize don't agree")
        self.channels = int(low.get("elementnumberofchannels", "1"))
        kind = low["elementtype"].upper()
        if kind not in BY_META and kind + "_ARRAY" not in BY_META:
            raise MetaError(f"unknown ElementType {kind}")
        rgb = self.channels == 3 and kind in ("MET_UCHAR", "MET_UCHAR_ARRAY")
        if self.channels != 1 and not rgb:
            raise MetaError("only 1 channel, or 3 of bytes, are supported")
        self.type = TYPES["rgb24"] if rgb else BY_META[kind.removesuffix("_ARRAY") if self.channels == 1 else kind]
        if not flag(low.get("binarydata", "True")):
            raise MetaError("text pixels aren't supported")
        self.big = flag(low.get("binarydatabyteordermsb", low.get("elementbyteordermsb", "False")))
        self.compressed = flag(low.get("compresseddata", "False"))
        self.skip = int(low.get("headersize", "0"))
        if self.skip < -1 or self.skip == -1 and self.compressed:
            raise MetaError("bad HeaderSize")
        self.file = low["elementdatafile"]

    @property
    def nx(self) -> int:
        return self.dims[0]

    @property
    def ny(self) -> int:
        return self.dims[1] if self.ndims > 1 else 1

    @property
    def nz(self) -> int:
        return int(np.prod(self.dims[2:])) if self.ndims > 2 else 1

    def payload(self, data: bytes, sections: int) -> list[bytes]:
        """Little-endian bytes of each section in one payload."""
        size = self.nx * self.ny * itemsize(self.type)
        if self.compressed:
            data = zlib.decompress(data[self.skip :])
        elif self.skip == -1:
            data = data[-size * sections :]
        else:
            data = data[self.skip :]
        if len(data) < size * sections:
            raise MetaError("pixels are cut off")
        kind = np.dtype((">" if self.big else "<") + self.type.numpy)
        v = np.frombuffer(data[: size * sections], kind).astype(kind.newbyteorder("<"))
        return [v[k * (len(v) // sections) : (k + 1) * (len(v) // sections)].tobytes() for k in range(sections)]


def data_files(tags_file: str, rest: bytes, nz: int) -> list[str] | None:
    """Names of the pixel files; None if the pixels follow the header.

    ``LIST`` names one file a line, ``name%d first last step`` counts, anything
    else is one file.
    """
    if tags_file.upper() == "LOCAL":
        return None
    if tags_file.upper().startswith("LIST"):
        return [x.strip() for x in rest.decode("latin-1").splitlines() if x.strip()]
    m = re.fullmatch(r"(\S*%\d*d\S*)\s+(\d+)\s+(\d+)\s+(\d+)", tags_file)
    if m:
        names = [m[1] % k for k in range(int(m[2]), int(m[3]) + 1, int(m[4]))]
        if len(names) != nz:
            raise MetaError(f"{len(names)} files for {nz} sections")
        return names
    return [tags_file]


def decode(data: bytes, fetch) -> tuple[dict[str, str], Layout, list[bytes]]:  # noqa: ANN001
    """Tags, layout and sections; ``fetch`` reads a file beside the header."""
    tags, at = parse_header(data)
    layout = Layout(tags)
    names = data_files(layout.file, data[at:], layout.nz)
    if names is None:
        return tags, layout, layout.payload(data[at:], layout.nz)
    if len(names) == 1:
        return tags, layout, layout.payload(fetch(names[0]), layout.nz)
    if len(names) != layout.nz:
        raise MetaError(f"{len(names)} files for {layout.nz} sections")
    return tags, layout, [layout.payload(fetch(n), 1)[0] for n in names]


def validate_tags(tags: dict[str, object], ndims: int) -> dict[str, str]:
    """Extra tags as text; lists of length n (or n x n) may be one value for all."""
    low = {k.lower(): k for k in tags}
    for k in RESERVED:
        if k.lower() in low:
            raise MetaError(f"{k} is set by the writer")
    for group in SYNONYMS:
        if sum(k.lower() in low for k in group) > 1:
            raise MetaError(f"only one of {', '.join(group)} may be given")
    known = {k.lower(): (k, p) for k, p in LISTS.items()}
    out = {}
    for key, value in tags.items():
        if not re.fullmatch(r"[A-Za-z0-9_-]+", key):
            raise MetaError(f"bad tag name {key!r}")
        if key.lower() in known:
            name, power = known[key.lower()]
            many = [float(v) for v in value] if isinstance(value, (list, tuple)) else [float(value)] * ndims**power
            if len(many) != ndims**power:
                raise MetaError(f"{name} needs {ndims**power} numbers")
            out[name] = " ".join(repr(v) for v in many)
        else:
            out[key] = " ".join(map(str, value)) if isinstance(value, (list, tuple)) else str(value)
    return out


def encode(pixels: bytes, ny: int, nx: int, dtype: str, *, compressed: bool = False, tags: dict[str, object] | None = None, data_file: str = "LOCAL") -> tuple[bytes, bytes]:
    """(header, payload) of one section."""
    t = TYPES[dtype]
    if t.meta is None:
        raise MetaError(f"MetaImage can't hold {dtype}")
    if compressed:
        c = zlib.compressobj(6)
        pixels = b"".join(c.compress(pixels[k : k + CHUNK]) for k in range(0, len(pixels), CHUNK)) + c.flush()
    lines = {"ObjectType": "Image", "NDims": 2, "BinaryData": True, "BinaryDataByteOrderMSB": False, "CompressedData": compressed}
    if compressed:
        lines["CompressedDataSize"] = len(pixels)
    lines |= {"DimSize": f"{nx} {ny}", "ElementType": t.meta}
    if dtype == "rgb24":
        lines["ElementNumberOfChannels"] = 3
    lines |= validate_tags(tags or {}, 2) | {"ElementDataFile": data_file}
    return "".join(f"{k} = {v}\n" for k, v in lines.items()).encode("latin-1"), pixels


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, z, ny, nx, dtype, pixels) of the files that ``path`` names.

    Files are read by Spark's binary source; only pixel files beside a header
    are opened by path on the executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                folder = row["path"].rpartition("/")[0]

                def fetch(name: str, folder: str = folder) -> bytes:
                    return store.read(name if name.startswith("/") else store.join(folder, name))

                _, layout, parts = decode(row["content"], fetch)
                for z, part in enumerate(parts):  # a batch holds one section
                    yield pa.RecordBatch.from_arrays([pa.array([row["path"]]), pa.array([z], pa.int32()), pa.array([layout.ny], pa.int32()), pa.array([layout.nx], pa.int32()), pa.array([layout.type.name]), pa.array([part], pa.binary())], names=["path", "z", "ny", "nx", "dtype", "pixels"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, " + SECTION)


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """(path, tags): each header's tags as a map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r["path"] for r in rows]), pa.array([list(parse_header(r["content"])[0].items()) for r in rows], pa.map_(pa.string(), pa.string()))], names=["path", "tags"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, tags map<string,string>")


def write(sections: DataFrame, folder: str, name: str = "%04d.mha", *, compressed: bool = False, tags: dict[str, object] | None = None) -> int:
    """One file for each section, in a folder that executors share; the number written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for r in batch.to_pylist():
                head, body = encode(r["pixels"], r["ny"], r["nx"], r["dtype"], compressed=compressed, tags=tags)
                store.write(store.join(folder, name % r["z"]), head + body)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return sum(r["n"] for r in sections.mapInArrow(run, "n long").collect())
