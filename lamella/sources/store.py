"""Files in any store that pyarrow reaches: local paths, and URIs of HDFS or object stores."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs

#: Schemes that Spark names differently.
ALIASES = {"s3a": "s3", "s3n": "s3"}


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """The store of ``path`` and the path in it."""
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(?=/)(.*)", path, re.S)
    if m is None:
        return fs.LocalFileSystem(), path
    if m[1].lower() == "file":
        return fs.LocalFileSystem(), re.sub(r"^/+", "/", m[2])
    return fs.FileSystem.from_uri(f"{ALIASES.get(m[1].lower(), m[1])}:{m[2]}")


def join(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def exists(path: str) -> bool:
    store, at = locate(path)
    return store.get_file_info(at).type != fs.FileType.NotFound


def read(path: str, start: int = 0, size: int | None = None) -> bytes:
    """``size`` bytes from ``start`` on (fewer at the end), or all."""
    store, at = locate(path)
    with store.open_input_file(at) as f:
        f.seek(start)
        return f.read() if size is None else f.read(size)


def write(path: str, data: bytes) -> None:
    """The whole file appears at once: a task that runs twice leaves the same file."""
    store, at = locate(path)
    folder = at.rpartition("/")[0]
    if folder:
        store.create_dir(folder)
    part = f"{at}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(part, compression=None) as f:
        f.write(data)
    store.move(part, at)


def append(path: str, data: bytes) -> None:
    """``data`` behind what the file holds; stores that can't append write the whole file anew."""
    store, at = locate(path)
    if isinstance(store, fs.LocalFileSystem):
        with open(at, "ab") as f:
            f.write(data)
    else:
        write(path, (read(path) if exists(path) else b"") + data)


def remove(path: str) -> None:
    store, at = locate(path)
    kind = store.get_file_info(at).type
    if kind == fs.FileType.Directory:
        store.delete_dir(at)
    elif kind == fs.FileType.File:
        store.delete_file(at)
