"""Files by name and range, where Spark's readers only take whole ones: listings, heads, copies, renames.

Paths are those Spark shows. They are opened by pyarrow, which knows local folders, HDFS, S3 and
GCS; ``opens`` tells whether a path's store is one of them.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

from pyarrow import ArrowException, fs

STEP = 1 << 20


def at(path: str) -> tuple[fs.FileSystem, str]:
    bare = re.sub(r"^file:/*(?=/)", "", path)
    return (fs.LocalFileSystem(), bare) if bare.startswith("/") else fs.FileSystem.from_uri(path)


def opens(path: str) -> bool:
    try:
        at(path)
    except (ArrowException, OSError, ValueError):
        return False
    return True


def identity(info: fs.FileInfo) -> str:
    return f"{info.size}:{info.mtime_ns}"


def stat(path: str) -> fs.FileInfo | None:
    """Size and time of a file; None if there is none."""
    store, p = at(path)
    info = store.get_file_info(p)
    return info if info.type == fs.FileType.File else None


def listing(path: str, recursive: bool = False) -> list[fs.FileInfo] | None:
    """The files of a folder; None if it isn't there."""
    store, p = at(path)
    if store.get_file_info(p).type != fs.FileType.Directory:
        return None
    try:
        return [f for f in store.get_file_info(fs.FileSelector(p, recursive=recursive, allow_not_found=True)) if f.type == fs.FileType.File]
    except FileNotFoundError:  # went meanwhile
        return None


def folder_identity(path: str) -> str | None:
    """What tells a folder from another one put in its place, where the store can tell; None without a folder."""
    store, p = at(path)
    if store.get_file_info(p).type != fs.FileType.Directory:
        return None
    if not isinstance(store, fs.LocalFileSystem):
        return "there"
    try:
        s = os.stat(p)
    except OSError:
        return None
    return f"{s.st_dev}:{s.st_ino}"


def head(path: str, most: int) -> bytes:
    """The first bytes of a file; nothing behind them is read."""
    store, p = at(path)
    with store.open_input_file(p) as f:
        return f.read_at(min(most, f.size()), 0)


def chunks(path: str) -> Iterator[bytes]:
    store, p = at(path)
    with store.open_input_stream(p) as f:
        while part := f.read(STEP):
            yield part


def digest(path: str) -> str:
    h = hashlib.sha256()
    for part in chunks(path):
        h.update(part)
    return h.hexdigest()


def write(path: str, data: bytes) -> None:
    """Written under another name first, so that nobody reads a part of it."""
    store, p = at(path)
    store.create_dir(os.path.dirname(p), recursive=True)
    with store.open_output_stream(p + ".tmp") as f:
        f.write(data)
    store.move(p + ".tmp", p)


def read(path: str) -> bytes | None:
    store, p = at(path)
    if store.get_file_info(p).type != fs.FileType.File:
        return None
    with store.open_input_stream(p) as f:
        return f.read()


def remove(path: str) -> None:
    store, p = at(path)
    if store.get_file_info(p).type == fs.FileType.File:
        store.delete_file(p)
