"""Files by path or URL, for Python workers: seekable streams, never whole files."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from urllib.parse import unquote

PIECE = 8 << 20


def local(path: str) -> str | None:
    """The path in this machine's file system, or None for one of another file system. Paths are never unquoted or cut at `#` or
    `?`: names hold these as they are."""
    if path.startswith("file:"):
        return re.sub("^file:(//[^/]*)?", "", path)
    return None if "://" in path else path


def _remote(path: str):
    """The file system of a path, and the path there. Only scheme and authority are read as a URL."""
    from pyarrow import fs

    top, rest = re.match("([^:]+://[^/]*)/*(.*)", path, re.DOTALL).groups()
    system, base = fs.FileSystem.from_uri(f"{top}/")
    return system, f"{base.rstrip('/')}/{rest}" if base != "" else rest


def _existing(here: str, path: str) -> str:
    """here, or the unquoted path of a `file:` URL where only that is there."""
    if "%" in here and path.startswith("file:") and not os.path.lexists(here) and os.path.exists(unquote(here)):
        return unquote(here)
    return here


def open_input(path: str):
    """A seekable binary stream."""
    here = local(path)
    if here is not None:
        return open(_existing(here, path), "rb")
    system, name = _remote(path)
    return system.open_input_file(name)


def modified(path: str) -> float | None:
    here = local(path)
    if here is not None:
        return os.stat(_existing(here, path)).st_mtime
    system, name = _remote(path)
    when = system.get_file_info(name).mtime
    return when.timestamp() if when else None


def write_file(path: str, write, times: tuple[float, float] | None = None) -> None:
    """Call write(stream) on a file beside the target, then rename it, so that a longer older file leaves no tail and a
    failure leaves no part. Other file systems get the finished file in one go."""
    here = local(path)
    folder = os.path.dirname(here) or "." if here is not None else None
    if folder:
        os.makedirs(folder, exist_ok=True)
    fd, temp = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(fd, "w+b") as f:
            write(f)
        if here is None:
            system, name = _remote(path)
            with open(temp, "rb") as f, system.open_output_stream(name) as out:
                shutil.copyfileobj(f, out, PIECE)
            return
        if times:
            os.utime(temp, times)
        os.replace(temp, here)
    finally:
        if os.path.exists(temp):
            os.unlink(temp)


def remove_tree(path: str) -> None:
    """Remove a folder and what is in it, if it is there."""
    here = local(path)
    if here is not None:
        return shutil.rmtree(here, ignore_errors=True)
    system, name = _remote(path)
    if system.get_file_info(name).type.name == "Directory":
        system.delete_dir(name)


class View:
    """Random access to a seekable stream as to bytes: len() and slices."""

    def __init__(self, stream, size: int | None = None):
        self.stream = stream
        self.size = stream.seek(0, os.SEEK_END) if size is None else size

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, s: slice) -> bytes:
        a, b, _ = s.indices(self.size)
        self.stream.seek(a)
        return self.stream.read(max(0, b - a))
