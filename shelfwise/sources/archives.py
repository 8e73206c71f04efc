"""Readers and writers of archives: one stream of entries for every type, so any type converts to any writable one.

Entries are read in physical order, each as a stream of its own that is passed over before the next one, so neither an
archive nor an entry is ever held whole.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import os
import shutil
import struct
import subprocess
import tarfile
import tempfile
import threading
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime
from functools import lru_cache

from .storage import PIECE


class Unsupported(RuntimeError):
    """An archive type that nothing here can read or write."""


class Entry:
    """A name with times and content, which is bytes or a stream (read once, before the next entry) and its size."""

    def __init__(self, name: str, data: bytes | None = None, mtime: float | None = None, atime: float | None = None, ctime: float | None = None, stream=None, size: int | None = None):
        self.name, self.mtime, self.atime, self.ctime = name.replace("\\", "/"), mtime, atime, ctime
        self._data, self.stream = data, stream
        self.size = len(data) if data is not None else size

    @property
    def data(self) -> bytes:
        if self._data is None:
            self._data = self.stream.read()
        return self._data

    def pieces(self, piece: int = PIECE) -> Iterator[bytes]:
        if self._data is not None:
            yield from (self._data[i : i + piece] for i in range(0, len(self._data), piece))
            return
        while part := self.stream.read(piece):
            yield part

    def renamed(self, name: str) -> Entry:
        return Entry(name, self._data, self.mtime, self.atime, self.ctime, self.stream, self.size)


@lru_cache(None)
def tool(name: str) -> str | None:
    return shutil.which(name)


class _Unpacked:
    """The output of a command that is fed with a stream; a failed command raises when its output ends."""

    def __init__(self, command: list[str], source=None):
        self.errors = tempfile.TemporaryFile()
        self.run = subprocess.Popen(command, stdin=subprocess.PIPE if source else subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=self.errors)
        self.failed: Exception | None = None
        if source:
            threading.Thread(target=self._feed, args=(source,), daemon=True).start()

    def _feed(self, source) -> None:
        try:
            shutil.copyfileobj(source, self.run.stdin, PIECE)
        except BrokenPipeError:
            pass  # the command has seen enough, or has failed and says why
        except Exception as e:
            self.failed = e
        finally:
            try:
                self.run.stdin.close()
            except BrokenPipeError:
                pass

    def read(self, n: int = -1) -> bytes:
        got = self.run.stdout.read(n)
        if not got and n:
            self.check()
        return got

    def check(self) -> None:
        if self.run.wait() or self.failed:
            self.errors.seek(0)
            raise ValueError(str(self.failed or "") or self.errors.read().decode(errors="replace").strip()[:300] or "unreadable archive")

    def close(self) -> None:
        self.run.stdout.close()
        self.run.kill()
        self.run.wait()
        self.errors.close()


@contextmanager
def _decoded(codec: str, source):
    """A stream of the decompressed bytes of a stream."""
    if codec == "bz2":
        out = bz2.BZ2File(source)
    elif codec == "gz":
        out = gzip.GzipFile(fileobj=source)
    elif codec in ("xz", "lzma"):
        out = lzma.LZMAFile(source, format=lzma.FORMAT_XZ if codec == "xz" else lzma.FORMAT_ALONE)
    elif tool("lz4"):
        out = _Unpacked([tool("lz4"), "-d", "-c"], source)
    else:
        raise Unsupported("lz4 needs the lz4 tool")
    try:
        yield out
    finally:
        out.close()


@contextmanager
def _encoded(codec: str, target):
    """A stream whose bytes go compressed into the real file target."""
    if codec == "bz2":
        out = bz2.BZ2File(target, "w")
    elif codec == "gz":
        out = gzip.GzipFile(fileobj=target, mode="wb", mtime=0)
    elif codec in ("xz", "lzma"):
        out = lzma.LZMAFile(target, "w", format=lzma.FORMAT_XZ if codec == "xz" else lzma.FORMAT_ALONE)
    elif codec == "lz4" and not tool("lz4") or codec == "7z" and not tool("bsdtar"):
        raise Unsupported(f"{codec} needs the {'lz4' if codec == 'lz4' else 'bsdtar'} tool")
    else:
        target.flush()
        command = [tool("lz4"), "-z", "-c"] if codec == "lz4" else [tool("bsdtar"), "-c", "-f", "-", "--format", "7zip", "@-"]
        run = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=target, stderr=subprocess.DEVNULL)
        try:
            yield run.stdin
            run.stdin.close()
        finally:
            code = run.wait() if run.stdin.closed else (run.kill(), run.wait())[1]
        if code:
            raise ValueError(f"{command[0]} failed with {code}")
        return
    with out:
        yield out


#: What a tar archive may be compressed with: the part of the type after `tar.`.
CODECS = ("bz2", "gz", "lz4", "lzma", "xz")


#: Seconds from the epoch of Windows file times (1601) to that of Unix times.
WINDOWS_EPOCH = 11_644_473_600


def windows_time(seconds: float) -> int:
    """100-nanosecond ticks since 1601, to the microsecond."""
    return (round(seconds * 1_000_000) + WINDOWS_EPOCH * 1_000_000) * 10


def unix_time(ticks: int) -> float:
    return ticks // 10 / 1_000_000 - WINDOWS_EPOCH


def time_field(e: Entry) -> bytes:
    """A zip extra field with the entry's times: whole seconds where all fit 31 bits and have no fraction, else NTFS times."""
    times = [e.mtime, e.atime, e.ctime]
    given = [t for t in times if t is not None]
    if not given:
        return b""
    if all(0 <= t <= 2**31 - 1 and t == int(t) for t in given):
        body = bytes([sum(1 << i for i, t in enumerate(times) if t is not None)]) + b"".join(int(t).to_bytes(4, "little") for t in given)
        return struct.pack("<HH", 0x5455, len(body)) + body
    ticks = [0 if t is None else windows_time(t) for t in times]
    return struct.pack("<HHIHHQQQ", 0x000A, 32, 0, 1, 24, *ticks)


def times_of(extra: bytes) -> tuple[float | None, float | None, float | None]:
    """(mtime, atime, ctime) of a zip extra field; NTFS times win over whole seconds."""
    out: list[float | None] = [None, None, None]
    found = {}
    while len(extra) >= 4:
        kind, n = struct.unpack_from("<HH", extra)
        found[kind], extra = extra[4 : 4 + n], extra[4 + n :]
    if body := found.get(0x5455):
        at = 1
        for i in range(3):
            if body[0] >> i & 1 and at + 4 <= len(body):
                out[i] = float(int.from_bytes(body[at : at + 4], "little", signed=True))
                at += 4
    if (body := found.get(0x000A)) and len(body) >= 32 and body[4:8] == b"\x01\x00\x18\x00":
        ticks = struct.unpack_from("<QQQ", body, 8)
        out = [unix_time(t) if t else old for t, old in zip(ticks, out)]
    return out[0], out[1], out[2]


@dataclass(frozen=True)
class Tools:
    """Which tools read what the standard library cannot; forcing both rar tools disables reading by either."""

    unrar: str | None = None
    seven_zip: str | None = None
    force_unrar: bool = False
    force_seven_zip: bool = False

    def command(self, kind: str, archive: str, folder: str) -> list[str] | None:
        """The command that unpacks an archive into a folder or streams it as tar, or None: unrar before 7z for rar, unless forced."""
        unrar, seven = self.unrar or tool("unrar"), self.seven_zip or tool("7z") or tool("7zz")
        if kind == "rar" and self.force_unrar and self.force_seven_zip:
            return None
        if kind == "rar" and unrar and not self.force_seven_zip:
            return [unrar, "x", "-inul", "-y", archive, folder + "/"]
        if seven and not (kind == "rar" and self.force_unrar):
            return [seven, "x", "-bd", "-y", f"-o{folder}", archive]
        if tool("bsdtar") and not (kind == "rar" and (self.force_unrar or self.force_seven_zip)):
            return [tool("bsdtar"), "-c", "-f", "-", "--format", "pax", f"@{archive}"]  # a stream in physical order
        return None


@contextmanager
def _on_disk(kind: str, source):
    """The path of a stream's bytes: its own where it is a file of this machine, else of a copy."""
    name = getattr(source, "name", None)
    if isinstance(name, str) and os.path.isfile(name):
        yield name
        return
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, f"a.{kind}")
        with open(path, "wb") as f:
            shutil.copyfileobj(source, f, PIECE)
        yield path


def _by_tool(kind: str, source, tools: Tools) -> Iterator[Entry]:
    with _on_disk(kind, source) as packed, tempfile.TemporaryDirectory() as inside:  # the formats need seeking
        command = tools.command(kind, packed, inside)
        if command is None:
            raise Unsupported(f"no tool reads {kind} archives here")
        if command[0] == tool("bsdtar"):
            out = _Unpacked(command)
            try:
                yield from _tar_entries(out)
            except tarfile.ReadError:
                out.check()  # an empty output that is no failure is an archive without entries
            finally:
                out.close()
            return
        done = subprocess.run(command, capture_output=True)
        if done.returncode:
            raise ValueError(done.stderr.decode(errors="replace").strip()[:300] or "unreadable archive")
        for top, folders, names in os.walk(inside):
            folders.sort()
            for n in sorted(names):
                path = os.path.join(top, n)
                if os.path.isfile(path) and not os.path.islink(path):
                    with open(path, "rb") as f:
                        st = os.stat(path)
                        yield Entry(os.path.relpath(path, inside), None, st.st_mtime, st.st_atime, stream=f, size=st.st_size)


def _tar_entries(stream) -> Iterator[Entry]:
    with tarfile.open(fileobj=stream, mode="r|") as t:
        for m in t:
            if m.isreg():
                pax = lambda k, m=m: float(m.pax_headers[k]) if k in m.pax_headers else None
                yield Entry(m.name, None, float(m.mtime), pax("atime"), pax("ctime"), stream=t.extractfile(m), size=m.size)


def entries(kind: str, source, tools: Tools = Tools()) -> Iterator[Entry]:
    """All regular entries in physical order (in name order where unrar or 7z unpack them); no folders, no links. The source
    is a seekable stream; of bytes, entries hold their content, so they can be kept."""
    if isinstance(source, bytes):
        for e in entries(kind, io.BytesIO(source), tools):
            e.data  # noqa: B018 (read while it is there)
            yield e
    elif kind == "zip":
        with zipfile.ZipFile(source) as z:
            for i in sorted(z.infolist(), key=lambda i: i.header_offset):
                if not i.is_dir() and (i.external_attr >> 16) & 0o170000 != 0o120000:
                    m, a, c = times_of(i.extra)
                    with z.open(i) as f:
                        yield Entry(i.filename, None, datetime(*i.date_time).timestamp() if m is None and i.date_time[0] >= 1980 else m, a, c, stream=f, size=i.file_size)
    elif kind == "tar":
        yield from _tar_entries(source)
    elif kind[4:] in CODECS:
        with _decoded(kind[4:], source) as stream:
            yield from _tar_entries(stream)
    elif kind in ("7z", "rar"):
        yield from _by_tool(kind, source, tools)
    else:
        raise Unsupported(f"no reader for {kind}")


def read_archive(kind: str, source, names: list[str] | None = None, tools: Tools = Tools()) -> Iterator[Entry]:
    """Entries, or only those named, in physical order whatever the order of names; names that are missing raise."""
    left = None if names is None else {n.replace("\\", "/") for n in names}
    for e in entries(kind, source, tools):
        if left is None:
            yield e
        elif e.name in left:
            left.discard(e.name)
            yield e
            if not left:
                return
    if left:
        raise KeyError(f"no such entries: {', '.join(sorted(left))}")


def write_entries(kind: str, items: Iterable[Entry], out) -> None:
    """An archive of items, taken one by one, into the real file out."""
    if kind == "zip":
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for e in items:
                when = datetime.fromtimestamp(min(e.mtime, 4354732800)).timetuple()[:6] if e.mtime and e.mtime >= 315619200 else (1980, 1, 1, 0, 0, 0)  # the field ends with 2107
                info = zipfile.ZipInfo(e.name, when)
                info.compress_type, info.external_attr, info.extra, info.file_size = zipfile.ZIP_DEFLATED, 0o644 << 16, time_field(e), e.size or 0
                with z.open(info, "w") as f:
                    for part in e.pieces():
                        f.write(part)
    elif kind == "tar":
        with tarfile.open(fileobj=out, mode="w|", format=tarfile.PAX_FORMAT) as t:
            for e in items:
                info = tarfile.TarInfo(e.name)
                info.size, info.mtime = e.size, e.mtime or 0
                info.pax_headers = {k: f"{v:.7f}" for k, v in (("atime", e.atime), ("ctime", e.ctime)) if v is not None}
                t.addfile(info, io.BytesIO(e.data) if e.stream is None else e.stream)
    elif kind[4:] in CODECS or kind == "7z":
        with _encoded(kind[4:] or kind, out) as stream:
            write_entries("tar", items, stream)
    else:
        raise Unsupported(f"{kind} cannot be written")


def write_archive(kind: str, items: Iterable[Entry]) -> bytes:
    with tempfile.TemporaryFile() as out:
        write_entries(kind, items, out)
        out.seek(0)
        return out.read()


def raw_zip_copy(source, names: list[str], out=None) -> bytes | None:
    """The named entries of a zip in a new one, their compressed bytes as they are; names cannot change. Source: a seekable
    stream or bytes; without a stream `out` the new zip is returned."""
    source = io.BytesIO(source) if isinstance(source, bytes) else source
    new_zip = io.BytesIO() if out is None else out
    wanted = set(names)
    with zipfile.ZipFile(source) as z, zipfile.ZipFile(new_zip, "w") as new:
        if missing := wanted - set(z.namelist()):
            raise KeyError(f"no such entries: {', '.join(sorted(missing))}")
        for i in sorted(z.infolist(), key=lambda i: i.header_offset):
            if i.filename in wanted:
                source.seek(i.header_offset)
                head = source.read(30)
                source.seek(i.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
                copy = zipfile.ZipInfo(i.filename, i.date_time)
                copy.compress_type, copy.CRC, copy.compress_size, copy.file_size, copy.external_attr = i.compress_type, i.CRC, i.compress_size, i.file_size, i.external_attr
                copy.header_offset = new_zip.tell()
                new_zip.write(copy.FileHeader())
                left = i.compress_size
                while left and (part := source.read(min(left, PIECE))):
                    new_zip.write(part)
                    left -= len(part)
                new.filelist.append(copy)
                new.NameToInfo[copy.filename] = copy
                new.start_dir = new_zip.tell()
                new._didModify = True
    return new_zip.getvalue() if out is None else None
