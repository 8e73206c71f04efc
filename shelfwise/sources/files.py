"""Recursive scans of file collections: plain files and archive entries with their digests, headers stripped by rule."""

from __future__ import annotations

import hashlib
import heapq
import io
import tempfile
import zlib
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import archive_ordinal, archive_type, archive_type_of
from ..functions.tables import materialize, running_sum, small, spread
from ..operators.headers import EOF, Detector, find_rule, scan_bounds
from ..plans.progress import Progress
from ..schema import SCAN
from .archives import Tools, entries
from .listing import list_files  # noqa: F401 (listings and scans go together)
from .storage import PIECE, View, open_input

COLUMNS = [c.split()[0] for c in SCAN.split(", ")]


def size_bounds(roms: DataFrame, detectors: list[Detector]) -> tuple[int, int]:
    """The range of file sizes that can match the catalog's files (column size; null sizes are left out)."""
    lo, hi = roms.agg(F.min("size"), F.max("size")).first()
    least, most, _ = scan_bounds((lo, hi), detectors)
    return least, most


def worth_reading(files: DataFrame, bounds: tuple[int, int]) -> DataFrame:
    """files (path, length) that a scan opens: plain files of sizes within bounds, and all archives. Rows of a listing that say why
    something could not be looked at stay."""
    kind = archive_type(F.col("path"))
    if "message" in files.columns:  # one look at a listing; its source has left out most of the others already
        return files.where(F.coalesce(F.col("length").between(*bounds), F.lit(False)) | kind.isNotNull() | F.col("message").isNotNull())
    return files.where(F.col("length").between(*bounds)).where(kind.isNull()).unionByName(files.where(kind.isNotNull()))


def also_scanned(roms: DataFrame) -> list[str]:
    """Archive types that the catalog lists as files of their own; such archives are scanned both ways."""
    return [r[0] for r in roms.select(archive_type(F.col("rom_name")).alias("t")).where("t is not null").distinct().collect()]


def _sums(parts) -> dict:
    """Length and digests of a content that comes in parts."""
    size, crc, sums = 0, 0, {k: hashlib.new(k) for k in ("md5", "sha1", "sha256")}
    for part in parts:
        size, crc = size + len(part), zlib.crc32(part, crc)
        for h in sums.values():
            h.update(part)
    return {"unheadered_size": size, "crc": f"{crc:08x}", **{k: h.hexdigest() for k, h in sums.items()}}


def _row(view, detectors, piece: int) -> dict:
    """Sizes, digests and status of seekable content."""
    rule, error = find_rule(view, detectors)
    return {"size": len(view), **_sums(rule.pieces(view, piece)), "status": "OK" if error is None else "RULE_FAILED", "message": error}


def _entry_row(entry, detectors, piece: int) -> dict:
    """The same of an archive's entry, whose content comes once; rules need it seekable, so long entries go to a scratch file."""
    if not detectors:
        sums = _sums(entry.pieces(piece))
        return {"size": sums["unheadered_size"], **sums, "status": "OK", "message": None}
    with tempfile.SpooledTemporaryFile(max_size=piece) as f:
        for part in entry.pieces(piece):
            f.write(part)
        return _row(View(f, f.tell()), detectors, piece)


def _file_rows(path: str, source, bounds, detectors, also, tools: Tools, piece: int):
    """The rows of one file; what cannot be read becomes a FAILED row, and entries read before stay."""
    lo, hi = bounds
    kind, failed = archive_type_of(path), None
    named = dict.fromkeys(COLUMNS) | {"path": path}
    if kind:
        try:
            for e in entries(kind, source, tools):
                if e.size is None or lo <= e.size <= hi:
                    yield named | {"archive_type": kind, "archive_path": e.name} | _entry_row(e, detectors, piece)
        except Exception as e:  # any broken archive must not stop a scan
            failed = f"{type(e).__name__}: {e}"
    view = View(source)
    if (not kind or failed or kind in also) and lo <= len(view) <= hi:
        yield named | _row(view, detectors, piece) | ({"status": "FAILED", "message": failed} if failed else {})


def scan(files: DataFrame, bounds: tuple[int, int] = (0, EOF), detectors: list[Detector] = (), also: list[str] = (), tools: Tools = Tools(), large: int = PIECE, by_content: bool = False,
         progress: Progress | None = None) -> DataFrame:
    """Scan rows of files (path, length): one per plain file and per archive entry within bounds.

    Files whose names are an archive's are read as archives; one that cannot be read is scanned as a plain file, with the
    failure in `message`; a file that cannot be opened or read, or a folder that could not be listed, is a FAILED row without
    digests. The bounds prune plain files
    before they are opened; archives are read whatever their size, their entries pruned one by one. Files and entries of
    every size take the same way, in pieces of `large` bytes, through the file systems that Arrow opens. For others,
    by_content reads Spark's content column instead (2 GB a file at most).
    """
    detectors, also, listed = list(detectors), set(also), "message" in files.columns

    def run(frames):
        done = []  # rows of many files go out together
        for pdf in frames:
            none = [None] * len(pdf)
            for path, content, unlisted in zip(pdf["path"], pdf["content"] if by_content else none, pdf["message"] if listed else none):
                rows = []
                try:
                    if isinstance(unlisted, str):
                        raise OSError(unlisted)
                    with io.BytesIO(content) if by_content else open_input(path) as source:
                        for row in _file_rows(path, source, bounds, detectors, also, tools, large):
                            rows.append(row)
                            if len(rows) == 1000:
                                yield pd.DataFrame(rows, columns=COLUMNS)
                                rows = []
                except Exception as e:  # one unreadable file must not stop a scan
                    rows.append(dict.fromkeys(COLUMNS) | {"path": path, "status": "FAILED", "message": f"{type(e).__name__}: {e}"})
                if progress:
                    progress.add(1, sum(r["size"] or 0 for r in rows), sum(r["status"] != "OK" for r in rows))
                done += rows
                if len(done) >= 1000:
                    yield pd.DataFrame(done, columns=COLUMNS)
                    done = []
        if done:
            yield pd.DataFrame(done, columns=COLUMNS)

    todo = worth_reading(files, bounds).select("path", *["content"] * by_content, *["message"] * listed)
    if listed and not by_content and not files.isStreaming:
        todo = spread(todo, "path")  # a folder of any number of files is one partition of its listing
    return todo.mapInPandas(run, SCAN)


def scan_order(rows: DataFrame) -> DataFrame:
    """Scan rows with the largest first; equal sizes by archive type, path and entry."""
    return rows.orderBy(F.col("size").desc_nulls_last(), archive_ordinal(F.col("archive_type")), "path", F.col("archive_path").asc_nulls_first())


#: Files of at least this part of a task's share are placed one by one, the others by running sums.
LARGE = 0.1


def schedule(files: DataFrame, tasks: int) -> DataFrame:
    """files (path, length) dealt over `tasks` partitions so that their bytes are near equal, each partition's largest files first.

    Files of a tenth of a task's share or more (at most ten a task, so their number is bounded by tasks) are placed on the driver,
    largest first, each where least is. The others fill up what is left: running sums of their lengths, in the order of length
    and path, say which partition a file falls into, so no partition gets more than a tenth of a share beyond the level. Null
    lengths count as 0; rows that repeat are files each; an empty listing stays empty.
    """
    size = F.coalesce("length", F.lit(0))
    rows = materialize(files.withColumn("_id", F.monotonically_increasing_id()), "listing")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    large = rows.where((size > 0) & (size >= LARGE * total / tasks)).select("_id", size.alias("length"))
    loads, placed = [(0, t) for t in range(tasks)], []
    for r in sorted(large.collect(), key=lambda r: (-r["length"], r["_id"])):  # at most tasks / LARGE rows
        load, t = heapq.heappop(loads)
        heapq.heappush(loads, (load + r["length"], t))
        placed.append((r["_id"], t))
    held = sorted(loads, key=lambda x: x[1])
    level = _level([x for x, _ in held], total - sum(x for x, _ in held))
    gaps = list(accumulate(max(0, level - x) for x, _ in held))
    here = rows.sparkSession.createDataFrame(placed, "_id long, _task int")
    rest = rows.join(small(here, len(placed), 16), "_id", "left_anti")
    summed = running_sum(rest.orderBy(size.desc(), "path", "_id"), size, "_before").drop("_row")
    at = F.aggregate(F.array(*map(F.lit, gaps)), F.lit(0), lambda acc, g: acc + (g <= F.col("_before")).cast("int"))
    dealt = rows.join(small(here, len(placed), 16), "_id").unionByName(summed.withColumn("_task", F.least(at, F.lit(tasks - 1))).drop("_before"))
    return dealt.repartitionById(tasks, "_task").sortWithinPartitions(size.desc(), "path").drop("_id", "_task")


def _level(loads: list[int], rest: int) -> int:
    """The height to which `rest` fills up the lower ones of loads."""
    loads = sorted(loads)
    for k, x in enumerate(loads[1:], 1):
        if k * x - sum(loads[:k]) >= rest:
            return -(-(sum(loads[:k]) + rest) // k)
    return -(-(sum(loads) + rest) // len(loads))
