"""Column expressions over file names, sizes and bytes."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Archive types in their order, name patterns, and whether they can be written.
ARCHIVES = (
    ("zip", r"(?i)\.zip$", True),
    ("rar", r"(?i)\.rar$", False),
    ("7z", r"(?i)(?<!\.tar)\.7z$", True),
    ("tar", r"(?i)\.tar$", True),
    ("tar.bz2", r"(?i)\.(tar\.bz2|tbz2|tbz|tar\.bz)$", True),
    ("tar.gz", r"(?i)\.(tar\.gz|tgz|taz|tar\.z)$", True),
    ("tar.lz4", r"(?i)\.tar\.lz4$", True),
    ("tar.lzma", r"(?i)\.tar\.lzma$", True),
    ("tar.xz", r"(?i)\.(tar\.xz|txz)$", True),
)
UNITS = ("B", "KB", "MB", "GB", "TB", "PB", "EB")


def archive_type(name: Column) -> Column:
    """Archive type by file name, null for other files."""
    out = F.lit(None).cast("string")
    for alias, pattern, _ in reversed(ARCHIVES):
        out = F.when(name.rlike(pattern), alias).otherwise(out)
    return out


def archive_ordinal(kind: Column) -> Column:
    """Sort key of archive types: null (a loose file) first, then the types' order."""
    out = F.lit(-1)
    for i, (alias, _, _) in enumerate(ARCHIVES):
        out = F.when(kind == alias, i).otherwise(out)
    return out


def archive_type_of(name: str) -> str | None:
    return next((alias for alias, pattern, _ in ARCHIVES if re.search(pattern, name)), None)


def output_types() -> list[str]:
    return [alias for alias, _, ok in ARCHIVES if ok]


def unit_index(size: Column) -> Column:
    out = F.lit(0)
    for i in range(1, len(UNITS)):
        out = F.when(size >= float(1024**i), i).otherwise(out)
    return out


def format_size(size: Column, fixed: bool = False) -> Column:
    """A byte count in the largest unit that it fills, with two decimals; fixed: padded to a fixed width."""
    k = unit_index(size)
    symbol = F.element_at(F.array(*map(F.lit, UNITS)), k + 1)
    return F.format_string("%7.2f %2s" if fixed else "%.2f %s", size.cast("double") / F.pow(F.lit(1024.0), k), symbol)


SIZE_PATTERN = r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*([KMGTPE]?B?)\s*$"


def parse_size(text: Column) -> Column:
    """Bytes of a size such as `1.5 MB` or `64k`, rounded half up; null where it is no size."""
    unit = F.regexp_replace(F.upper(F.regexp_extract(text, SIZE_PATTERN, 2)), "B$", "")
    factor = F.lit(1.0)
    for i, u in enumerate(UNITS[1:], 1):
        factor = F.when(unit == u[0], float(1024**i)).otherwise(factor)
    return F.when(text.rlike(SIZE_PATTERN), F.floor(F.regexp_extract(text, SIZE_PATTERN, 1).try_cast("double") * factor + 0.5).cast("long"))


@dataclass(frozen=True, order=False)
class ByteSize:
    """A size with its unit, for configuration values."""

    size: float
    unit: str = "B"

    @classmethod
    def parse(cls, text: str) -> ByteSize:
        m = re.match(r"(?i)\s*([0-9]+(?:\.[0-9]+)?)\s*([KMGTPE]?B?)\s*$", text)
        if not m:
            raise ValueError(f"not a byte size: {text!r}")
        letter = m[2].upper().rstrip("B")
        return cls(float(m[1]), f"{letter}B" if letter else "B")

    @classmethod
    def of(cls, count: float) -> ByteSize:
        k = max((i for i in range(len(UNITS)) if count >= 1024**i), default=0)
        return cls(count / 1024**k, UNITS[k])

    def in_bytes(self) -> int:
        return math.floor(self.size * 1024 ** UNITS.index(self.unit) + 0.5)

    def normalized(self) -> ByteSize:
        return ByteSize.of(self.in_bytes())

    def __lt__(self, other: ByteSize) -> bool:
        return self.in_bytes() < other.in_bytes()

    def __str__(self) -> str:
        return f"{self.size:.2f} {self.unit}"

    def fixed(self) -> str:
        return f"{self.size:7.2f} {self.unit:>2s}"


def digests(content: Column) -> dict[str, Column]:
    """Lower-case hex digests of a binary column, read once."""
    return {"crc": F.lpad(F.lower(F.hex(F.crc32(content))), 8, "0"), "md5": F.md5(content), "sha1": F.sha1(content), "sha256": F.sha2(content, 256)}


def spaced_hex(content: Column) -> Column:
    return F.regexp_replace(F.hex(content), "(..)(?!$)", "$1 ")


def from_spaced_hex(text: Column) -> Column:
    return F.unhex(F.regexp_replace(text, r"\s+", ""))


def comma_list(text: Column, lower: bool = True) -> Column:
    """Trimmed, non-empty elements of a comma-separated text."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.transform(parts, F.lower) if lower else parts


def joined_list(items: Column, capital: bool = False) -> Column:
    shown = F.transform(items, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))) if capital else items
    return F.array_join(shown, ", ")


def truncated_time(time: Column, unit: str = "microsecond") -> Column:
    """A timestamp cut to microseconds, milliseconds or seconds."""
    return F.date_trunc(unit, time)


def windows_ticks(time: Column) -> Column:
    """100-nanosecond ticks since 1601 of a timestamp, to the microsecond."""
    return (F.unix_micros(time) + F.lit(11_644_473_600_000_000)) * 10


def from_windows_ticks(ticks: Column) -> Column:
    return F.timestamp_micros(F.floor(ticks.cast("decimal(20,0)") / 10).cast("long") - F.lit(11_644_473_600_000_000))


def output_dir(name: Column, n_roms: Column, alphabetic: bool, force_subfolder: bool) -> Column:
    """Folder of an item below the output folder: a first-letter folder if asked, and one of its own if forced or if it has
    more than one file; '' for the output folder itself."""
    letter = F.substring(F.lower(name), 1, 1)
    letter = F.when(letter.rlike("^[a-z]$"), letter).otherwise("#") if alphabetic else F.lit(None).cast("string")
    own = name if force_subfolder else F.when(n_roms > 1, name)
    return F.concat_ws("/", letter, own)
