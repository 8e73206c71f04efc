"""Names of operating systems and architectures, as columns and for this machine."""

from __future__ import annotations

import platform
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The known names and the patterns (of the whole normalised text, but systems by their beginning).
SYSTEMS = {"LINUX": r"^linux", "OSX": r"^(macosx|osx)", "BSD": r"^(freebsd|openbsd|netbsd)", "WINDOWS": r"^windows"}
ARCHITECTURES = {
    "X86_64": r"^(x8664|amd64|ia32e|em64t|x64)$",
    "X86_32": r"^(x8632|x86|i[3-6]86|ia32|x32)$",
    "ARM_32": r"^(arm|arm32|armhf|armv7l|armv7)$",
    "ARM_64": r"^(arm64|aarch64|armv8l|armv8|armv9l|armv9)$",
    "POWER_PC_32": r"^(ppc|ppc32)$",
    "POWER_PC_64": r"^ppc64$",
}
UNKNOWN = "UNKNOWN"


def _named(text: Column, names: dict[str, str]) -> Column:
    plain, out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", ""), F.lit(UNKNOWN)
    for name, pattern in reversed(names.items()):
        out = F.when(plain.rlike(pattern), name).otherwise(out)
    return out


def operating_system(text: Column) -> Column:
    """LINUX, OSX, BSD or WINDOWS for what a system calls itself; UNKNOWN for others and null."""
    return _named(text, SYSTEMS)


def architecture(text: Column) -> Column:
    return _named(text, ARCHITECTURES)


def _of(text: str, names: dict[str, str]) -> str:
    plain = re.sub("[^a-z0-9]+", "", text.lower())
    return next((n for n, p in names.items() if re.search(p, plain)), UNKNOWN)


def this_system() -> tuple[str, str]:
    """(operating system, architecture) of the machine that runs this."""
    system = "macosx" if platform.system() == "Darwin" else platform.system()
    return _of(system, SYSTEMS), _of(platform.machine(), ARCHITECTURES)
