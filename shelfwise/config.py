"""Options of a selection, as plain records."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Filter:
    include_regions: tuple[str, ...] = ()
    exclude_regions: tuple[str, ...] = ()
    include_languages: tuple[str, ...] = ()
    exclude_languages: tuple[str, ...] = ()
    allow_bios: bool = True
    allow_proto: bool = True
    allow_beta: bool = True
    allow_demo: bool = True
    allow_sample: bool = True
    excludes: tuple[str, ...] = ()
    includes: tuple[str, ...] = ()


@dataclass(frozen=True)
class PostFilter:
    excludes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Preference:
    regions: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    prefers: tuple[str, ...] = ()
    avoids: tuple[str, ...] = ()
    prioritize_languages: bool = False
    early_versions: bool = False
    early_revisions: bool = False
    early_prereleases: bool = False
    prefer_parents: bool = False
    prefer_prereleases: bool = False


@dataclass(frozen=True)
class FileOutput:
    output_dir: str = ""
    archive_type: str | None = None
    alphabetic: bool = False
    force_subfolder: bool = False


@dataclass(frozen=True)
class ScannerConfig:
    threads: int = 0
    buffer_size: int = 32 << 10
    max_buffer_size: int = 256 << 20
    custom_unrar_path: str | None = None
    custom_seven_zip_path: str | None = None
    force_unrar: bool = False
    force_seven_zip: bool = False


@dataclass(frozen=True)
class CopierConfig:
    threads: int = 0
    buffer_size: int = 32 << 10
    allow_raw_zip_copy: bool = False


@dataclass(frozen=True)
class AppConfig:
    scanner: ScannerConfig = field(default_factory=ScannerConfig)
    copier: CopierConfig = field(default_factory=CopierConfig)


class InvalidCatalog(ValueError):
    """A catalog or a set of options that cannot be worked on; the message is for the user."""


def allowed(flag: bool | None, no_all: bool) -> bool:
    """A tri-state option: with no_all only an explicit yes allows, else all but an explicit no."""
    return flag is True if no_all else flag is not False
