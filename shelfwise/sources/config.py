"""Small configuration documents, read on the driver: JSON or YAML, region tables, pattern files, application settings."""

from __future__ import annotations

import json
import logging
from pathlib import Path
from urllib.parse import urlparse
from urllib.request import urlopen

from ..config import AppConfig, CopierConfig, ScannerConfig
from ..functions.regions import DEFAULT, Region
from ..operators.filters import patterns_of

log = logging.getLogger(__name__)


def read_small(path: str | Path) -> bytes:
    """The bytes of a small document by path or URL."""
    if "://" not in str(path):
        return Path(path).read_bytes()
    with urlopen(str(path), timeout=60) as f:
        return f.read()


def load_structured(path: str | Path):
    """By extension (.json, .js, .yaml, .yml, any case); other documents as JSON, then as YAML. Paths and URLs."""
    text, kind = read_small(path).decode("utf-8-sig"), Path(urlparse(str(path)).path if "://" in str(path) else path).suffix.lower()
    if kind in (".yaml", ".yml"):
        return _yaml(text)
    try:
        return json.loads(text)
    except ValueError:
        if kind in (".json", ".js"):
            raise
        return _yaml(text)


def _yaml(text: str):
    import yaml

    return yaml.safe_load(text)


def load_regions(path: str | Path | None = None) -> tuple[Region, ...]:
    """The region table of a file; the default one without a file, and with a warning where the file cannot be read."""
    if path is None:
        return DEFAULT
    try:
        rows = load_structured(path)["regions"]
        return tuple(Region(r["code"], r.get("pattern") or "a^", tuple(r.get("languages") or ())) for r in rows)
    except Exception as e:  # a broken override must not stop a run
        log.warning("region table %s cannot be read (%s); the default one is used", path, e)
        return DEFAULT


def load_patterns(path: str | Path) -> tuple[str, ...]:
    data = load_structured(path) or {}
    return patterns_of(data.get("strings") or [], data.get("patterns") or [])


def load_app_config(path: str | Path | None = None) -> AppConfig:
    if path is None or "://" not in str(path) and not Path(path).exists():
        return AppConfig()
    data = load_structured(path) or {}
    s, c, own = data.get("scanner") or {}, data.get("copier") or {}, AppConfig()
    return AppConfig(
        ScannerConfig(int(s.get("threads", 0)), int(s.get("defaultBufferSize", own.scanner.buffer_size)), int(s.get("maxBufferSize", own.scanner.max_buffer_size)),
                      s.get("customUnrarPath"), s.get("customSevenZipPath"), bool(s.get("forceUnrar")), bool(s.get("forceSevenZip"))),
        CopierConfig(int(c.get("threads", 0)), int(c.get("bufferSize", own.copier.buffer_size)), bool(c.get("allowRawZipCopy"))),
    )
