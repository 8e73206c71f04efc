"""Catalog documents as text, game by game."""

from __future__ import annotations

import json
import textwrap
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .. import __version__
from ..schema import DEFAULTS, GAME, HEADER
from .selection import ordered

# Output modes, the suffix of a rebuilt catalog's name, the catalog format's document type.
MODES = ("xml", "json", "yaml")
SUFFIX = " (1G1R)"
DOCTYPE = '<!DOCTYPE datafile PUBLIC "-//Logiqx//DTD ROM Management Datafile//EN" "http://www.logiqx.com/Dats/datafile.dtd">'
GENERATOR = f"Generated by shelfwise {__version__}"


def rebuilt_header(header: Row | None) -> dict | None:
    """The first catalog's header, with the suffix added to name and description."""
    head = header.asDict(True) if header is not None else None
    if head:
        head |= {k: f"{head[k]}{SUFFIX}" for k in ("name", "description") if head.get(k) is not None}
    return head


def rebuilt(best: DataFrame) -> DataFrame:
    """game: the selected entries in name order; parents are cleared."""
    return ordered(best).select(F.col("game").withField("_cloneof", F.lit(None).cast("string")).alias("game"))


def rebuild(best: DataFrame, header: Row | None) -> dict:
    """A catalog of the selected games, held whole; `sink.write_catalog` writes one of any size."""
    return {"header": rebuilt_header(header), "game": [r["game"].asDict(True) for r in rebuilt(best).collect()]}


def _clean(kind: str, value):
    """Without nulls, empty lists and values that mean their absence."""
    if isinstance(value, list):
        return [_clean(kind, v) for v in value if v is not None]
    if not isinstance(value, dict):
        return value
    out = {k: _clean(k.lstrip("_"), v) for k, v in value.items()}
    return {k: v for k, v in out.items() if v is not None and v != [] and DEFAULTS.get(kind, {}).get(k) != v}


def _element(tag: str, value) -> ET.Element:
    e = ET.Element(tag)
    if not isinstance(value, dict):
        e.text = str(value)
        return e
    for k, v in value.items():
        if k.startswith("_"):
            e.set(k[1:], str(v))
        else:
            for x in v if isinstance(v, list) else [v]:
                e.append(_element(k, x))
    return e


class CatalogText:
    """A catalog's text in parts: begin, one part for each game with `between` between two, and end (empty_end without games).
    Field order is the schema's."""

    def __init__(self, header: dict | None, mode: str = "xml", build: str | None = None, debug: str | None = None):
        if mode not in MODES:
            raise ValueError(f"unknown output mode {mode!r}")
        self.mode = mode
        top = {k: v for k, v in (("_build", build), ("_debug", debug)) if v is not None and DEFAULTS["datafile"].get(k) != v}
        if header:
            top["header"] = _put(HEADER, _clean("header", header))
        self.between, self.end, self.empty_end = {"xml": ("", "</datafile>\n", "</datafile>\n"), "json": (",", "\n  ]\n}\n", "]\n}\n"), "yaml": ("", "", " []\n")}[mode]
        if mode == "xml":
            root = ET.tostring(_element("datafile", {k: v for k, v in top.items() if k != "header"}), encoding="unicode").removesuffix(" />")
            self.begin = f'<?xml version="1.0" encoding="UTF-8"?>\n{DOCTYPE}\n<!-- {GENERATOR} -->\n{root}>\n' + (self._xml("header", top["header"]) if header else "")
        elif mode == "json":
            self.begin = "{\n" + "".join(f"  {json.dumps(k)}: {self._json(v, 1)},\n" for k, v in top.items()) + '  "game": ['
        else:
            self.begin = f"# {GENERATOR}\n" + (self._yaml(top) if top else "") + "game:"

    @staticmethod
    def _xml(tag: str, value: dict) -> str:
        e = _element(tag, value)
        ET.indent(e, "  ")
        return textwrap.indent(ET.tostring(e, encoding="unicode"), "  ", lambda line: True) + "\n"

    @staticmethod
    def _json(value, depth: int) -> str:
        return textwrap.indent(json.dumps(value, indent=2, ensure_ascii=False), "  " * depth).lstrip()

    @staticmethod
    def _yaml(value) -> str:
        import yaml

        return yaml.safe_dump(value, sort_keys=False, allow_unicode=True)

    def first(self) -> str:
        """What comes before the first game only."""
        return "\n" if self.mode == "yaml" else ""

    def game(self, game: dict) -> str:
        value = _put(GAME, _clean("game", game))
        if self.mode == "xml":
            return self._xml("game", value)
        return "\n    " + self._json(value, 2) if self.mode == "json" else self._yaml([value])


def _put(order, values: dict) -> dict:
    return {f.name: values[f.name] for f in order if f.name in values}


def catalog_text(header: dict | None, games: Iterable[dict], mode: str = "xml", build: str | None = None, debug: str | None = None) -> Iterator[str]:
    """The text of a catalog in parts, one for each game."""
    text, some = CatalogText(header, mode, build, debug), False
    yield text.begin
    for g in games:
        yield (text.between if some else text.first()) + text.game(g)
        some = True
    yield text.end if some else text.empty_end


def render(catalog: dict, mode: str = "xml") -> str:
    """The text of a catalog that is held whole."""
    return "".join(catalog_text(catalog.get("header"), catalog["game"], mode, catalog.get("_build"), catalog.get("_debug")))


def name_list(best: DataFrame) -> list[str]:
    """The selected names in name order, held whole; `sink.write_names` writes a list of any length."""
    return [r["name"] for r in ordered(best).select("name").collect()]
