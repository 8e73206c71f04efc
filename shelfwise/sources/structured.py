"""JSON and YAML catalogs cut into the texts of their games, so that neither driver nor a task holds a document.

A YAML document whose list of games is in block style, as catalogs are written, is cut by Spark's text source at the list's
dashes, in any number of splits; every piece is parsed by itself. Inside a piece a dash at the list's own depth stands only in a
quoted text over several lines; then a piece cannot be parsed and the document is read as others are: one task goes through it as a
stream and sends the games on one by one, holding the largest only. JSON, which has no such mark, always is.
"""

from __future__ import annotations

import codecs
import io
import json
import re
from collections.abc import Iterator
from urllib.request import urlopen

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import materialize
from .storage import PIECE, open_input

#: kind: game, head (the document without its games) or error; the text is JSON or says what is wrong.
PIECES = "kind string, block long, at long, text string"
LIST = "game"
_SPACE = re.compile(r"[ \t\n\r]*")
#: The key of the list of games, and the depth of its first dash.
_BLOCK = re.compile(r"(?:^|\n)game:[ \t]*(?:#[^\n]*)?\r?\n(?:[ \t]*(?:#[^\n]*)?\r?\n)*( *)- ")
HEAD = 1 << 16
_BEGUN = re.compile(r"(?:^|\n)\ufeff?game:[ \t]*(?:#[^\n]*)?\r?(?:\n[ \t]*(?:#[^\n]*)?\r?)*$")
#: Where a key of the root begins after the list; a document's marks.
_KEY = re.compile(r"\n(?=[^\s#-])")
_MARK = re.compile(r"(?m)^(---|\.\.\.)(\s|$)")
WEB = ("http://", "https://")


def whole_pieces(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """PIECES of a document, by one task and in bounded memory. Where Arrow does not open the path, its content comes from Spark."""
    cut, opened = json_pieces if kind in ("json", "js") else yaml_events, _opens(path)
    name = _glob_free(path)
    rows = spark.range(0, 1, 1, 1).select(F.lit(b"").alias("content")) if opened else spark.read.format("binaryFile").load(name).select("content")

    def run(frames):
        for pdf in frames:
            for content in pdf["content"]:
                with _open(path) if opened else io.BytesIO(content) as f:
                    yield from _frames(_told(cut(f)))

    return rows.mapInPandas(run, PIECES)


def _glob_free(path: str) -> str:
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def _open(path: str):
    return urlopen(path, timeout=60) if path.startswith(WEB) else open_input(path)


def _opens(path: str) -> bool:
    try:
        _open(path).close()
        return True
    except FileNotFoundError:
        raise
    except Exception:  # a file system that only Spark has
        return False


def _told(pieces: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """pieces; a fault becomes a piece at its place."""
    try:
        yield from pieces
    except Exception as e:
        yield "error", " ".join(str(e).split())[:500] or type(e).__name__


def _frames(pieces: Iterator[tuple[str, str]]) -> Iterator[pd.DataFrame]:
    rows, size = [], 0
    for at, (kind, text) in enumerate(pieces):
        rows.append((kind, 0, at, text))
        size += len(text)
        if size > PIECE >> 2 or len(rows) == 10_000:
            yield pd.DataFrame(rows, columns=["kind", "block", "at", "text"])
            rows, size = [], 0
    yield pd.DataFrame(rows, columns=["kind", "block", "at", "text"])


# ---- JSON

class _Text:
    """A stream's text with a place in it; what lies before the place is let go."""

    def __init__(self, stream):
        first = stream.read(4)
        name = json.detect_encoding(first)
        self.stream, self.decode = stream, codecs.getincrementaldecoder(name)("strict").decode
        self.text, self.at, self.ended = self.decode(first).removeprefix("\ufeff"), 0, False

    def more(self) -> bool:
        if self.ended:
            return False
        # as much again as is held: a value over many pieces is not gone through once for each
        part = self.stream.read(max(PIECE, len(self.text) - self.at))
        self.ended = not part
        self.text, self.at = self.text[self.at :] + self.decode(part, self.ended), 0
        return True

    def peek(self) -> str:
        """The next character that is no white space; "" at the end."""
        while True:
            self.at = _SPACE.match(self.text, self.at).end()
            if self.at < len(self.text):
                return self.text[self.at]
            if not self.more():
                return ""

    def take(self, *wanted: str) -> str:
        c = self.peek()
        if c not in wanted:
            raise ValueError(f"{c or 'the end'!r} where {' or '.join(wanted)} is due, before {self.text[self.at + 1 : self.at + 80]!r}")
        self.at += 1
        return c

    def value(self) -> tuple[object, str]:
        """The next value and its text."""
        self.peek()
        while True:
            try:
                got, end = _DECODER.raw_decode(self.text, self.at)
                if end < len(self.text) or self.ended:  # a number may go on
                    break
            except json.JSONDecodeError as e:  # for want of more, or at once
                if self.ended or e.pos < len(self.text) - 16 and not e.msg.startswith("Unterminated"):
                    raise
            self.more()
        text, self.at = self.text[self.at : end], end
        return got, text


def _constant(name: str):
    raise ValueError(f"{name} is no JSON")


_DECODER = json.JSONDecoder(parse_constant=_constant)


def json_pieces(stream) -> Iterator[tuple[str, str]]:
    text, head, lists = _Text(stream), [], 0
    text.take("{")
    if text.peek() == "}":
        text.take("}")
    else:
        end = ","
        while end == ",":
            text.peek()
            key, shown = text.value()
            if not isinstance(key, str):
                raise ValueError(f"{shown[:80]} where a name is due")
            text.take(":")
            if key != LIST:
                head.append(f"{shown}:{text.value()[1]}")
            elif text.peek() == "[":
                lists += 1
                if lists > 1:
                    raise ValueError("two lists of games")
                text.take("[")
                if text.peek() == "]":
                    text.take("]")
                else:
                    while True:
                        yield "game", text.value()[1]
                        if text.take(",", "]") == "]":
                            break
            elif text.value()[0] is not None:
                raise ValueError("game is no list")
            end = text.take(",", "}")
    if text.peek():
        raise ValueError(f"the document goes on after its end: {text.text[text.at : text.at + 80]!r}")
    yield "head", "{" + ",".join(head) + "}"


# ---- YAML

def _loader(slow: bool = False):
    import yaml

    return yaml.SafeLoader if slow else getattr(yaml, "CSafeLoader", yaml.SafeLoader)


def _parsed(text: str):
    """As `yaml.safe_load`; texts that libyaml does not take are tried without it."""
    import yaml

    try:
        return yaml.load(text, _loader())
    except yaml.YAMLError:
        return yaml.load(text, _loader(slow=True))


def yaml_events(stream) -> Iterator[tuple[str, str]]:
    """A document of any form, node by node."""
    import yaml

    text = codecs.getreader("utf-8-sig")(stream)
    loader, head, lists = yaml.SafeLoader(text), {}, 0
    try:
        loader.get_event()  # the stream's start
        loader.get_event()
        if not loader.check_event(yaml.MappingStartEvent):
            raise ValueError("no catalog: it is no mapping")
        loader.get_event()
        while not loader.check_event(yaml.MappingEndEvent):
            key = loader.construct_document(loader.compose_node(None, None))
            if key == LIST and loader.check_event(yaml.SequenceStartEvent):
                lists += 1
                if lists > 1:
                    raise ValueError("two lists of games")
                loader.get_event()
                while not loader.check_event(yaml.SequenceEndEvent):
                    yield "game", json.dumps(loader.construct_document(loader.compose_node(None, None)))
                loader.get_event()
                continue
            head[key] = loader.construct_document(loader.compose_node(None, None))
            if key == LIST and head.pop(key) is not None:
                raise ValueError("game is no list")
        loader.get_event()
        loader.get_event()
        if not loader.check_event(yaml.StreamEndEvent):
            raise ValueError("several documents")
    finally:
        loader.dispose()
    yield "head", json.dumps(head)


def yaml_pieces(spark: SparkSession, path: str) -> DataFrame | None:
    """PIECES of a document with its list in block style, from any number of splits; None for one of another form."""
    name = _glob_free(path)
    head = _beginning(spark, path, name)
    begun = _BLOCK.search(head)
    if path.startswith(WEB) or not begun or re.search(r"(?m)\0|^%|(?<!\A)^(---|\.\.\.)", head[: begun.end()]):
        return None
    sep = f"\n{begun[1]}- "
    rows = spark.read.option("lineSep", sep).text(name).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))

    def run(frames):
        for pdf in frames:
            out = [(kind, b, at, text) for b, at, v in zip(pdf["block"], pdf["at"], pdf["value"]) for kind, text in _of_piece(v, sep)]
            yield pd.DataFrame(out, columns=["kind", "block", "at", "text"])

    made = materialize(rows.mapInPandas(run, PIECES), "pieces")
    others = made.where("kind in ('begin', 'tail', 'odd')").orderBy("block", "at").limit(3).collect()
    ends = made.agg(F.min(F.struct("block", "at")).alias("first"), F.max(F.struct("block", "at")).alias("last")).first()
    place = lambda r: (r["block"], r["at"])
    if [r["kind"] for r in others] not in (["begin"], ["begin", "tail"]) or place(others[0]) != ends["first"] or len(others) == 2 and place(others[1]) != ends["last"]:
        return None
    rest = _parsed("\n".join(r["text"].removeprefix("\ufeff") for r in others))
    if not isinstance(rest, dict) or rest.pop(LIST, "") is not None:
        return None
    return made.where("kind in ('game', 'error')").unionByName(spark.createDataFrame([("head", -1, -1, json.dumps(rest))], PIECES))


def _beginning(spark: SparkSession, path: str, name: str) -> str:
    if _opens(path):
        with _open(path) as f:
            return f.read(HEAD).decode("utf-8", "replace").removeprefix("\ufeff")
    return "\n".join(r["value"] for r in spark.read.text(name).limit(1000).collect()).removeprefix("\ufeff")


def _of_piece(value: str, sep: str) -> Iterator[tuple[str, str | None]]:
    """The kinds and texts of what stands between two dashes: what comes before the list, a game, a game and what comes after the
    list, or something odd."""
    import yaml

    if _BEGUN.search(value):
        yield "begin", value
        return
    tail, lead = [], sep[1:]
    try:
        try:
            got = _parsed(lead + value)
        except yaml.YAMLError:
            game, *tail = _KEY.split(value, maxsplit=1)
            got = _parsed(lead + game)
    except (yaml.YAMLError, ValueError):
        got = None
    if not isinstance(got, list) or len(got) != 1 or _MARK.search(value):
        yield "odd", None
        return
    try:
        yield "game", json.dumps(got[0])
    except (TypeError, ValueError) as e:
        yield "error", str(e)
    for text in tail:
        yield "tail", text
