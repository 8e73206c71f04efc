"""Catalog documents (XML, JSON, YAML) as DataFrames of games.

XML catalogs are read game by game: the end tag of a game is the record separator of Spark's text source, so a document of any
size is split over tasks, and each record is parsed and checked by itself. Where a game stands in its document follows from the
first byte of its split and from its place in it; the splits' counts, one row each, give the offsets. JSON and YAML documents are
cut into games by `structured`.

Nothing is passed over: a document that cannot be read to its end, a value of the wrong type, an unknown value of an attribute
with fixed values, a missing name, and in XML an unknown element or attribute raise InvalidCatalog with the place.
"""

from __future__ import annotations

import re
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import InvalidCatalog
from ..functions.tables import materialize, spread
from ..schema import CHOICES, GAME, HEADER, REQUIRED
from .structured import whole_pieces, yaml_pieces

BAD = "_unread"
END = "</game>"
_TEXT = T.StructField(BAD, T.StringType())
_ROOT = T.StructType([T.StructField("header", HEADER), T.StructField("_build", T.StringType()), T.StructField("_debug", T.StringType())])
#: A byte order mark, a declaration, comments' remains and a document type before the root.
PROLOG = r"(?s)^\s*\x{FEFF}?\s*(<\?.*?\?>\s*)*(<!DOCTYPE[^\[>]*(\[.*?\]\s*)?>\s*)?"
TAIL = r"</datafile\s*>\s*$"
#: Encodings that the text source reads as they are; of others a document is read whole.
PLAIN = ("utf-8", "us-ascii", "ascii")


# ---- checks of values, as columns

def _said(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _wrong(kind: str, value: Column) -> list[Column]:
    """What is wrong with one element's values: texts, null for nothing."""
    out = [F.when(value[f"_{f}"].isNull(), F.lit(f"{kind} without {f}")) for f in REQUIRED.get(kind, ())]
    for f, known in CHOICES.get(kind, {}).items():
        v = value[f"_{f}"]
        out.append(F.when(v.isNotNull() & ~F.lower(v).isin(*known), _said(f"{kind} with {f}='", v, f"', which is none of {', '.join(known)}")))
    if kind == "rom":
        out.append(F.when(value["_header"].isNotNull() & ~value["_header"].rlike(r"^\s*([0-9A-Fa-f]{2}\s*)*$"), _said("rom with header='", value["_header"], "', which are no bytes")))
    return out


def problem_of(game: Column) -> Column:
    """The first thing that is wrong with a game's values, or null."""
    parts = _wrong("game", game)
    for kind in (f.name for f in GAME if f.name in REQUIRED or f.name in CHOICES):
        found = F.transform(game[kind], lambda x: F.coalesce(*_wrong(kind, x)))  # noqa: B023 (called at once)
        parts.append(F.get(F.filter(found, lambda t: t.isNotNull()), F.lit(0)))
    return F.coalesce(*parts)


def _header_problem(root: Column) -> Column:
    return F.coalesce(*_wrong("datafile", root), *_wrong("clrmamepro", root["header"]["clrmamepro"]), *_wrong("romcenter", root["header"]["romcenter"]))


def _known(tag: str, kind: T.StructType) -> tuple[list[str], list[str], list[str]]:
    """element/attribute and element/element pairs that the format has below an element, and the elements that hold no text."""
    attributes, elements, bare = [f"{tag}/{f.name[1:]}" for f in kind if f.name[0] == "_"], [], [tag]
    for f in kind:
        of = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        if f.name[0] != "_":
            elements.append(f"{tag}/{f.name}")
            if isinstance(of, T.StructType):
                for mine, more in zip((attributes, elements, bare), _known(f.name, of)):
                    mine += more
    return attributes, elements, bare


def _strange(xml: Column, tag: str, kind: T.StructType) -> Column:
    """A text about the first part of an element's XML that the format does not have, or null. The XML must be well-formed."""
    attributes, elements, bare = _known(tag, kind)
    pair = "concat('|', name(..), '/', name(), '|')"
    union = " | ".join([
        f"/r//@*[not(contains('|{'|'.join(attributes)}|', {pair}))]", f"/r//*[not(contains('|r/{tag}|{'|'.join(elements)}|', {pair}))]",
        f"/r//text()[normalize-space()][contains('|r|{'|'.join(bare)}|', concat('|', name(..), '|'))]",
    ])
    whole = _said("<r>", xml, "</r>")
    first = lambda what: F.xpath_string(whole, F.lit(what.format(f"({union})[1]")))
    found = F.when(F.xpath_boolean(whole, F.lit(union)), F.concat_ws("/", first("name({}/..)"), first("name({})"), first("normalize-space({})")))
    return _said("unknown part ", found)


# ---- XML, game by game

@contextmanager
def _splits(spark: SparkSession, size: int | None):
    """Splits of at most that many bytes while the body runs."""
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    if size:
        spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def _glob_free(path: str) -> str:
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def _records(spark: SparkSession, path: str) -> DataFrame:
    """value, block: the pieces of a document between ends of games. A document in another encoding, or with a comment or CDATA that
    hides such an end, is read whole and cut in one task, so it must fit one."""
    name = _glob_free(path)
    rows = spark.read.option("lineSep", END).text(name).select(_no_comments(F.col("value")).alias("value"), F.col("_metadata.file_block_start").alias("block"))
    first = spark.read.text(name).select(F.substring("value", 1, 400).alias("v")).limit(1).collect()
    head = first[0]["v"] if first else ""
    named = re.search(r"""<\?xml[^>]*\sencoding\s*=\s*["']([\w.:-]+)["']""", head)
    encoding = "utf-16" if "\0" in head or "\ufffd" in head[:4] else named[1].lower() if named else "utf-8"
    open_ended = F.regexp_replace("value", r"(?s)<!\[CDATA\[.*?\]\]>", "").rlike(r"<!--|<!\[CDATA\[")
    if encoding in PLAIN and rows.where(open_ended).isEmpty():
        return rows
    whole = spark.read.format("binaryFile").load(name).select(_no_comments(F.decode("content", "utf-8" if encoding in PLAIN else encoding)).alias("text"))
    return whole.select(F.explode(F.split("text", END, -1)).alias("value"), F.lit(0).cast("long").alias("block"))


def _no_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)(<!\[CDATA\[.*?\]\]>)|<!--.*?-->", "$1")


def _parsed_xml(spark: SparkSession, path: str) -> DataFrame:
    """block, at, root, tail, head (header, _build, _debug), game, problem: the parts of a document. `at` keeps their order within a
    block; what begins or ends the root is a part of its own."""
    opened = F.regexp_replace("value", r"(?s)<datafile([^<>]*?)/>\s*$", "<datafile$1></datafile>")
    rows = _records(spark, path).withColumn("value", opened).withColumn("tail", F.col("value").rlike(TAIL))
    rows = rows.withColumn("parts", F.split(F.concat(F.lit("\n"), F.regexp_replace("value", TAIL, "")), r"(?=<game[\s/>])", -1))
    rows = rows.select("block", "tail", F.size("parts").alias("n"), F.posexplode("parts").alias("k", "part")).withColumn("at", F.monotonically_increasing_id())
    last, is_game = F.col("k") == F.col("n") - 1, F.col("k") > 0
    begun = F.regexp_replace("part", PROLOG, "")
    root = ~is_game & begun.startswith("<datafile")
    rows = rows.select(
        "block", "at", root.alias("root"), (F.col("tail") & last).alias("tail"), F.when(is_game, F.when(last & ~F.col("tail"), F.concat("part", F.lit(END))).otherwise(F.col("part"))).alias("xml"),
        F.when(root, F.concat(begun, F.lit("</datafile>"))).alias("xml_head"), F.when(~is_game & ~root & (F.trim(begun) != ""), F.regexp_replace("part", r"\s+", " ")).alias("stray"),
    ).where("root or tail or xml is not null or trim(stray) <> ''")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    read = lambda c, kind: F.from_xml(c, T.StructType([*kind.fields, _TEXT]), options)
    rows = rows.withColumns({"game": F.when(F.col("xml").isNotNull(), read("xml", GAME)), "head": F.when(F.col("xml_head").isNotNull(), read("xml_head", _ROOT))})
    cut = lambda c: _said("cannot be read: ", F.substring(F.regexp_replace(c, r"\s+", " "), 1, 300))

    def check(xml: str, got: str, tag: str, kind: T.StructType, values: Column) -> Column:
        read_well = F.col(xml).isNotNull() & F.col(got).isNotNull() & F.col(f"{got}.{BAD}").isNull()
        return F.when(F.col(xml).isNotNull() & ~F.coalesce(read_well, F.lit(False)), cut(F.col(xml))).when(read_well, F.coalesce(_strange(F.col(xml), tag, kind), values))

    trouble = F.coalesce(
        F.when(F.trim("stray") != "", _said("unknown part ", F.substring(F.trim("stray"), 1, 300))), check("xml", "game", "game", GAME, problem_of(F.col("game"))),
        check("xml_head", "head", "datafile", _ROOT, _header_problem(F.col("head"))),
    )
    bare = lambda c, kind: F.when(F.col(c).isNotNull(), F.struct(*(F.col(f"{c}.{f.name}").alias(f.name) for f in kind)))
    return rows.select("block", "at", "root", "tail", bare("head", _ROOT).alias("head"), bare("game", GAME).alias("game"), trouble.alias("problem"))


def _checked(parts: DataFrame, path: str) -> DataFrame:
    """parts, if they are a whole document without a problem; else InvalidCatalog."""
    place = F.struct("block", "at")
    r = parts.agg(
        F.min(place).alias("first"), F.max(place).alias("last"), F.count_if("root").alias("roots"), F.count_if("tail").alias("tails"), F.min(F.when(F.col("root"), place)).alias("root"), F.max(F.when(F.col("tail"), place)).alias("tail"),
        F.min(F.when(F.col("problem").isNotNull(), F.struct("block", "at", "problem", "game._name"))).alias("bad"),
    ).first()
    if r["roots"] == 0 or r["root"] != r["first"]:
        raise InvalidCatalog(f"{path} is no catalog: it does not begin with <datafile>")
    if r["bad"] is not None:
        n = parts.where("game is not null").where(place < F.struct(F.lit(r["bad"]["block"]).alias("block"), F.lit(r["bad"]["at"]).alias("at"))).count()
        name = f" ({r['bad']['_name']})" if r["bad"]["_name"] else ""
        raise InvalidCatalog(f"{path}, game {n + 1}{name}: {r['bad']['problem']}")
    if r["roots"] > 1 or r["tails"] != 1 or r["tail"] != r["last"]:
        n = parts.where("game is not null").count()
        raise InvalidCatalog(f"{path} is cut short or goes on after its end: {n} games, {r['tails']} ends of <datafile>")
    return parts


def _load_xml(spark: SparkSession, path: str, split_bytes: int | None) -> tuple[DataFrame, DataFrame]:
    with _splits(spark, split_bytes):
        parts = _checked(materialize(_parsed_xml(spark, path), "catalog"), path)
    return parts.where("root").select("head.*"), _placed(parts.where("game is not null"))


def _placed(games: DataFrame) -> DataFrame:
    """game_ord, game, split of games (block, at, game): a block's first byte and the games before it give their places."""
    blocks = games.groupBy("block").agg(F.count(F.lit(1)).alias("_n"))
    before = blocks.select("block", (F.sum("_n").over(Window.orderBy("block")) - F.col("_n")).alias("_before"))  # a row for each split
    within = F.row_number().over(Window.partitionBy("block").orderBy("at")) - 1
    games = games.withColumn("_within", within).join(F.broadcast(before), "block")
    return games.select((F.col("_before") + F.col("_within")).cast("long").alias("game_ord"), "game", F.col("block").alias("split"))


# ---- JSON and YAML

def _load_structured(spark: SparkSession, path: str, kind: str, split_bytes: int | None) -> tuple[DataFrame, DataFrame]:
    """The games' texts leave `structured` one by one and are parsed and checked in tasks, each by itself."""
    with _splits(spark, split_bytes):
        pieces = None if kind in ("json", "js") else yaml_pieces(spark, path)
    streamed = pieces is None
    pieces = spread(whole_pieces(spark, path, kind), "at") if streamed else pieces
    read = lambda of: F.from_json("text", T.StructType([*of.fields, _TEXT]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    is_game = F.col("kind") == F.lit("game")
    rows = pieces.withColumns({"game": F.when(is_game, read(GAME)), "head": F.when(F.col("kind") == "head", read(_ROOT))})
    cut = F.when(F.col("kind") == "error", F.col("text")).when(~F.coalesce(F.col("game").isNotNull() & F.col(f"game.{BAD}").isNull() | F.col("head").isNotNull() & F.col(f"head.{BAD}").isNull(), F.lit(False)),
                                                               _said("cannot be read: ", F.substring(F.regexp_replace("text", r"\s+", " "), 1, 300)))
    bare = lambda c, of: F.when(F.col(c).isNotNull(), F.struct(*(F.col(f"{c}.{f.name}").alias(f.name) for f in of)))
    wrong = F.coalesce(cut, F.when(is_game, problem_of(F.col("game"))).otherwise(_header_problem(F.col("head"))))
    parts = materialize(rows.select("kind", "block", "at", bare("head", _ROOT).alias("head"), bare("game", GAME).alias("game"), wrong.alias("problem")), "catalog")
    place = F.struct("block", "at")
    r = parts.agg(F.min(F.when(F.col("problem").isNotNull(), F.struct("block", "at", "problem", "kind", "game._name"))).alias("bad"), F.count_if(F.col("kind") == "head").alias("heads")).first()
    if r["bad"] is not None and r["bad"]["kind"] == "game":
        n = parts.where(is_game).where(place < F.struct(F.lit(r["bad"]["block"]).alias("block"), F.lit(r["bad"]["at"]).alias("at"))).count()
        raise InvalidCatalog(f"{path}, game {n + 1} ({r['bad']['_name']}): {r['bad']['problem']}")
    if r["bad"] is not None or r["heads"] != 1:
        raise InvalidCatalog(f"{path} cannot be read: " + (r["bad"]["problem"] if r["bad"] else f"{r['heads']} documents"))
    games = parts.where(is_game)
    games = games.select(F.col("at").alias("game_ord"), "game", F.col("block").alias("split")) if streamed else _placed(games)  # a stream's games are numbered as they come
    return parts.where("kind = 'head'").select("head.*"), games


# ---- all kinds

def load_catalogs(spark: SparkSession, paths: list[str], split_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, games) of catalogs by path; their kind is that of the name's end, XML without a known one.

    documents: dat_ord (place in paths), header, _build, _debug. games: as `games` has them, with `split`, the first byte of the part
    of the document that a game was read in. Each document is read once and written to the shared folder; XML in splits of
    split_bytes (by default Spark's). Raises InvalidCatalog for what cannot be read whole.
    """
    docs, rows = [], []
    for i, path in enumerate(paths):
        kind = path.lower().rsplit(".", 1)[-1]
        try:
            head, found = _load_structured(spark, path, kind, split_bytes) if kind in ("json", "js", "yaml", "yml") else _load_xml(spark, path, split_bytes)
        except InvalidCatalog:
            raise
        except (PySparkException, OSError, ValueError) as e:
            raise InvalidCatalog(f"{path} cannot be read: {str(e).splitlines()[0][:500]}") from e
        except Exception as e:  # the JVM's and YAML's own
            if type(e).__module__.split(".")[0] not in ("py4j", "yaml"):
                raise
            raise InvalidCatalog(f"{path} cannot be read: {' '.join(str(e).split())[:500]}") from e
        docs.append(head.withColumn("dat_ord", F.lit(i)))
        detector = head.select(F.col("header.clrmamepro._header").alias("d")).first()["d"]
        rows.append(found.withColumns({"dat_ord": F.lit(i), "detector": F.lit(detector).cast("string")}))
    return reduce(DataFrame.unionByName, docs), games(reduce(DataFrame.unionByName, rows))


def read_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per catalog: dat_ord (place in paths), header, _build, _debug."""
    return load_catalogs(spark, paths)[0]


def read_catalog(spark: SparkSession, paths: list[str], split_bytes: int | None = None) -> DataFrame:
    return load_catalogs(spark, paths, split_bytes)[1]


def _plain(items: str, fields: list[str]):
    """An array of structs with the fields' XML prefixes taken off, values of fixed sets in lower case; null arrays become empty."""
    kind = items.split(".")[-1]
    value = lambda x, f: F.lower(x[f"_{f}"]) if f in CHOICES.get(kind, {}) else x[f"_{f}"]
    made = F.transform(items, lambda x: F.struct(*(value(x, f).alias(f) for f in fields)))
    return F.coalesce(made, F.filter(made, lambda x: F.lit(False)), F.array().cast("array<struct<" + ",".join(f"{f}:{'bigint' if f == 'size' else 'string'}" for f in fields) + ">>"))


def games(rows: DataFrame) -> DataFrame:
    """One row per game in document order: dat_ord, game_ord, name, isbios, cloneof, romof, release, rom, disk, detector (the
    catalog's header detector), game, the whole entry, and split."""
    return rows.select(
        "dat_ord", "game_ord", F.col("game._name").alias("name"), F.coalesce(F.lower("game._isbios"), F.lit("no")).alias("isbios"), F.col("game._cloneof").alias("cloneof"), F.col("game._romof").alias("romof"),
        _plain("game.release", ["name", "region", "language"]).alias("release"), _plain("game.rom", ["name", "size", "crc", "md5", "sha1", "sha256", "status"]).alias("rom"),
        _plain("game.disk", ["name", "status"]).alias("disk"), "detector", "game", "split",
    )
