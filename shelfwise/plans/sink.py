"""Ordered text files as a data source of Spark: catalogs and name lists, one file each, written by all tasks.

    games_in_order.write.format("shelfwise_catalog").option("kind", "xml").mode("overwrite").save(path)

Every task renders the games of its partition into a part beside the target; no game passes the driver. The commit joins the
parts that belong to successful tasks, in the order of their partitions, between the text's beginning and its end, as bytes in
pieces. So a sorted DataFrame becomes a sorted file. Parts of tasks that failed or ran twice are left out and removed.
"""

from __future__ import annotations

import json
import shutil
import uuid
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..sources.storage import PIECE, local, open_input, remove_tree, write_file
from ..workers import ship
from .render import CatalogText

NAMES = "names"


class NameText:
    """A list of names, one a line."""

    begin = end = empty_end = between = ""

    def first(self) -> str:
        return ""

    def game(self, name: str) -> str:
        return f"{name}\n"


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str
    rows: int


class TextWriter(DataSourceWriter):
    def __init__(self, path: str, text):
        self.path, self.text, self.parts = path, text, f"{path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator) -> Part:
        partition = TaskContext.get().partitionId()
        part, n = f"{self.parts}/{partition}-{uuid.uuid4().hex}", 0

        def fill(out) -> None:
            nonlocal n
            for row in iterator:
                value = row[0]
                text = self.text.game(value.asDict(True) if isinstance(value, Row) else value)
                out.write(((self.text.between if n else "") + text).encode())
                n += 1

        write_file(part, fill)
        return Part(partition, part, n)

    def commit(self, messages) -> None:
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition)

        def join(out) -> None:
            out.write(self.text.begin.encode())
            for k, m in enumerate(parts):
                out.write((self.text.between if k else self.text.first()).encode())
                with open_input(m.path) as part:
                    shutil.copyfileobj(part, out, PIECE)
            out.write((self.text.end if parts else self.text.empty_end).encode())

        try:
            write_file(self.path, join)
        finally:
            remove_tree(self.parts)

    def abort(self, messages) -> None:
        remove_tree(self.parts)


class CatalogSink(DataSource):
    """Options: path, kind (xml, json, yaml or names), header (JSON), build, debug. The first column is written: the whole game, or
    for names a string."""

    @classmethod
    def name(cls) -> str:
        return "shelfwise_catalog"

    def schema(self) -> str:
        return "game string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        o = self.options
        text = NameText() if o["kind"] == NAMES else CatalogText(json.loads(o.get("header", "null")), o["kind"], o.get("build"), o.get("debug"))
        return TextWriter(o["path"], text)


_registered: set[str] = set()


def _write(rows: DataFrame, path: str, **options: str) -> None:
    spark = rows.sparkSession
    if spark.sparkContext.applicationId not in _registered:
        ship(spark)
        spark.dataSource.register(CatalogSink)
        _registered.add(spark.sparkContext.applicationId)
    rows.write.format(CatalogSink.name()).options(**options).mode("overwrite").save(path)


def write_catalog(games: DataFrame, path: str, kind: str = "xml", header: dict | None = None, build: str | None = None, debug: str | None = None) -> None:
    """Write a catalog of games (column game, a whole entry) in the order of the rows. The file appears whole or not at all; an
    older one is replaced; no games give a catalog without games."""
    given = {"header": json.dumps(header), "build": build, "debug": debug}
    _write(games.select("game"), path, kind=kind, **{k: v for k, v in given.items() if v is not None})


def write_names(names: DataFrame, path: str) -> None:
    """Write the names (column name) in the order of the rows, one a line. Null names are empty lines."""
    _write(names.select(F.coalesce("name", F.lit("")).alias("name")), path, kind=NAMES)


def show_file(path: str, show) -> None:
    """Hand a file's text on, in pieces."""
    import codecs

    decode = codecs.getincrementaldecoder("utf-8")().decode
    with open_input(path) as f:
        while part := f.read(PIECE if local(path) is None else 1 << 16):
            show(decode(part), end="")


def text_rows(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1), value: a text file's lines with their numbers, from any number of splits."""
    from ..functions.tables import running_sum

    rows = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    return running_sum(rows.orderBy("_block", "_at"), F.lit(1), "line").select((F.col("line") + 1).cast("long").alias("line"), "value")
