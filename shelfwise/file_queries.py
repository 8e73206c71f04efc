"""Queries that read and write real files: catalogs as text, collections of loose files and archives, plans that are run.

The files are made from the driver's tables, whole, in the shared folder; what comes out of them is held against SQL over the
tables themselves.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli
from . import queries as Q
from .config import FileOutput
from .functions import files as FF
from .functions import names as N
from .functions import system as S
from .functions.tables import materialize, scratch, spread
from .operators import derive as D
from .operators import filters as W
from .operators import matching as M
from .operators import ranking as R
from .operators.header_columns import scan_contents, with_content
from .operators.headers import DataTest, Detector, FileTest, Rule
from .plans import views
from .plans.execute import run_plan
from .plans.files import plan_files
from .plans.render import rebuilt, rebuilt_header
from .plans.selection import numbered, ordered, select_best
from .plans.sink import text_rows, write_catalog, write_names
from .schema import GAME, ROM
from .sources.archives import Entry, write_entries
from .sources.catalog import load_catalogs
from .sources.config import load_patterns, load_regions
from .sources.files import list_files, scan, scan_order, schedule
from .sources.storage import local, write_file
from .streaming.completeness import complete_as_seen
from .streaming.files import scan_stream

# Archive types that the standard library reads and writes; a document's place in a group of games decides which one it is in.
KINDS = ("zip", "tar", "tar.bz2", "tar.gz", "tar.lzma", "tar.xz")
#: Documents in one archive.
PACK = 60
GAME_FILES = 3


def _contents(s: SparkSession, d: str) -> DataFrame:
    """doc_id, content: each document's id, a line end and its text, so that no two files are equal."""
    rows = s.read.parquet(f"{d}/documents.parquet")
    return rows.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("\n"), F.coalesce("text", F.lit(""))).cast("binary").alias("content"))


CONTENT_SQL = "(doc_id::VARCHAR || chr(10) || coalesce(text, ''))"


def write_loose(rows: DataFrame, folder: str) -> int:
    """Write every row (name, content) as a file below folder; the number of files."""

    def run(frames):
        for pdf in frames:
            for name, content in zip(pdf["name"], pdf["content"]):
                write_file(f"{folder}/{name}", lambda out, c=content: out.write(c))
            yield pd.DataFrame({"n": [len(pdf)]})

    return rows.select("name", "content").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def write_archives(rows: DataFrame, folder: str) -> int:
    """Write one archive for every value of `archive` in rows (archive, kind, name, content); the number of archives."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("name")
        items = [Entry(n, c, 1.6e9) for n, c in zip(pdf["name"], pdf["content"])]
        write_file(f"{folder}/{pdf['archive'].iloc[0]}", lambda out: write_entries(pdf["kind"].iloc[0], items, out))
        return pd.DataFrame({"n": [1]})

    return spread(rows.select("archive", "kind", "name", "content"), "archive").groupBy("archive").applyInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def _file_id(col: str):
    """The document's id in a file or entry name `.../d<id>.bin`."""
    return F.regexp_extract(col, r"d(-?\d+)\.bin$", 1).cast("long")


def _named() -> F.Column:
    return F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".bin"))


def _packed(rows: DataFrame) -> DataFrame:
    """archive, kind, name, content: games of GAME_FILES documents stay together, PACK documents to an archive."""
    game = F.floor(F.col("doc_id") / GAME_FILES)
    pack = F.floor(game / (PACK // GAME_FILES))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.pmod(pack, F.lit(len(KINDS))).cast("int") + 1)
    return rows.select(F.concat(F.lit("p"), pack.cast("string"), F.lit("."), kind).alias("archive"), kind.alias("kind"), F.concat(F.lit("sub\\"), _named()).alias("name"), "content")


_KIND_SQL = f"([{', '.join(repr(k) for k in KINDS)}])[CAST(doc_id // {GAME_FILES} // {PACK // GAME_FILES} % {len(KINDS)} AS INT) + 1]"


def _digest_columns() -> list:
    return ["size", "unheadered_size", "md5", "sha1", "sha256", "status"]


def _scan_loose(s: SparkSession, d: str) -> DataFrame:
    to = scratch(s, "loose")
    write_loose(_contents(s, d).select(F.concat(F.pmod("doc_id", F.lit(7)).cast("string"), F.lit("/"), _named()).alias("name"), "content"), to)
    return scan(list_files(s, [to])).select(_file_id("path").alias("doc_id"), *_digest_columns())


def _scan_archives(s: SparkSession, d: str) -> DataFrame:
    to = scratch(s, "packed")
    write_archives(_packed(_contents(s, d)), to)
    return scan(list_files(s, [to])).select(_file_id("archive_path").alias("doc_id"), "archive_type", *_digest_columns())


def _scan_order(s: SparkSession, d: str) -> DataFrame:
    """Each document as a scanned file, with how many come before it in the order of scans."""
    rows = s.read.parquet(f"{d}/documents.parquet")
    made = rows.select(F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), F.lit(None).cast("string").alias("archive_type"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.lit(None).cast("string").alias("archive_path"), "doc_id")
    return numbered(scan_order(made), "before").select("doc_id", "size", "before")


#: Detectors of three kinds of rules.
HEADERS = [
    Detector("skip", (Rule(0x10, tests=(DataTest(0, b"The"),)),)),
    Detector("words", (Rule(0, operation="wordswap", tests=(FileTest(0x200, "greater"), DataTest(-1, b".", False), DataTest(0, b"A", kind="and", mask=b"\xdf"))),)),
    Detector("pairs", (Rule(2, -2, "byteswap", (FileTest(0x40, "less", False), DataTest(0, b"\x00", kind="xor", mask=b"i"))),)),
]


def _as_content(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("text").cast("binary").alias("content"))


def _header_strip(s: SparkSession, d: str) -> DataFrame:
    """The content of every document's bytes by HEADERS: how long it is, its digest, and whether a rule failed."""
    rows = with_content(_as_content(s, d), HEADERS)
    return rows.select("doc_id", F.length("content").cast("long").alias("unheadered_size"), F.md5(F.hex("content")).alias("md5_of_hex"), F.col("header.message").isNotNull().alias("failed"))


_HEADER_SQL = r"""WITH a AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents), b AS (SELECT *, length(h) // 2 AS n FROM a),
c AS (SELECT *, substr(h, 1, 6) = '546865' AS skip, n > 512 AND right(h, 2) <> '2E' AND substr(h, 1, 2) IN ('41', '61') AS words, n >= 64 AND substr(h, 1, 2) = '69' AS pairs FROM b),
w AS (SELECT *, CASE WHEN skip THEN substr(h, 33) WHEN words AND n % 4 = 0 THEN regexp_replace(h, '(..)(..)(..)(..)', '\4\3\2\1', 'g')
  WHEN pairs AND n % 2 = 0 THEN regexp_replace(substr(h, 5, length(h) - 8), '(..)(..)', '\2\1', 'g') ELSE h END AS x FROM c)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS unheadered_size, md5(x) AS md5_of_hex, NOT skip AND (words AND n % 4 <> 0 OR pairs AND n % 2 <> 0) AS failed FROM w"""


#: Detectors that use every kind of test and operation, offsets from both ends, wanted results of both kinds, and rules that fail.
PROGRAMS = [
    Detector("sizes", (Rule(operation="bitswap", tests=(FileTest(None),)), Rule(1, -1, tests=(FileTest(0x200, "less"), FileTest(0x180, "less", False))), Rule(5, tests=(FileTest(0x14D, "equal"),)))),
    Detector("unequal", (Rule(tests=(FileTest(0x600, "greater"), DataTest(0, b"ab", kind="or", mask=b"a"))),)),
    Detector("backwards", (Rule(0x20, 0x10, tests=(DataTest(-1, b"."), DataTest(0, b"\x40", kind="and", mask=b"\x63"))),)),
    Detector("cased", (Rule(-0x40, operation="byteswap", tests=(DataTest(0, b"t", kind="or", mask=b" "),)), Rule(3, operation="wordswap", tests=(DataTest(0, b"\x08", kind="xor", mask=b"A"),)))),
    Detector("words", (Rule(0, -4, "wordbyteswap", (DataTest(1, b"n", False), FileTest(None, result=False), DataTest(-2, b"\x20", False, "and", b"\xe0"))),)),
]


def _header_programs(s: SparkSession, d: str) -> DataFrame:
    """What PROGRAMS find in every document's bytes: the detector and rule (-1 without one), the content's length and digest, and the last failure before."""
    rows = with_content(_as_content(s, d), PROGRAMS)
    return rows.select("doc_id", F.col("header.detector").alias("detector"), F.coalesce("header.rule", F.lit(-1)).alias("rule"), F.length("content").cast("long").alias("unheadered_size"), F.md5(F.hex("content")).alias("md5_of_hex"), F.col("header.message").alias("message"))


_SWAPPED_NIBBLES = "translate(regexp_replace({}, '(.)(.)', '\\2\\1', 'g'), '0123456789ABCDEF', '084C2A6E195D3B7F')"
_PROGRAMS_SQL = rf"""WITH a AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents), b AS (SELECT *, length(h) // 2 AS n FROM a),
c AS (SELECT *, CASE WHEN n > 0 THEN CAST('0x' || substr(h, 1, 2) AS INT) END AS f, right(h, 2) AS z, CASE WHEN n > 1 THEN CAST('0x' || left(right(h, 4), 2) AS INT) END AS y, n > 0 AND n & (n - 1) = 0 AS po2 FROM b),
d AS (SELECT *, po2 AS s0, NOT po2 AND n < 512 AND n >= 384 AS s1, NOT po2 AND n = 333 AS s2, n > 1536 AS uneven, n > 0 AND z = '2E' AND f & 99 = 64 AS back, f | 32 = 116 AS t, f = 73 AS i FROM c),
e AS (SELECT *, s0 OR s1 OR s2 AS sized, n > 1 AND substr(h, 3, 2) <> '6E' AND NOT po2 AND y & 224 <> 32 AS w FROM d),
g AS (SELECT *, least(n, 64) AS m, greatest(n - 3, 0) AS r, greatest(n - 4, 0) AS k FROM e),
p AS (SELECT *, CASE WHEN s0 THEN 0 WHEN s1 THEN 1 WHEN s2 THEN 2 WHEN back AND n <= 16 THEN 3 WHEN t AND m % 2 = 0 THEN 4 WHEN NOT coalesce(t, false) AND i AND r % 4 = 0 THEN 5 WHEN w AND k % 4 = 0 THEN 6 END AS way FROM g),
x AS (SELECT *, CASE way WHEN 0 THEN {_SWAPPED_NIBBLES.format("h")} WHEN 1 THEN substr(h, 3, length(h) - 4) WHEN 2 THEN substr(h, 11) WHEN 3 THEN ''
  WHEN 4 THEN regexp_replace(right(h, 2 * m), '(..)(..)', '\2\1', 'g') WHEN 5 THEN regexp_replace(substr(h, 7), '(..)(..)(..)(..)', '\4\3\2\1', 'g') WHEN 6 THEN regexp_replace(left(h, 2 * k), '(..)(..)(..)(..)', '\3\4\1\2', 'g') ELSE h END AS x FROM p)
SELECT doc_id, (['sizes', 'sizes', 'sizes', 'backwards', 'cased', 'cased', 'words'])[way + 1] AS detector, coalesce(([0, 1, 2, 0, 0, 1, 0])[way + 1], -1) AS rule, CAST(length(x) // 2 AS BIGINT) AS unheadered_size, md5(x) AS md5_of_hex,
  CASE WHEN sized THEN NULL WHEN way IS NULL AND w THEN 'words: ' || k || ' bytes are no multiple of 4'
  WHEN coalesce(way, 9) > 3 AND t AND m % 2 <> 0 THEN 'cased: ' || m || ' bytes are no multiple of 2' WHEN coalesce(way, 9) > 3 AND NOT coalesce(t, false) AND i AND r % 4 <> 0 THEN 'cased: ' || r || ' bytes are no multiple of 4'
  WHEN back AND n > 16 THEN 'backwards: the slice ends before it starts' WHEN uneven THEN 'unequal: mask and value differ in length' END AS message FROM x"""


def _scan_contents(s: SparkSession, d: str) -> DataFrame:
    """Documents as loose files, half of them with a header, read by Spark's own source and scanned by column expressions only."""
    to, head = scratch(s, "contents"), F.lit(b"HEAD" + bytes(508))
    write_loose(_contents(s, d).select(_named().alias("name"), F.when(F.col("doc_id") % 2 == 0, F.concat(head, "content")).otherwise(F.col("content")).alias("content")), to)
    read = s.read.format("binaryFile").option("recursiveFileLookup", True).load(to).select("path", "content")
    empty = list_files(s, [to]).where("length = 0").select("path", F.lit(None).cast("binary").alias("content"))  # Spark's source passes over them
    return scan_contents(read.unionByName(empty), [Q.HEADERED]).select(_file_id("path").alias("doc_id"), *_digest_columns())


def _scan_headered(s: SparkSession, d: str) -> DataFrame:
    """Files with a header that a detector knows and files without, half of them in archives; digests are of the content."""
    to, head = scratch(s, "headered"), F.lit(b"HEAD" + bytes(508))
    rows = _contents(s, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(head, "content")).otherwise(F.col("content")).alias("content"))
    write_loose(rows.where("doc_id % 4 < 2").select(_named().alias("name"), "content"), to)
    write_archives(_packed(rows.where("doc_id % 4 >= 2")), to)
    got = scan(list_files(s, [to]), detectors=[Q.HEADERED], large=4096)
    return got.select(_file_id(F.coalesce("archive_path", "path")).alias("doc_id"), F.col("archive_type").isNotNull().alias("packed"), *_digest_columns())


def _collection(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(games of GAME_FILES documents each, the scan of their files): every other group of games is loose, the others packed."""
    rows, to = _contents(s, d), scratch(s, "collection")
    loose = F.floor(F.floor(F.col("doc_id") / GAME_FILES) / (PACK // GAME_FILES)) % 2 == 0
    write_loose(rows.where(loose).select(F.concat(F.lit("l/"), _named()).alias("name"), "content"), to)
    write_archives(_packed(rows.where(~loose)), to)
    rom = F.struct(_named().alias("name"), F.length("content").cast("long").alias("size"), F.lit(None).cast("string").alias("crc"), F.lit(None).cast("string").alias("md5"), F.upper(F.sha1("content")).alias("sha1"), F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("string").alias("status"))
    game = F.floor(F.col("doc_id") / GAME_FILES)
    games = rows.groupBy(game.alias("game_ord")).agg(F.sort_array(F.collect_list(rom)).alias("rom")).select(F.lit(0).alias("dat_ord"), "game_ord", F.concat(F.lit("Game "), F.col("game_ord").cast("string")).alias("name"), "rom")
    return materialize(games, "games"), materialize(scan(list_files(s, [to])), "scan")


def _run(s: SparkSession, d: str, archive: str | None, raw: bool = False) -> DataFrame:
    """Plan and run the whole collection; then what the output folder holds, with the spec's status of each file."""
    games, scanned = _collection(s, d)
    to = scratch(s, "out")
    chosen = materialize(M.choose(M.rom_rows(games), scanned, archive is not None), "chosen")
    done = materialize(run_plan(plan_files(games, chosen, FileOutput(to, archive, alphabetic=True)), raw), "done")
    bad = done.where("status <> 'OK'").count()
    got = scan(list_files(s, [to])).select("path", "archive_path", "archive_type", "size", "md5")
    inside = F.split_part("path", F.lit("/g/"), F.lit(2))
    return got.select(_file_id(F.coalesce("archive_path", "path")).alias("doc_id"), F.concat(F.lit("g/"), inside).alias("path"), "archive_type", "size", "md5", F.lit(bad).cast("long").alias("n_failed"))


def _run_sql(archive: bool) -> str:
    single = f"count(*) OVER (PARTITION BY doc_id // {GAME_FILES}) = 1"
    game = f"'Game ' || (doc_id // {GAME_FILES})"
    if archive:
        path, kind = f"'g/' || CASE WHEN {single} THEN '' ELSE {game} || '/' END || {game} || '.zip'", "'zip'"
    else:
        path, kind = f"'g/' || CASE WHEN {single} THEN '' ELSE {game} || '/' END || 'd' || doc_id || '.bin'", "CAST(NULL AS VARCHAR)"
    return f"SELECT doc_id, {path} AS path, {kind} AS archive_type, CAST(strlen({CONTENT_SQL}) AS BIGINT) AS size, md5({CONTENT_SQL}) AS md5, 0::BIGINT AS n_failed FROM documents"


def _catalog(mode: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        """The best games written as a catalog and read back: places, names, and every file's attributes."""
        rom = F.transform("rom", lambda r: F.struct(r["name"].alias("_name"), r["size"].alias("_size"), *(F.lit(None).cast("string").alias(f"_{k}") if k in ("header", "mia", "merge", "date", "serial") else r[k].alias(f"_{k}") for k in ("header", "mia", "crc", "md5", "sha1", "sha256", "merge", "status", "date", "serial"))))
        best = R.pick_best(D.derive(views.games(s, d)), Q.PREFERENCE)
        empty = {f.name: F.lit(None).cast(f.dataType) for f in GAME}
        entry = F.struct(*((F.col("name") if k == "_name" else F.col("cloneof") if k == "_cloneof" else rom if k == "rom" else v).alias(k) for k, v in empty.items()))
        path, header = f"{scratch(s, 'catalog')}/c.{mode}", s.createDataFrame([("Items & <more>", "x")], "name string, version string").first()
        write_catalog(rebuilt(materialize(best.select("name", "dat_ord", "game_ord", entry.alias("game")), "best")), path, mode, rebuilt_header(header))
        docs, games = load_catalogs(s, [path])
        title = docs.select("dat_ord", F.col("header.name").alias("title"), F.col("header.version").alias("version"))
        rows = games.select("dat_ord", (F.col("game_ord") + 1).cast("long").alias("place"), "name", F.col("cloneof").isNull().alias("cleared"), F.explode("rom").alias("r"))
        return rows.join(F.broadcast(title), "dat_ord").select("place", "name", "cleared", "title", "version", F.col("r.name").alias("rom_name"), F.col("r.size").alias("size"), "r.crc", "r.md5", "r.sha1", "r.status")

    return run


def _names_file(s: SparkSession, d: str) -> DataFrame:
    """The list of selected names written as a text file and read back, with the lines' numbers."""
    best = materialize(select_best(views.games(s, d), p=Q.PREFERENCE), "best")
    path = f"{scratch(s, 'names')}/names.txt"
    write_names(ordered(best), path)
    return text_rows(s, path).select("line", F.col("value").alias("name"))


def _catalog_by_game(s: SparkSession, d: str) -> DataFrame:
    """All games as one XML catalog in the order of their keys, read game by game from many splits."""
    rom = F.transform("rom", lambda r: F.struct(*((r[f.name[1:]] if f.name[1:] in ("name", "size", "crc", "md5", "sha1", "sha256", "status") else F.lit(None).cast(f.dataType)).alias(f.name) for f in ROM)))
    own = {"_name": F.col("name"), "_cloneof": F.col("cloneof"), "description": F.concat("name", F.lit(" & <more>")), "rom": rom}
    rows = views.games(s, d).select("game_ord", F.struct(*(own.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in GAME)).alias("game"))
    path = f"{scratch(s, 'catalog')}/all games #1 [x].xml"
    write_catalog(rows.orderBy("game_ord"), path, "xml", {"name": "all", "clrmamepro": {"_header": "nes.xml"}})
    games = load_catalogs(s, [path], 2000 + 30 * rows.count())[1]  # about a twentieth of the file
    splits = games.agg((F.count_distinct("split") > 1).alias("many_splits"))
    return games.select("game_ord", "name", "cloneof", F.col("game.description").alias("description"), "detector", F.size("rom").alias("n_roms"), F.aggregate("rom", F.lit(0).cast("long"), lambda a, r: a + r["size"]).alias("bytes"),
                        F.col("rom")[0]["sha1"].alias("sha1")).crossJoin(F.broadcast(splits))


#: Forms of file names; a document's id decides which one it has and stands in it.
NAME_FORMS = ("_a{}", ".b{}", "_sub/k{}", ".h/m{}", "x{}._COPYING_", "x#{}.bin", "q?{}.bin", "y%20z{}", "p q{}", "é{}", "a*b{}", "[c]{}", "{{d,e}}{}", "f\\g{}", "deep/er/h{}", "n{}.bin")


def _of_all_forms(s: SparkSession, d: str) -> DataFrame:
    """doc_id, name, content: a file of one of NAME_FORMS for each document."""
    forms = F.array(*(F.concat(*(x for p in zip([F.lit(x.replace("{{", "{").replace("}}", "}")) for x in form.replace("{}", "\0").split("\0")], [F.col("doc_id").cast("string"), F.lit("")]) for x in p)) for form in NAME_FORMS))
    return _contents(s, d).select("doc_id", F.element_at(forms, (F.col("doc_id") % len(NAME_FORMS) + 1).cast("int")).alias("name"), "content")


def _below(to: str) -> F.Column:
    """The name of a file of the column path, below the folder `to`."""
    return F.substring_index(F.col("path"), f"/{to.rsplit('/', 1)[1]}/", -1)


def _listing_names(s: SparkSession, d: str) -> DataFrame:
    """Files of names of every form, with links to some of them and to a folder, listed and scanned."""
    to = scratch(s, "named")
    named = _of_all_forms(s, d)
    write_loose(named, to)

    def link(frames):
        for pdf in frames:
            for name in pdf["name"]:
                os.symlink(local(f"{to}/{name}"), local(f"{to}/link to {name.replace('/', ' ')}"))
            yield pd.DataFrame({"n": [len(pdf)]})

    if local(to) is not None:
        named.where("doc_id % 10 = 0").select("name").mapInPandas(link, "n long").agg(F.sum("n")).first()
        os.symlink(local(to), f"{local(to)}/deep/round")
    return scan(list_files(s, [to])).select(_below(to).alias("name"), "size", "md5", "status")


TASKS = 16


def _scan_schedule(s: SparkSession, d: str) -> DataFrame:
    """Files of the documents' sizes dealt over TASKS tasks, and whether the fullest has at most 1.2 times the mean, or one file."""
    rows = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), F.octet_length("text").cast("long").alias("length"))
    dealt = materialize(schedule(rows, TASKS).withColumn("task", F.spark_partition_id()), "dealt")
    loads = dealt.groupBy("task").agg(F.sum("length").alias("bytes"), F.max("length").alias("largest"))
    fits = loads.agg((F.max("bytes") <= F.greatest(F.sum("bytes") * 1.2 / TASKS, F.max("largest"))).alias("fits"))
    return dealt.select(F.col("path").cast("long").alias("doc_id"), "length").crossJoin(F.broadcast(fits))


def _targets_once(s: SparkSession, d: str) -> DataFrame:
    """Each document is copied to a target that it shares with the next; what became of each copy, and what each target holds."""
    to, out = scratch(s, "loose"), scratch(s, "shared-targets")
    rows = _contents(s, d)
    write_loose(rows.select(_named().alias("name"), "content"), to)
    target, nothing = F.concat(F.lit(f"{out}/t"), F.floor(F.col("doc_id") / 2).cast("string")), F.lit(None).cast("string")
    plan = rows.select(F.lit("copy").alias("kind"), F.concat(F.lit(f"{to}/"), _named()).alias("from_path"), nothing.alias("from_type"), target.alias("to_path"), nothing.alias("to_type"), F.expr("cast(array() as array<struct<from_name:string,to_name:string>>)").alias("entries"),
                       F.struct(F.lit(0).alias("dat_ord"), F.col("doc_id").alias("game_ord")).alias("owner"))
    done = materialize(run_plan(plan), "done").select(_file_id("from_path").alias("doc_id"), F.regexp_extract("to_path", "[0-9-]+$", 0).alias("t"), "status")
    held = scan(list_files(s, [out])).select(F.regexp_extract("path", "[0-9-]+$", 0).alias("t"), "md5")
    return done.join(held, "t", "left").select("doc_id", "status", "md5")


def _streamed(s: SparkSession, d: str) -> DataFrame:
    """A stream over the loose files, run until it has seen all, into a table."""
    to, base = scratch(s, "streamed"), scratch(s, "stream")
    write_loose(_contents(s, d).select(_named().alias("name"), "content"), to)
    q = scan_stream(s, to).writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.parquet(f"{base}/rows").select(_file_id("path").alias("doc_id"), *_digest_columns())


def _streamed_names(s: SparkSession, d: str) -> DataFrame:
    """The same files as those of `_listing_names`, arriving in two parts: the stream runs after each, and has each file once."""
    to, base = scratch(s, "arriving"), scratch(s, "arrived")
    for part in (F.col("doc_id") % 2 == 0, F.col("doc_id") % 2 != 0):
        write_loose(_of_all_forms(s, d).where(part), to)
        q = scan_stream(s, to).writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
        q.awaitTermination()
    return s.read.parquet(f"{base}/rows").select(_below(to).alias("name"), "size", "md5", "status")


def _completed(s: SparkSession, d: str) -> DataFrame:
    """The scan view in four parts, which a stream sees one after the other; the games that it finds complete."""
    base = scratch(s, "completed")
    there = materialize(views.scan(s, d), "scan")
    if len(there.inputFiles()) < 4:  # too few to make four parts
        there = materialize(there.repartition(4), "scan")
    folder, files = there.inputFiles()[0].rsplit("/", 1)[0], len(there.inputFiles())
    rows = s.readStream.schema(there.schema).option("maxFilesPerTrigger", -(-files // 4)).parquet(folder)
    done = complete_as_seen(rows, materialize(M.rom_rows(views.games(s, d)), "roms"))
    q = done.writeStream.format("parquet").option("path", f"{base}/games").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.parquet(f"{base}/games").select(F.col("game_ord").alias("ord"))


def _options(s: SparkSession, d: str) -> DataFrame:
    """A selection whose filter and preference come from command-line options."""
    a = cli.parser().parse_args(["1g1r", "c.xml", "--no-all", "--bios", "--demo", "--bad", "--promo", "--sort-regions", "jpn, usa", "--sort-languages", "Ja,En", "--exclude", "(Rev 1)", "--include-regex", r"Item \d*8 ", "--post-exclude-regex", r"\(v1\.0\)", "--early-revisions"])
    f, post, p = cli.options(a)
    return select_best(views.games(s, d), f, p, post, check=False).select(F.col("game_ord").alias("ord"), "parent_name", "name")


OPTIONS_PREFERENCE = Q.Preference(regions=("JPN", "USA"), languages=("ja", "en"), early_revisions=True)


def _configured(s: SparkSession, d: str) -> DataFrame:
    """Patterns and regions that come from files, JSON and YAML."""
    base = scratch(s, "config")
    write_file(f"{base}/p.json", lambda out: out.write(b'{"strings": ["(Rev 10)"], "patterns": ["Item [0-9]*[05][048] "]}'))
    write_file(f"{base}/r.yaml", lambda out: out.write(b'regions:\n  - {code: AMERICA, pattern: "(?i)usa|brazil", languages: [en, pt]}\n  - {code: ASIA, pattern: Japan, languages: [ja]}\n'))
    regions, patterns = load_regions(_url(f"{base}/r.yaml")), load_patterns(_url(f"{base}/p.json"))
    rows = W.apply_filter(D.derive(views.games(s, d), regions), Q.Filter(excludes=patterns))
    return rows.select(F.col("game_ord").alias("ord"), F.array_join("regions_detected", ",").alias("regions"), F.array_join("eff_languages", ",").alias("languages"))


def _url(path: str) -> str:
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def _detectors(s: SparkSession, d: str) -> DataFrame:
    detector = F.element_at(F.array(F.lit("nes.xml"), F.lit(None).cast("string"), F.lit("fds.xml")), (F.col("game_ord") % 3 + 1).cast("int"))
    return W.validity(D.derive(views.games(s, d)).withColumn("detector", detector))


def _times(s: SparkSession, d: str) -> DataFrame:
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    e = s.read.parquet(f"{d}/events.parquet").select("event_id", F.timestamp_micros(micros).alias("ts"))
    ticks = FF.windows_ticks(F.col("ts"))
    return e.select("event_id", *(F.unix_micros(FF.truncated_time(F.col("ts"), u)).alias(u) for u in ("microsecond", "millisecond", "second")), ticks.alias("ticks"), F.unix_micros(FF.from_windows_ticks(ticks)).alias("back"))


SYSTEM_NAMES = ("Linux", "Mac OS X", "OSX 10", "FreeBSD", "Windows 11", "SunOS", "", "NetBSD", "linux-gnu", "OpenBSD 7")
SYSTEM_KINDS = ("LINUX", "OSX", "OSX", "BSD", "WINDOWS", "UNKNOWN", "UNKNOWN", "BSD", "LINUX", "BSD")
MACHINE_NAMES = ("x86_64", "AMD64", "i686", "x86", "armv7l", "aarch64", "ppc64", "ppc", "sparc", "arm64", "i786")
MACHINE_KINDS = ("X86_64", "X86_64", "X86_32", "X86_32", "ARM_32", "ARM_64", "POWER_PC_64", "POWER_PC_32", "UNKNOWN", "ARM_64", "UNKNOWN")


def _systems(s: SparkSession, d: str) -> DataFrame:
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % len(names) + 1).cast("int"))
    return s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", S.operating_system(pick(SYSTEM_NAMES)).alias("system"), S.architecture(pick(MACHINE_NAMES)).alias("machine"))


def _hex_revisions(s: SparkSession, d: str) -> DataFrame:
    """Revisions of hexadecimal numbers of all lengths up to 63 bits."""
    k = F.col("o_orderkey").cast("long")
    number = F.expr("shiftrightunsigned(9223372036854775807 - o_orderkey * 1000003, cast(o_orderkey % 61 as int))")
    name = F.concat(F.lit("Item (Rev "), F.when(k % 2 == 0, F.hex(number)).otherwise(F.lower(F.hex(number))), F.when(k % 5 == 0, F.concat(F.lit(".00"), F.hex(number))).otherwise(""), F.lit(")"))
    rows = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", name.alias("name"))
    return rows.select("o_orderkey", "name", F.array_join(F.transform(N.parse_numbers(F.col("name"), N.REVISION), lambda x: x.cast("string")), ",").alias("revision"))


_HEX_SQL = """WITH n AS (SELECT o_orderkey, (9223372036854775807 - o_orderkey * 1000003) >> (o_orderkey % 61)::INT AS x FROM orders)
SELECT o_orderkey, 'Item (Rev ' || CASE WHEN o_orderkey % 2 = 0 THEN hex(x) ELSE lower(hex(x)) END || CASE WHEN o_orderkey % 5 = 0 THEN '.00' || hex(x) ELSE '' END || ')' AS name,
  x::VARCHAR || CASE WHEN o_orderkey % 5 = 0 THEN ',' || x::VARCHAR ELSE '' END AS revision FROM n"""


def _plan_rows(archive: str | None):
    def run(s: SparkSession, d: str) -> DataFrame:
        plan = Q._plan(s, d, FileOutput("out", archive_type=archive))
        text = F.array_join(F.transform("entries", lambda x: F.concat(x["from_name"], F.lit(">"), x["to_name"])), "|")
        return plan.select("kind", "from_path", "from_type", "to_path", "to_type", text.alias("entries"))

    return run


_USED = "SELECT m.* FROM matches m JOIN complete USING (ord) {more}WHERE archive_type IS NOT NULL AND ord NOT IN (SELECT ord FROM all_loose)"
_FOLDER = "'out' || CASE WHEN n > 1 THEN '/' || name ELSE '' END"
_ROM_NAME = "name || ' ' || {r} || '.bin'"


def _plan_sql(archive: bool) -> str:
    if archive:
        used = f"{_USED.format(more='JOIN cover USING (ord, path) ')} UNION ALL SELECT * FROM loose WHERE ord IN (SELECT ord FROM all_loose)"
    else:
        used = f"{_USED.format(more='')} UNION ALL SELECT * FROM loose"
    start = f"""{Q._CHOSEN}, used AS ({used}), u AS (SELECT used.*, best.name, best.n_roms AS n FROM used JOIN best USING (ord)),
e AS (SELECT ord, path, archive_path, any_value(archive_type) AS archive_type, min(rom_ord) AS r, any_value(name) AS name, any_value(n) AS n FROM u WHERE archive_type IS NOT NULL GROUP BY ord, path, archive_path)"""
    if not archive:
        to = f"{_FOLDER} || '/' || {_ROM_NAME.format(r='rom_ord')}"
        target = f"{_FOLDER} || '/' || {_ROM_NAME.format(r='r')}"
        return f"""{start}
SELECT DISTINCT 'copy' AS kind, path AS from_path, CAST(NULL AS VARCHAR) AS from_type, {to} AS to_path, CAST(NULL AS VARCHAR) AS to_type, path || '>' || {to} AS entries FROM u WHERE archive_type IS NULL
UNION ALL SELECT 'extract', path, any_value(archive_type), any_value({_FOLDER}), NULL, string_agg(archive_path || '>' || {target}, '|' ORDER BY r, archive_path) FROM e GROUP BY ord, path"""
    zipped = f"{_FOLDER} || '/' || name || '.zip'"
    return f"""{start}, c AS (SELECT DISTINCT ord, rom_ord, path, name, n FROM u WHERE archive_type IS NULL)
SELECT 'archive_copy' AS kind, path AS from_path, any_value(archive_type) AS from_type, any_value({zipped}) AS to_path, 'zip' AS to_type, string_agg(archive_path || '>' || {_ROM_NAME.format(r='r')}, '|' ORDER BY r, archive_path) AS entries FROM e GROUP BY ord, path
UNION ALL SELECT 'compress', NULL, NULL, any_value({zipped}), 'zip', string_agg(path || '>' || {_ROM_NAME.format(r='rom_ord')}, '|' ORDER BY rom_ord, path) FROM c GROUP BY ord"""


def queries() -> dict:
    return {
        "scan_loose_files": _scan_loose,
        "scan_archives": _scan_archives,
        "scan_headered": _scan_headered,
        "scan_streamed": _streamed,
        "scan_order": _scan_order,
        "header_strip": _header_strip,
        "header_programs": _header_programs,
        "scan_contents": _scan_contents,
        "games_complete_streamed": _completed,
        "catalog_xml": _catalog("xml"),
        "catalog_json": _catalog("json"),
        "catalog_yaml": _catalog("yaml"),
        "names_file": _names_file,
        "catalog_by_game": _catalog_by_game,
        "listing_names": _listing_names,
        "listing_streamed": _streamed_names,
        "scan_schedule": _scan_schedule,
        "targets_once": _targets_once,
        "files_extracted": lambda s, d: _run(s, d, None),
        "files_packed": lambda s, d: _run(s, d, "zip"),
        "file_plan_rows": _plan_rows(None),
        "file_plan_archive_rows": _plan_rows("zip"),
        "command_line_options": _options,
        "configured_filter": _configured,
        "catalog_detectors": _detectors,
        "file_times": _times,
        "system_names": _systems,
        "hex_revisions": _hex_revisions,
    }


def oracle_sql() -> dict[str, str]:
    digests = f"md5({CONTENT_SQL}) AS md5, sha1({CONTENT_SQL}) AS sha1, sha256({CONTENT_SQL}) AS sha256, 'OK' AS status"
    size = f"CAST(strlen({CONTENT_SQL}) AS BIGINT)"
    plain = f"SELECT doc_id, {size} AS size, {size} AS unheadered_size, {digests} FROM documents"
    rom_cols = "ord, rom_ord, size, sha1, md5, crc"
    best = f"{Q._PARSED}, {Q._sql(views.ROMS)}, best AS (SELECT * FROM parsed QUALIFY {Q._BEST} = 1), placed AS (SELECT *, row_number() OVER (ORDER BY {Q._NAME_ORDER}, ord) AS place FROM best)"
    catalog = f"""{best} SELECT place, name, true AS cleared, 'Items & <more> (1G1R)' AS title, 'x' AS version, name || ' ' || rom_ord || '.bin' AS rom_name, size, crc, md5, sha1, CASE WHEN bad_rom THEN 'baddump' END AS status
FROM placed JOIN (SELECT {rom_cols} FROM roms) r USING (ord)"""
    rank = Q._rank_sql(OPTIONS_PREFERENCE)
    built_in = " OR ".join(f"regexp_matches(name, {Q._quoted(p)})" for k, p in N.BUILT_IN.items() if k not in ("bad", "promo"))
    names = f"SELECT replace(({Q._list(NAME_FORMS)})[CAST(doc_id % {len(NAME_FORMS)} AS INT) + 1].replace('{{{{', '{{').replace('}}}}', '}}'), '{{}}', doc_id::VARCHAR) AS name, {size} AS size, md5({CONTENT_SQL}) AS md5, 'OK' AS status FROM documents"
    pick = lambda xs, col: f"([{', '.join(repr(x) for x in xs)}])[CAST(o_orderkey % {len(xs)} AS INT) + 1] AS {col}"
    regions = "list_filter(list_transform(tokens, lambda t: CASE WHEN regexp_full_match(t, '(?i)usa|brazil') THEN 'AMERICA' WHEN regexp_full_match(t, 'Japan') THEN 'ASIA' END), lambda x: x IS NOT NULL)"
    return {
        "scan_loose_files": plain,
        "scan_archives": f"SELECT doc_id, {_KIND_SQL} AS archive_type, {size} AS size, {size} AS unheadered_size, {digests} FROM documents",
        "scan_headered": f"SELECT doc_id, doc_id % 4 >= 2 AS packed, {size} + CASE WHEN doc_id % 2 = 0 THEN 512 ELSE 0 END AS size, {size} AS unheadered_size, {digests} FROM documents",
        "scan_contents": f"SELECT doc_id, {size} + CASE WHEN doc_id % 2 = 0 THEN 512 ELSE 0 END AS size, {size} AS unheadered_size, {digests} FROM documents",
        "scan_streamed": plain,
        "scan_order": "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, row_number() OVER (ORDER BY strlen(coalesce(text, '')) DESC, doc_id) - 1 AS before FROM documents",
        "header_strip": _HEADER_SQL,
        "header_programs": _PROGRAMS_SQL,
        "games_complete_streamed": f"{Q._ONLY_GAMES} SELECT ord FROM complete",
        "catalog_xml": catalog,
        "catalog_json": catalog,
        "catalog_yaml": catalog,
        "names_file": f"{best} SELECT place AS line, name FROM placed",
        "catalog_by_game": f"WITH {Q._GAMES}, {Q._sql(views.ROMS)} SELECT CAST(row_number() OVER (ORDER BY g.ord) - 1 AS BIGINT) AS game_ord, name, cloneof, name || ' & <more>' AS description, 'nes.xml' AS detector, CAST(g.n_roms AS INTEGER) AS n_roms, r.bytes, r.sha1, true AS many_splits FROM games g JOIN (SELECT ord, CAST(sum(size) AS BIGINT) AS bytes, max(sha1) FILTER (rom_ord = 0) AS sha1 FROM roms GROUP BY ord) r USING (ord)",
        "listing_names": names,
        "listing_streamed": names,
        "scan_schedule": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS length, true AS fits FROM documents",
        "targets_once": f"SELECT doc_id, CASE WHEN doc_id = min(doc_id) OVER w THEN 'OK' ELSE 'FAILED' END AS status, first(md5({CONTENT_SQL})) OVER (PARTITION BY doc_id // 2 ORDER BY doc_id) AS md5 FROM documents WINDOW w AS (PARTITION BY doc_id // 2)",
        "files_extracted": _run_sql(False),
        "files_packed": _run_sql(True),
        "file_plan_rows": _plan_sql(False),
        "file_plan_archive_rows": _plan_sql(True),
        "command_line_options": f"""{Q._PARSED}, kept AS (SELECT * FROM parsed WHERE len(proto) = 0 AND len(beta) = 0 AND len(sample) = 0 AND (NOT (contains(name, '(Rev 1)') OR {built_in}) OR regexp_matches(name, 'Item [0-9]*8 '))),
fine AS (SELECT * FROM kept WHERE parent_name NOT IN (SELECT parent_name FROM kept WHERE contains(name, '(v1.0)')))
SELECT ord, parent_name, name FROM fine QUALIFY row_number() OVER (PARTITION BY parent_name ORDER BY {rank}, ord) = 1""",
        "configured_filter": f"""{Q._PARSED}, r AS (SELECT *, {Q._ordered_set(regions)} AS found FROM parsed WHERE NOT (contains(name, '(Rev 10)') OR regexp_matches(name, 'Item [0-9]*[05][048] '))),
u AS (SELECT *, {Q._ordered_set("list_concat(found, regions_provided)")} AS every FROM r)
SELECT ord, array_to_string(found, ',') AS regions, array_to_string(CASE WHEN len(languages) > 0 THEN languages ELSE flatten(list_transform(every, lambda x: CASE x WHEN 'AMERICA' THEN ['en', 'pt'] WHEN 'ASIA' THEN ['ja'] ELSE [] END)) END, ',') AS languages FROM u""",
        "catalog_detectors": f"{Q._PARSED} SELECT count(*) AS n_games, count(*) FILTER (is_parent) AS n_parents, 2::BIGINT AS n_detectors FROM parsed",
        "file_times": "SELECT event_id, epoch_us(ts) AS microsecond, epoch_us(date_trunc('millisecond', ts)) AS millisecond, epoch_us(date_trunc('second', ts)) AS second, (epoch_us(ts) + 11644473600000000) * 10 AS ticks, epoch_us(ts) AS back FROM events",
        "system_names": f"SELECT o_orderkey, {pick(SYSTEM_KINDS, 'system')}, {pick(MACHINE_KINDS, 'machine')} FROM orders",
        "hex_revisions": _HEX_SQL,
    }
