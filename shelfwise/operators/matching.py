"""Matching of catalog files with scanned files: a cascade of keys, completeness, loose files first, one-archive cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.files import archive_ordinal
from ..functions.tables import materialize

GAME = ["dat_ord", "game_ord"]
#: The keys in their order; a sha256 counts only where asked, and before all others.
LEVELS = (("sha256",), ("sha1",), ("md5",), ("size", "crc"))
#: Hexadecimal digits of the digests.
DIGITS = {"sha256": 64, "sha1": 40, "md5": 32}
#: Words of 64 bits of the table that `may_have` broadcasts: 20 MB as rows, whatever it is made from.
WORDS = 1 << 19


def rom_rows(games: DataFrame) -> DataFrame:
    """One row per file of each game: dat_ord, game_ord, rom_ord, rom_name, size, crc, md5, sha1, sha256, n_roms."""
    rows = games.where(F.size("rom") > 0).select(*GAME, F.size("rom").alias("n_roms"), F.posexplode("rom").alias("rom_ord", "r"))
    return rows.select(*GAME, "rom_ord", "n_roms", F.col("r.name").alias("rom_name"), F.col("r.size").alias("size"), *(F.lower(F.col(f"r.{k}")).alias(k) for k in ("crc", "md5", "sha1", "sha256")))


def _key(level: tuple[str, ...]) -> Column:
    """The key as bytes, null with a null part. A whole digest is half as long as its digits, and never equals another text, which is
    put behind more bytes than a digest has."""
    texts = [F.lower(F.col(c).cast("string")) for c in level]
    if level[0] not in DIGITS:
        return F.concat(*(F.concat(F.lit(":"), x) for x in texts)).cast("binary")
    other = F.concat(F.lit(":" * 64), texts[0]).cast("binary")
    return F.coalesce(F.when(F.length(texts[0]) == DIGITS[level[0]], F.unhex(texts[0])), other)


def key_rows(rows: DataFrame, keep: list[str], sha256_first: bool) -> DataFrame:
    """keep, level and key: one row per key that a file has. Null parts make no key; digests compare without case."""
    keys = [_key(level) for level in LEVELS]
    levels = [F.struct(F.lit(i).alias("level"), k.alias("key")) for i, k in enumerate(keys) if i or sha256_first]
    return rows.select(*keep, F.explode(F.filter(F.array(*levels), lambda x: x["key"].isNotNull())).alias("_k")).select(*keep, "_k.level", "_k.key")


def match_levels(roms: DataFrame, scan: DataFrame, sha256_first: bool = False, keep: list[str] | None = None) -> DataFrame:
    """rom_rows that some scanned file matches, with the first level at which one does and its key. Only the scan's distinct
    keys are read, so a file that was scanned many times counts once. keep: the other columns that are wanted, by default all."""
    there = key_rows(scan.withColumn("size", F.col("unheadered_size")), [], sha256_first).distinct()
    rest = [c for c in roms.columns if c not in (*GAME, "rom_ord")] if keep is None else keep
    mine = key_rows(roms, [*GAME, "rom_ord", *rest], sha256_first).join(there, ["level", "key"], "left_semi")
    least = mine.groupBy(*GAME, "rom_ord").agg(F.min(F.struct("level", "key", *rest)).alias("m"))
    return least.select(*GAME, "rom_ord", "m.level", "m.key", *(f"m.{c}" for c in rest))


def match_roms(roms: DataFrame, scan: DataFrame, sha256_first: bool = False) -> DataFrame:
    """rom_rows with the scan rows they match: a key counts if any scanned file has it, so an unknown or missing sha1 falls
    through to md5, then to (size, crc). Columns: rom columns, archive_type, path, archive_path.

    scan: archive_type, path, archive_path, unheadered_size, crc, md5, sha1, sha256. Null keys never match; digests compare
    without case. First the level that counts is found among distinct keys, then one join makes the rows of that level.
    """
    return match_levels(roms, scan, sha256_first).join(_copies(scan, sha256_first), ["level", "key"]).select(*roms.columns, "archive_type", "path", "archive_path")


def seen_first() -> Column:
    """The order of a file's matches: loose files, then archives by type, path and entry."""
    return F.struct(archive_ordinal(F.col("archive_type")).alias("kind"), F.col("path").alias("path"), F.col("archive_path").alias("entry"))


def first_matches(matches: DataFrame) -> DataFrame:
    """The first match of each file, by a partial aggregate."""
    rest = [c for c in matches.columns if c not in (*GAME, "rom_ord")]
    least = matches.groupBy(*GAME, "rom_ord").agg(F.min(F.struct(seen_first().alias("_seen"), *rest)).alias("m"))
    return least.select(*GAME, "rom_ord", *(f"m.{c}" for c in rest))


def _copies(scan: DataFrame, sha256_first: bool) -> DataFrame:
    return key_rows(scan.withColumn("size", F.col("unheadered_size")), ["archive_type", "path", "archive_path"], sha256_first)


def first_sources(roms: DataFrame, scan: DataFrame, sha256_first: bool = False, keep: list[str] | None = None) -> DataFrame:
    """As first_matches(match_roms(roms, scan)), but the copies of each key are summed up to the first one before the join, so there
    are rows for files plus copies, not for their products, and one shuffle of the copies tells both the level that counts and
    its source. `loose` is the first loose copy, if there is one; level and key are those of match_levels."""
    loose = F.when(F.col("archive_type").isNull(), F.struct("path", "archive_path"))
    first = F.struct(archive_ordinal(F.col("archive_type")).alias("kind"), "path", "archive_path", "archive_type")  # seen_first's order
    least = _copies(scan, sha256_first).groupBy("level", "key").agg(F.min(first).alias("m"), F.min(loose).alias("loose"))
    rest = [c for c in roms.columns if c not in (*GAME, "rom_ord")] if keep is None else keep
    mine = key_rows(roms, [*GAME, "rom_ord", *rest], sha256_first).join(least, ["level", "key"])
    found = mine.groupBy(*GAME, "rom_ord").agg(F.min(F.struct("level", "key", *rest, "m", "loose")).alias("f"))
    return found.select(*GAME, "rom_ord", *(f"f.{c}" for c in rest), "f.m.archive_type", "f.m.path", "f.m.archive_path", "f.loose", "f.level", "f.key")


def first_levels(roms: DataFrame, scan: DataFrame, sha256_first: bool = False) -> DataFrame:
    """rom_rows that some scanned file matches: dat_ord, game_ord, rom_ord, n_roms, and level and key of match_levels; `loose` is true if
    a loose file has that key, else null. Of the copies only keys move, once for each task that has them, and no paths."""
    there = key_rows(scan.withColumns({"size": F.col("unheadered_size"), "_loose": F.when(F.col("archive_type").isNull(), 1)}), ["_loose"], sha256_first)
    there = there.groupBy("level", "key").agg(F.max("_loose").alias("_loose"))  # a number, so that no task sorts its copies
    mine = key_rows(roms, [*GAME, "rom_ord", "n_roms"], sha256_first).join(there, ["level", "key"])
    least = mine.groupBy(*GAME, "rom_ord").agg(F.min(F.struct("level", "key", "n_roms", "_loose")).alias("m"))
    return least.select(*GAME, "rom_ord", "m.n_roms", "m.level", "m.key", (F.col("m._loose") == 1).alias("loose"))


def may_have(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """rows without most of those whose keys are not in wanted, before anything is shuffled: wanted's keys set four bits each in one of
    WORDS words, and a row stays if its own four are set. What stays in error must fall out of a join that follows. Should there
    be so many keys that all bits are set, all rows stay."""
    h = F.xxhash64(*keys)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int")) for at in (20, 26, 32, 38)]
    mask = bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])
    word = h.bitwiseAND(F.lit(WORDS - 1))
    words = wanted.select(word.alias("_word"), mask.alias("_set")).groupBy("_word").agg(F.bit_or("_set").alias("_set"))
    mine = rows.withColumns({"_at": word, "_mask": mask})
    return mine.join(F.broadcast(words), (F.col("_at") == F.col("_word")) & (F.col("_set").bitwiseAND(F.col("_mask")) == F.col("_mask")), "left_semi").select(*rows.columns)


def match_order(matches: DataFrame) -> DataFrame:
    """matches with match_ord (1: first). This sorts all copies of a file; `first_matches` needs no sort."""
    order = Window.partitionBy(*GAME, "rom_ord").orderBy(archive_ordinal(F.col("archive_type")), "path", F.col("archive_path").asc_nulls_first())
    return matches.withColumn("match_ord", F.row_number().over(order))


def _seen_roms(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, n_seen (how many different files of a game occur in rows) and n_roms, by bitmaps of 64 file numbers each, which are
    joined before the shuffle."""
    words = rows.groupBy(*keys, F.floor(F.col("rom_ord") / 64).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, rom_ord % 64)")).alias("_bits"), F.first("n_roms").alias("n_roms"))
    return words.groupBy(*keys).agg(F.sum(F.bit_count("_bits")).alias("n_seen"), F.first("n_roms").alias("n_roms"))


def complete_games(matched: DataFrame) -> DataFrame:
    """dat_ord, game_ord of games all of whose files match; games without files are never complete. matched: rows of
    match_levels, or of match_roms."""
    return _seen_roms(matched, *GAME).where("n_seen = n_roms").select(*GAME)


def choose_sources(matches: DataFrame, to_archive: bool) -> DataFrame:
    """The matches that each complete game uses, with `choice` (loose, archive or mixed).

    If the first loose match of every file exists, those. Otherwise, if an archive is asked for, the matches of the first
    archive that covers all files (most matches first, then first seen); games that no archive covers have none. If no
    archive is asked for, the first loose match of each file and all archive matches.
    """
    columns = ["rom_name", "archive_type", "path", "archive_path", "n_roms"]
    loose = F.when(F.col("archive_type").isNull(), F.struct(F.col("path"), F.col("archive_path"), F.col("rom_name"), F.col("archive_type")))
    per_rom = matches.groupBy(*GAME, "rom_ord").agg(F.first("n_roms").alias("n_roms"), F.min(loose).alias("m"))
    per_game = per_rom.groupBy(*GAME).agg(F.count(F.lit(1)).alias("n"), F.count("m").alias("n_loose"), F.first("n_roms").alias("n_roms"), F.collect_list(F.when(F.col("m").isNotNull(), F.struct("rom_ord", "m"))).alias("loose"))
    complete = per_game.where("n = n_roms").withColumn("all_loose", F.col("n_loose") == F.col("n_roms"))
    taken = complete.where("all_loose") if to_archive else complete
    first = taken.select(*GAME, "n_roms", F.when(F.col("all_loose"), "loose").otherwise("mixed").alias("choice"), F.explode("loose").alias("x")).select(*GAME, "x.rom_ord", "n_roms", "x.m.*", "choice")
    packed = matches.where(F.col("archive_type").isNotNull()).select(*GAME, "rom_ord", *columns).join(complete.where("not all_loose").select(*GAME), GAME, "left_semi")
    if to_archive:
        packed = packed.join(cover(packed), [*GAME, "path"], "left_semi")
    return first.unionByName(packed.withColumn("choice", F.lit("archive" if to_archive else "mixed")))


def cover(packed: DataFrame) -> DataFrame:
    """dat_ord, game_ord, path: the archive that covers all files of a game, most matches first, then first seen. An archive covers a
    file however often it holds it, and only then."""
    words = packed.groupBy(*GAME, "path", F.floor(F.col("rom_ord") / 64).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, rom_ord % 64)")).alias("_bits"), F.count(F.lit(1)).alias("n"), F.first("n_roms").alias("n_roms"), F.min(F.struct("rom_ord", seen_first().alias("m"))).alias("seen")
    )
    per = words.groupBy(*GAME, "path").agg(F.sum(F.bit_count("_bits")).alias("n_seen"), F.sum("n").alias("n"), F.first("n_roms").alias("n_roms"), F.min("seen").alias("seen"))
    best = per.where("n_seen = n_roms").groupBy(*GAME).agg(F.min(F.struct((-F.col("n")).alias("n"), "seen", "path")).alias("b"))
    return best.select(*GAME, "b.path")


def choose(roms: DataFrame, scan: DataFrame, to_archive: bool, sha256_first: bool = False, firsts: DataFrame | None = None) -> DataFrame:
    """As choose_sources(match_roms(roms, scan), to_archive), without all matches: loose files come from each key's first loose copy,
    and an archive can only cover a game if it holds the one of the game's files that the fewest archives hold, so only
    those archives are looked at. A digest that very many files and copies share makes no product, unless all of a game's files
    have such ones (or, without an output archive, all archive matches are the result).

    firsts: first_levels (or first_sources) of a catalog that has these games among others. Which keys are wanted, and whether of
    loose files or of archives, is known before the scan is read for its paths, so other copies are neither written nor shuffled."""
    if firsts is None:
        firsts = first_levels(roms, scan, sha256_first)
    firsts = firsts.select(*GAME, "rom_ord", "n_roms", "level", "key", F.col("loose").isNotNull().alias("loose"))
    firsts = materialize(firsts.join(roms.select(*GAME, "rom_ord", "rom_name"), [*GAME, "rom_ord"]), "firsts")
    per_game = firsts.groupBy(*GAME).agg(F.count(F.lit(1)).alias("n"), F.count_if("loose").alias("n_loose"), F.first("n_roms").alias("n_roms"))
    complete = per_game.where("n = n_roms").select(*GAME, (F.col("n_loose") == F.col("n_roms")).alias("all_loose"))
    used = materialize(firsts.join(complete, GAME), "used")
    first, rest = used.where("loose and all_loose" if to_archive else "loose"), used.where("not all_loose")
    wanted = first.select("level", "key", F.lit(True).alias("_loose")).unionByName(rest.select("level", "key", F.lit(False).alias("_loose")))
    copies = _copies(scan, sha256_first).withColumn("_loose", F.col("archive_type").isNull())
    copies = materialize(may_have(copies, wanted, "level", "key", "_loose"), "copies")
    loose = copies.where("_loose").groupBy("level", "key").agg(F.min(F.struct("path", "archive_path")).alias("m"))
    none = F.lit(None).cast("string").alias("archive_type")
    first = first.join(loose, ["level", "key"]).select(*GAME, "rom_ord", "n_roms", "m.path", "m.archive_path", "rom_name", none, F.when(F.col("all_loose"), "loose").otherwise("mixed").alias("choice"))
    rest, packed = rest.select(*GAME, "rom_ord", "n_roms", "rom_name", "level", "key"), copies.where("not _loose").drop("_loose")
    if to_archive:
        spread = packed.groupBy("level", "key").agg(F.count_distinct("path").alias("n_archives"))
        rarest = rest.join(spread, ["level", "key"]).groupBy(*GAME).agg(F.min(F.struct("n_archives", "level", "key")).alias("r")).select(*GAME, "r.level", "r.key")
        looked = materialize(rarest.join(packed.select("level", "key", "path").distinct(), ["level", "key"]).select(*GAME, "path"), "looked")
        made = materialize(rest.join(looked, GAME).join(packed, ["level", "key", "path"]), "in-archives")
        made = made.join(cover(made), [*GAME, "path"], "left_semi")
    else:
        made = rest.join(packed, ["level", "key"])
    return first.unionByName(made.select(*GAME, "rom_ord", "n_roms", "path", "archive_path", "rom_name", "archive_type", F.lit("archive" if to_archive else "mixed").alias("choice")))


def present_games(games: DataFrame, matched: DataFrame) -> DataFrame:
    return games.join(complete_games(matched), GAME, "left_semi")
