"""File plans: what to copy, extract, compress or re-archive for the selected games."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FileOutput
from ..functions.files import output_dir
from ..operators.matching import GAME

ENTRIES = "array<struct<from_name:string,to_name:string>>"
#: Names with a part `..` would lead out of the output folder (or, in an archive, out of where it is unpacked).
LEAVES = r"(^|[/\\])\.\.([/\\]|$)"


def plan_files(best: DataFrame, chosen: DataFrame, out: FileOutput) -> DataFrame:
    """kind (copy, extract, compress, archive_copy), from_path, from_type, to_path, to_type, entries (from_name, to_name), owner (the
    game) and refused: why a spec must not run, null if it may.

    best: selected games (dat_ord, game_ord, name, rom); chosen: their matches. Without an output archive, loose files are
    copied one by one and each source archive is extracted once; with one, each source archive is copied into it and all
    loose files of a game are compressed together. Of an archive's entry only the first target counts.
    """
    games = best.select(*GAME, F.col("name").alias("game"), F.size("rom").alias("_n"))
    rows = chosen.join(games, GAME).withColumn("folder", F.concat_ws("/", F.lit(out.output_dir or "."), F.nullif(output_dir(F.col("game"), F.col("_n"), out.alphabetic, out.force_subfolder), F.lit(""))))
    owner = F.struct(*GAME).alias("owner")
    rows = rows.withColumn("_leaves", F.col("rom_name").rlike(LEAVES) | F.col("game").rlike(LEAVES))
    refused = F.when(F.max("_leaves"), "a name leads out of the output folder").alias("refused")
    loose, packed = rows.where(F.col("archive_type").isNull()), rows.where(F.col("archive_type").isNotNull())
    target = F.concat_ws("/", "folder", "rom_name")
    nothing = F.lit(None).cast("string")
    if out.archive_type is None:
        copies = loose.select(F.lit("copy").alias("kind"), F.col("path").alias("from_path"), nothing.alias("from_type"), target.alias("to_path"), nothing.alias("to_type"),
                              F.array(F.struct(F.col("path").alias("from_name"), target.alias("to_name"))).alias("entries"), owner, F.when(F.col("_leaves"), "a name leads out of the output folder").alias("refused"))
        first = packed.groupBy(*GAME, "path", "archive_type", "archive_path").agg(F.min(F.struct("rom_ord", target.alias("to_name"))).alias("m"), F.first("folder").alias("folder"), F.max("_leaves").alias("_leaves"))
        extracts = first.groupBy(*GAME, "path", "archive_type").agg(refused, F.first("folder").alias("folder"), F.sort_array(F.collect_list(F.struct("m.rom_ord", F.col("archive_path").alias("from_name"), "m.to_name"))).alias("e"))
        extracts = extracts.select(F.lit("extract").alias("kind"), F.col("path").alias("from_path"), F.col("archive_type").alias("from_type"), F.col("folder").alias("to_path"), nothing.alias("to_type"),
                                   F.transform("e", lambda x: F.struct(x["from_name"].alias("from_name"), x["to_name"].alias("to_name"))).alias("entries"), owner, "refused")
        return copies.unionByName(extracts)
    to = F.concat(F.concat_ws("/", "folder", "game"), F.lit(f".{out.archive_type}"))
    first = packed.groupBy(*GAME, "path", "archive_type", "archive_path").agg(F.min(F.struct("rom_ord", F.col("rom_name").alias("to_name"))).alias("m"), F.first(to).alias("to_path"), F.max("_leaves").alias("_leaves"))
    moved = first.groupBy(*GAME, "path", "archive_type", "to_path").agg(refused, F.sort_array(F.collect_list(F.struct("m.rom_ord", F.col("archive_path").alias("from_name"), "m.to_name"))).alias("e"))
    moved = moved.select(F.lit("archive_copy").alias("kind"), F.col("path").alias("from_path"), F.col("archive_type").alias("from_type"), "to_path", F.lit(out.archive_type).alias("to_type"),
                         F.transform("e", lambda x: F.struct(x["from_name"].alias("from_name"), x["to_name"].alias("to_name"))).alias("entries"), owner, "refused")
    packs = loose.withColumn("to_path", to).groupBy(*GAME, "to_path").agg(refused, F.sort_array(F.collect_set(F.struct("rom_ord", F.col("path").alias("from_name"), F.col("rom_name").alias("to_name")))).alias("e"))
    packs = packs.select(F.lit("compress").alias("kind"), nothing.alias("from_path"), nothing.alias("from_type"), "to_path", F.lit(out.archive_type).alias("to_type"),
                         F.transform("e", lambda x: F.struct(x["from_name"].alias("from_name"), x["to_name"].alias("to_name"))).alias("entries"), owner, "refused")
    return moved.unionByName(packs)
