"""Work that must stay dealt, and values that must stay right, when the tables grow."""

import pandas as pd
from pyspark.sql import functions as F

from shelfwise import queries as Q
from shelfwise.operators import matching as M
from shelfwise.plans.execute import run_plan
from shelfwise.sources import listing
from shelfwise.sources.files import list_files, scan
from shelfwise.streaming.completeness import complete_as_seen

ROM = "dat_ord int, game_ord long, name string, rom array<struct<name:string,size:long,crc:string,md5:string,sha1:string,sha256:string,status:string>>"
SPEC = "kind string, from_path string, from_type string, to_path string, to_type string, entries array<struct<from_name:string,to_name:string>>"


def test_sizes_beyond_63_bits(spark, tmp_path):
    keys = [10, 21, 2_999_997, 8_999_990, 54_000_011]
    pd.DataFrame({"o_orderkey": keys}).to_parquet(tmp_path / "orders.parquet")
    got = {r["o_orderkey"]: r["shown"] for r in Q.queries()["byte_size_format"](spark, str(tmp_path)).collect()}
    for k in keys:
        size, unit = k * k * 4 ** (k % 11), 0
        while unit < 6 and size >= 1024 ** (unit + 1):
            unit += 1
        assert got[k] == f"{size / 1024**unit:.2f} {('B', 'KB', 'MB', 'GB', 'TB', 'PB', 'EB')[unit]}"


def test_folders_are_dealt_over_few_partitions(spark, tmp_path):
    for k in range(400):
        (tmp_path / "g" / f"f{k}").mkdir(parents=True)
        (tmp_path / "g" / f"f{k}" / "x").write_bytes(b"1")
    parts = listing.ListingReader([f"file:{tmp_path}"], None, True).partitions()
    assert len(parts) <= listing.PARTITIONS
    assert list_files(spark, [str(tmp_path)]).select("path").distinct().count() == 400


def test_files_of_one_folder_are_scanned_by_many_tasks(spark, tmp_path):
    for k in range(100):
        (tmp_path / f"f{k}").write_bytes(b"%d" % k)
    rows = scan(list_files(spark, [str(tmp_path)])).withColumn("task", F.spark_partition_id())
    assert rows.count() == 100
    assert rows.select("task").distinct().count() > 1


def test_specs_are_run_by_many_tasks(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"1")
    plan = spark.createDataFrame([("copy", str(tmp_path / "a"), None, str(tmp_path / "o" / str(k)), None, []) for k in range(100)], SPEC)
    done = run_plan(plan).withColumn("task", F.spark_partition_id())
    rows = done.collect()
    assert {r["status"] for r in rows} == {"OK"} and len(rows) == 100
    assert len({r["task"] for r in rows}) > 1


def test_games_share_the_state_of_completeness(spark):
    """The keys of the state are ranges of games, not games."""
    roms = M.rom_rows(spark.createDataFrame([(0, g, f"g{g}", [(f"r{g}", 1, None, None, f"s{g}", None, None)]) for g in range(3)], ROM))
    scans = spark.readStream.format("rate").load().selectExpr("cast(null as string) archive_type", "'p' path", "1L unheadered_size", "cast(null as string) crc", "cast(null as string) md5", "concat('s', value) sha1", "cast(null as string) sha256")
    assert "_range" in complete_as_seen(scans, roms)._jdf.queryExecution().logical().toString()


def test_first_sources_shuffle_the_copies_once(spark):
    roms = M.rom_rows(spark.createDataFrame([(0, g, f"g{g}", [(f"r{g}", 1, None, f"m{g}", f"s{g}", None, None)]) for g in range(3)], ROM))
    scans = spark.createDataFrame([("zip", "a", "e", 1, None, "m0", "s9", None), (None, "b", None, 1, None, "m1", "s1", None)], "archive_type string, path string, archive_path string, unheadered_size long, crc string, md5 string, sha1 string, sha256 string")
    found = M.first_sources(roms, scans, keep=["n_roms"])
    assert sorted((r["game_ord"], r["path"], r["level"]) for r in found.collect()) == [(0, "a", 2), (1, "b", 1)]
    logical = found._jdf.queryExecution().analyzed().toString()
    assert logical.count("LogicalRDD") == 2  # the catalog and the scan, each read once
    kept = {tuple(r) for r in M.choose(roms, scans, False).select("game_ord", "path", "choice").collect()}
    assert kept == {tuple(r) for r in M.choose(roms, scans, False, firsts=M.first_sources(roms, scans, keep=["n_roms", "rom_name"])).select("game_ord", "path", "choice").collect()} == {(0, "a", "mixed"), (1, "b", "loose")}


SCAN = "archive_type string, path string, archive_path string, unheadered_size long, crc string, md5 string, sha1 string, sha256 string"


def _rows_written(spark, before):
    """The rows of each scratch table that was written after `before` of them."""
    from shelfwise.functions import tables

    return [spark.read.parquet(path).count() for path in tables._written[before:]]


def test_a_plan_writes_only_the_copies_that_it_uses(spark, tmp_path):
    """Neither the scan nor its keys are written whole: of 4000 scanned files, those of 20 families' best games are."""
    from shelfwise.functions import tables

    spark.range(80).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    lines = spark.range(4000).selectExpr("id * 37 % 80 AS l_partkey", "CAST(floor(id / 4) AS BIGINT) AS l_orderkey", "id % 100 AS l_suppkey", "CAST(id % 4 + 1 AS INT) AS l_linenumber")
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("file_plan_archive_rows", "file_plan_rows"):
        before = len(tables._written)
        assert Q.queries()[name](spark, str(tmp_path)).count() > 0
        written = _rows_written(spark, before)
        assert written and max(written) < 2000, (name, written)


def test_choice_looks_only_at_wanted_copies(spark, monkeypatch):
    """Of 3000 copies that no game needs none is written; with a table of wanted keys that is full the choice is the same."""
    from shelfwise.functions import tables

    rom = lambda n, sha1: (n, 1, None, None, sha1, None, None)
    games = [(0, 0, "loose", [rom("a", "00" * 20), rom("b", "01" * 20)]), (0, 1, "packed", [rom("a", "02" * 20), rom("b", "no digest")]), (0, 2, "half", [rom("a", "00" * 20), rom("b", "ff" * 20)])]
    copies = [(None, f"l{k}", None, 1, None, None, sha1, None) for k, sha1 in enumerate(("00" * 20, "01" * 20, "00" * 20))]
    copies += [("zip", z, e, 1, None, None, sha1, None) for z, e, sha1 in (("z1", "a", "02" * 20), ("z2", "a", "02" * 20), ("z2", "b", "NO DIGEST"))]
    copies += [(("zip", "tar", None)[k % 3], f"o{k}", None if k % 3 == 2 else "e", 1, None, None, f"{k:040x}"[::-1].replace("0", "e"), None) for k in range(3000)]
    roms, scans = M.rom_rows(spark.createDataFrame(games, ROM)), spark.createDataFrame(copies, SCAN)
    pick = lambda to: sorted((r["game_ord"], r["rom_name"], r["path"], r["choice"]) for r in M.choose(roms, scans, to).collect())
    before = len(tables._written)
    packed = pick(True)
    assert packed == [(0, "a", "l0", "loose"), (0, "b", "l1", "loose"), (1, "a", "z2", "archive"), (1, "b", "z2", "archive")]
    assert max(_rows_written(spark, before)) < 1000
    mixed = pick(False)
    assert mixed == [(0, "a", "l0", "loose"), (0, "b", "l1", "loose"), (1, "a", "z1", "mixed"), (1, "a", "z2", "mixed"), (1, "b", "z2", "mixed")]
    monkeypatch.setattr(M, "WORDS", 1)
    assert pick(True) == packed and pick(False) == mixed


def test_keys_of_other_texts_equal_no_digest(spark):
    """Digests are compared as bytes, without case; a text that is none is equal only to itself."""
    digest = "3a" * 20
    games = spark.createDataFrame([(0, g, f"g{g}", [("r", 1, None, None, sha1, None, None)]) for g, sha1 in enumerate((digest, ":" * 20, "abc", "0abc", "3A" * 20, "z" * 40))], ROM)
    scans = spark.createDataFrame([(None, p, None, 1, None, None, sha1, None) for p, sha1 in (("whole", digest.upper()), ("short", "ABC"), ("long", "Z" * 40))], SCAN)
    found = {r["game_ord"]: r["path"] for r in M.match_roms(M.rom_rows(games), scans).collect()}
    assert found == {0: "whole", 2: "short", 4: "whole", 5: "long"}
