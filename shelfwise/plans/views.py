"""Catalog and scan views over the driver's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import spread

#: So many neighbours stay in one task, so that most families do.
RUN = 256

NAME = """concat('Item ', CAST(p_partkey - p_partkey % 4 AS STRING),
    CASE p_partkey % 7 WHEN 0 THEN ' (USA)' WHEN 1 THEN ' (Europe)' WHEN 2 THEN ' (Japan)' WHEN 3 THEN ' (World)'
      WHEN 4 THEN ' (Brazil)' WHEN 5 THEN ' (Germany, France)' ELSE ' (Atlantis)' END,
    CASE p_partkey % 5 WHEN 1 THEN ' (En)' WHEN 2 THEN ' (En,Fr)' WHEN 3 THEN ' (Es,It+En)' WHEN 4 THEN ' (Ja)' ELSE '' END,
    CASE p_partkey % 6 WHEN 1 THEN ' (Rev 1)' WHEN 2 THEN ' (Rev 10)' WHEN 3 THEN ' (Rev B)' WHEN 4 THEN ' (v1.0)' WHEN 5 THEN ' (v1.1, v2.0)' ELSE '' END,
    CASE p_partkey % 11 WHEN 1 THEN ' (Proto)' WHEN 2 THEN ' (Beta 2)' WHEN 3 THEN ' (Demo)' WHEN 4 THEN ' (Sample)' WHEN 5 THEN ' (Rev gz)' ELSE '' END,
    CASE WHEN p_partkey % 37 = 0 THEN ' [b]' ELSE '' END, CASE WHEN p_partkey % 41 = 0 THEN ' [BIOS]' ELSE '' END, CASE WHEN p_partkey % 43 = 0 THEN ' (Unl)' ELSE '' END)"""

#: ord, name, parent (the family's first name, null for itself), release region and language, number and size of files.
GAMES = f"""
named AS (SELECT p_partkey AS ord, p_partkey - p_partkey % 4 AS fam, {NAME} AS name,
  CASE p_partkey % 9 WHEN 0 THEN 'USA' WHEN 1 THEN 'jpn ' WHEN 2 THEN 'XYZ' WHEN 3 THEN 'EUR' END AS rel_region,
  CASE p_partkey % 8 WHEN 0 THEN 'En' WHEN 1 THEN 'Ja,En' WHEN 2 THEN 'fr+de' END AS rel_language,
  1 + CAST(p_partkey % 3 AS INT) AS n_roms, CAST(p_size AS BIGINT) AS base_size, p_partkey % 53 = 0 AS bad_rom FROM part),
games AS (SELECT a.*, b.name AS cloneof FROM named a LEFT JOIN named b ON a.fam = b.ord AND a.ord <> b.ord)"""

#: One row per file of each game, with the digests that catalogs give; some lack sha1, some lack md5 too.
ROMS = """
roms AS (SELECT ord, n_roms, k AS rom_ord, base_size * 1024 + k AS size,
  CASE WHEN ord % 4 <> 1 THEN sha1(concat(CAST(ord AS STRING), '/', CAST(k AS STRING))) END AS sha1,
  CASE WHEN ord % 8 <> 1 THEN md5(concat(CAST(ord AS STRING), '/', CAST(k AS STRING))) END AS md5,
  substr(md5(concat('c', CAST(ord AS STRING), '/', CAST(k AS STRING))), 1, 8) AS crc
  FROM games CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) x WHERE k < n_roms)"""

#: Scanned files from lineitem: what order lines ship of parts, as loose files or entries of zip and tar.gz archives. Of every
#: thirteenth part the files have other contents, so the catalog misses them.
SCAN = """
scan AS (SELECT concat('s', CAST(l_suppkey % 50 AS STRING), '/', CAST(l_orderkey AS STRING), CASE l_linenumber % 3 WHEN 0 THEN '.zip' WHEN 1 THEN '.bin' ELSE '.tar.gz' END) AS path,
  CASE l_linenumber % 3 WHEN 0 THEN 'zip' WHEN 2 THEN 'tar.gz' END AS archive_type,
  CASE WHEN l_linenumber % 3 <> 1 THEN concat('e', CAST(l_partkey AS STRING), '-', CAST(l_linenumber AS STRING)) END AS archive_path,
  CAST(p_size AS BIGINT) * 1024 + l_orderkey % 3 AS size,
  CASE WHEN l_orderkey % 5 <> 0 THEN sha1(concat(CASE WHEN l_partkey % 13 = 0 THEN 'other ' ELSE '' END, CAST(l_partkey AS STRING), '/', CAST(l_orderkey % 3 AS STRING))) ELSE sha1(CAST(l_orderkey AS STRING)) END AS sha1,
  CASE WHEN l_orderkey % 7 <> 0 THEN md5(concat(CASE WHEN l_partkey % 13 = 0 THEN 'other ' ELSE '' END, CAST(l_partkey AS STRING), '/', CAST(l_orderkey % 3 AS STRING))) END AS md5,
  substr(md5(concat(CASE WHEN l_partkey % 13 = 0 THEN 'other ' ELSE 'c' END, CAST(l_partkey AS STRING), '/', CAST(l_orderkey % 3 AS STRING))), 1, 8) AS crc
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog view in the shape that sources.catalog gives. Its rows are few bytes and much work (digests, name patterns, sort
    keys), and a table of a million parts is one split of 5 MB, so they are dealt over tasks before."""
    _tables(spark, sf_dir, "part")
    rows = spark.sql(f"WITH {GAMES} SELECT *, CAST(floor(ord / {RUN}) AS BIGINT) AS run FROM games")
    rows = spread(rows, "run")
    k = F.sequence(F.lit(0).cast("long"), F.col("n_roms").cast("long") - 1)
    ident = lambda i: F.concat(F.col("ord").cast("string"), F.lit("/"), i.cast("string"))
    rom = F.transform(k, lambda i: F.struct(
        F.concat("name", F.lit(" "), i.cast("string"), F.lit(".bin")).alias("name"), (F.col("base_size") * 1024 + i).alias("size"),
        F.substring(F.md5(F.concat(F.lit("c"), ident(i)).cast("binary")), 1, 8).alias("crc"), F.when(F.col("ord") % 8 != 1, F.md5(ident(i).cast("binary"))).alias("md5"),
        F.when(F.col("ord") % 4 != 1, F.sha1(ident(i).cast("binary"))).alias("sha1"), F.lit(None).cast("string").alias("sha256"), F.when(F.col("bad_rom"), "baddump").alias("status"),
    ))
    release = F.when(F.col("rel_region").isNotNull() | F.col("rel_language").isNotNull(), F.array(F.struct(F.col("name").alias("name"), F.col("rel_region").alias("region"), F.col("rel_language").alias("language"))))
    return rows.select(
        F.lit(0).alias("dat_ord"), F.col("ord").alias("game_ord"), "name", F.lit("no").alias("isbios"), "cloneof", F.lit(None).cast("string").alias("romof"),
        release.alias("release"), rom.alias("rom"), F.expr("cast(array() as array<struct<name:string,status:string>>)").alias("disk"),
    )


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    _tables(spark, sf_dir, "part", "lineitem")
    return spark.sql(f"WITH {SCAN} SELECT archive_type, path, archive_path, size AS unheadered_size, crc, md5, sha1, CAST(NULL AS STRING) AS sha256 FROM scan")
