"""Queries of the catalog engine over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import FileOutput, Filter, PostFilter, Preference
from .functions import files as FF
from .functions import names as N
from .functions.regions import DEFAULT
from .functions.tables import materialize
from .operators import derive as D
from .operators import filters as W
from .operators import matching as M
from .operators import ranking as R
from .operators.headers import DataTest, Detector, Rule
from .plans import views
from .plans.files import plan_files
from .plans.selection import rebuild_names
from .sources.files import size_bounds, worth_reading

PREFERENCE = Preference(regions=("USA", "EUR", "JPN"), languages=("en", "fr"))
VARIANTS = {
    "rank_default": PREFERENCE,
    "rank_prioritize_languages": Preference(regions=("USA", "EUR", "JPN"), languages=("ja", "en", "fr"), prioritize_languages=True),
    "rank_early": Preference(regions=("EUR",), early_versions=True, early_revisions=True, early_prereleases=True),
    "rank_prefer_parents": Preference(regions=("JPN", "USA"), prefer_parents=True),
    "rank_prefer_prereleases": Preference(languages=("en",), prefer_prereleases=True),
    "rank_prefer_avoid": Preference(prefers=(r"(?i)rev", N.quote("(World)")), avoids=(r"Beta", r"\(Unl\)")),
}
#: A list of ten thousand literals and a few expressions.
MANY_PATTERNS = (*(N.quote(f"Item {12 * k} (") for k in range(10_000)), r"(?i)item \d*7\d* .*\(JAPAN\)", r"^Item 4\d+ \(Wor(?:ld|k)\) \(en", r"\(v1\.0\)$|\[b\]")
FILTERED = Filter(include_regions=("USA", "EUR"), allow_bios=False, allow_proto=False, allow_beta=False, excludes=(N.BUILT_IN["bad"], N.BUILT_IN["unlicensed"]))


def _joined(*cols: str):
    return [F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in cols]


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return D.derive(views.games(spark, d))


def _ord() -> list:
    return [F.col("game_ord").alias("ord")]


def _filtered(f: Filter):
    return lambda s, d: W.apply_filter(_parsed(s, d), f).select(*_ord(), "name")


def _ranked(p: Preference):
    return lambda s, d: R.rank(_parsed(s, d), p).select(*_ord(), "parent_name", F.col("rank").cast("long").alias("rank"))


def _huge_family(s: SparkSession, d: str) -> DataFrame:
    """Ranks where one family has a third of all games."""
    games = _parsed(s, d).withColumn("parent_name", F.when(F.col("game_ord") % 3 == 0, "huge").otherwise(F.col("parent_name")))
    games = games.drop("release", "rom", "disk")  # what ranks do not need is not sorted and written
    return R.rank_by_ranges(games, PREFERENCE).select(*_ord(), "parent_name", F.col("rank").cast("long").alias("rank"))


def _documents(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet")


def _matches(s: SparkSession, d: str) -> DataFrame:
    return M.match_roms(M.rom_rows(views.games(s, d)), views.scan(s, d))


def _levels(s: SparkSession, d: str) -> DataFrame:
    return M.match_levels(M.rom_rows(views.games(s, d)), views.scan(s, d), keep=["n_roms"])


def _match_columns(df: DataFrame) -> DataFrame:
    return df.select(*_ord(), F.col("rom_ord").cast("long").alias("rom_ord"), "path", "archive_type", "archive_path", F.col("match_ord").cast("long").alias("match_ord"))


def _size_bounds(s: SparkSession, d: str) -> DataFrame:
    lo, hi = size_bounds(M.rom_rows(views.games(s, d)), [])
    return s.range(1).select(F.lit(lo).cast("long").alias("min_size"), F.lit(hi).cast("long").alias("max_size"))


#: A header of 512 bytes, so files may be so much longer than the catalog says.
HEADERED = Detector("headered", (Rule(0x200, tests=(DataTest(0, b"HEAD"),)),))


def _size_pruned(s: SparkSession, d: str) -> DataFrame:
    """What a scan for the catalog would open of files named and sized after order lines."""
    li = s.read.parquet(f"{d}/lineitem.parquet")
    ends = F.element_at(F.array(*map(F.lit, (".bin", ".zip", ".rom"))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    files = li.select(F.concat(F.lit("f"), F.col("l_orderkey").cast("string"), ends).alias("path"), ((F.col("l_orderkey") * 997 + F.col("l_partkey")) % 131072).alias("length"))
    kept = worth_reading(files, size_bounds(M.rom_rows(views.games(s, d)), [HEADERED]))
    return kept.groupBy(FF.archive_type(F.col("path")).alias("archive_type")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").cast("long").alias("bytes"))


def _present_best(s: SparkSession, d: str) -> DataFrame:
    games = _parsed(s, d)
    return R.pick_best(M.present_games(games, _levels(s, d)), PREFERENCE).select(*_ord(), "parent_name", "name")


def _plan(s: SparkSession, d: str, out: FileOutput) -> DataFrame:
    scanned, games = views.scan(s, d), views.games(s, d)  # the scan is read twice and not written: its digests are longer than the table
    firsts = materialize(M.first_levels(M.rom_rows(games), scanned), "firsts")  # one look at the scan's keys, for both steps
    named = D.derive(games).withColumn("rom", F.transform("rom", lambda r: r["name"]))  # a plan needs no more of a file
    best = materialize(R.pick_best(M.present_games(named, firsts), PREFERENCE).select(*M.GAME, "name", "rom"), "best")
    roms = best.select(*M.GAME, F.posexplode("rom").alias("rom_ord", "rom_name"))
    return plan_files(best, M.choose(roms, scanned, out.archive_type is not None, firsts=firsts), out)


def _plan_kinds(archive: str | None):
    def run(s: SparkSession, d: str) -> DataFrame:
        plan = _plan(s, d, FileOutput("out", archive_type=archive))
        return plan.groupBy("kind", "from_type", "to_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("entries")).cast("long").alias("n_entries"))

    return run


def _plan_paths(s: SparkSession, d: str) -> DataFrame:
    g = _parsed(s, d)
    return g.select(*_ord(), FF.output_dir(F.col("name"), F.size("rom"), True, False).alias("folder"))


def _sizes(s: SparkSession, d: str) -> DataFrame:
    o = s.read.parquet(f"{d}/orders.parquet")
    size = F.col("o_orderkey") * F.col("o_orderkey") * F.pow(F.lit(4.0), F.col("o_orderkey") % 11)  # whole numbers, also beyond 63 bits
    return o.select("o_orderkey", FF.format_size(size).alias("shown"), FF.format_size(size, True).alias("fixed"))


def _parse_sizes(s: SparkSession, d: str) -> DataFrame:
    o = s.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey")
    text = F.concat((k % 97).cast("string"), F.when(k % 2 == 0, F.concat(F.lit("."), (k % 4 * 25).cast("string"))).otherwise(""), F.element_at(F.array(*map(F.lit, (" KB", "m", "", "Gb", " tb", "x", "B"))), (k % 7 + 1).cast("int")))
    return o.select("o_orderkey", F.coalesce(FF.parse_size(text), F.lit(-1)).alias("bytes"))


def _archive_types(s: SparkSession, d: str) -> DataFrame:
    li = s.read.parquet(f"{d}/lineitem.parquet")
    ends = (".zip", ".RAR", ".7z", ".tar.7z", ".tar", ".tbz", ".tgz", ".tar.lz4", ".tar.lzma", ".TXZ", ".bin", ".zip.txt", ".taz", ".gz")
    path = F.concat(F.lit("f"), F.col("l_orderkey").cast("string"), F.element_at(F.array(*map(F.lit, ends)), ((F.col("l_orderkey") + F.col("l_linenumber")) % len(ends) + 1).cast("int")))
    kinds = li.select(path.alias("path")).select(FF.archive_type(F.col("path")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return kinds.select("kind", FF.archive_ordinal(F.col("kind")).alias("place"), "n")


def queries() -> dict:
    exclude = lambda **k: _filtered(Filter(**k))
    out = {
        "select_best": lambda s, d: R.pick_best(_parsed(s, d), PREFERENCE).select(*_ord(), "parent_name", "name"),
        "select_best_filtered": lambda s, d: R.pick_best(W.post_filter(W.apply_filter(_parsed(s, d), FILTERED), PostFilter((r"\(Rev gz\)",))), PREFERENCE).select(*_ord(), "parent_name", "name"),
        "catalog_sections": lambda s, d: views.games(s, d).select(*_ord(), F.array_join(N.section_tokens(F.col("name")), "|").alias("tokens")),
        "catalog_regions": lambda s, d: _parsed(s, d).select(*_ord(), *_joined("regions_detected", "regions")),
        "catalog_regions_provided": lambda s, d: _parsed(s, d).select(*_ord(), *_joined("regions_provided")),
        "catalog_languages": lambda s, d: _parsed(s, d).select(*_ord(), *_joined("languages_detected", "languages_provided", "languages")),
        "effective_languages": lambda s, d: _parsed(s, d).select(*_ord(), *_joined("eff_languages")),
        "catalog_revision": lambda s, d: _parsed(s, d).select(*_ord(), *_joined("revision")),
        "catalog_version": lambda s, d: _parsed(s, d).select(*_ord(), *_joined("version")),
        "catalog_prerelease": lambda s, d: _parsed(s, d).select(*_ord(), *_joined("proto", "beta", "demo", "sample"), "is_prerelease"),
        "catalog_flags": lambda s, d: _parsed(s, d).select(*_ord(), "is_bios", "is_parent", "is_bad", "parent_name"),
        "region_divergence": lambda s, d: _parsed(s, d).select(*_ord(), *(D.divergence(F.col("regions_detected"), F.col("regions_provided"), m).alias(m) for m in D.DIVERGENCE)),
        "language_divergence": lambda s, d: _parsed(s, d).select(*_ord(), *(D.divergence(F.col("languages_detected"), F.col("languages_provided"), m).alias(m) for m in D.DIVERGENCE)),
        "filter_bios": exclude(allow_bios=False),
        "filter_proto": exclude(allow_proto=False),
        "filter_beta": exclude(allow_beta=False),
        "filter_demo": exclude(allow_demo=False),
        "filter_sample": exclude(allow_sample=False),
        "filter_include_regions": exclude(include_regions=("USA", "BRA")),
        "filter_include_languages": exclude(include_languages=("fr", "ja")),
        "filter_exclude_regions": exclude(exclude_regions=("EUR",)),
        "filter_exclude_languages": exclude(exclude_languages=("es", "pt")),
        "filter_name_regex": exclude(excludes=(r"Rev 1", N.quote("(Demo)")), includes=(r"Item \d*4 ",)),
        "filter_many_patterns": exclude(excludes=MANY_PATTERNS, includes=(r"\(Rev B\)",)),
        "rank_huge_family": _huge_family,
        "rank_many_patterns": _ranked(Preference(regions=("USA",), prefers=MANY_PATTERNS)),
        "filter_builtin_patterns": exclude(excludes=tuple(N.BUILT_IN.values())),
        "post_filter_families": lambda s, d: W.post_filter(_parsed(s, d), PostFilter((r"\(Beta 2\)",))).select(*_ord(), "parent_name"),
        "family_sizes": lambda s, d: _parsed(s, d).groupBy("parent_name").agg(F.count(F.lit(1)).alias("n"), F.min("game_ord").alias("first_ord")),
        "catalog_validation": lambda s, d: W.validity(_parsed(s, d)).select("n_games", "n_parents"),
        "size_bounds": _size_bounds,
        "size_pruned_scan": _size_pruned,
        "digests_documents": lambda s, d: _documents(s, d).select("doc_id", *(c.alias(k) for k, c in FF.digests(F.col("text").cast("binary")).items() if k != "crc")),
        "digests_crc": lambda s, d: _documents(s, d).select("doc_id", FF.digests(F.col("text").cast("binary"))["crc"].alias("crc")),
        "archive_type_of_path": _archive_types,
        "byte_size_format": _sizes,
        "byte_size_parse": _parse_sizes,
        "match_cascade": lambda s, d: _match_columns(M.match_order(_matches(s, d))),
        "match_first_source": lambda s, d: _match_columns(M.first_sources(M.rom_rows(views.games(s, d)), views.scan(s, d), keep=[]).withColumn("match_ord", F.lit(1))),
        "games_complete": lambda s, d: M.complete_games(_levels(s, d)).select(*_ord()),
        "games_missing": lambda s, d: views.games(s, d).join(M.complete_games(_levels(s, d)), M.GAME, "left_anti").select(*_ord(), "name"),
        "single_archive_cover": lambda s, d: M.cover(_matches(s, d).where("archive_type is not null")).select(*_ord(), "path"),
        "present_best": _present_best,
        "file_plan_kinds": _plan_kinds(None),
        "file_plan_archive": _plan_kinds("zip"),
        "file_plan_paths": _plan_paths,
        "union_catalogs": lambda s, d: _union(s, d),
        "name_order": lambda s, d: rebuild_names(R.pick_best(_parsed(s, d), PREFERENCE)),
        "comma_lists": lambda s, d: _comma_lists(s, d),
        "hex_text": lambda s, d: _documents(s, d).select("doc_id", *_hex_digests(FF.spaced_hex(F.col("text").cast("binary")))),
    }
    from . import file_queries

    return out | {k: _ranked(p) for k, p in VARIANTS.items()} | file_queries.queries()


def _hex_digests(spaced) -> list:
    return [F.md5(spaced).alias("spaced_md5"), F.md5(FF.from_spaced_hex(spaced)).alias("back_md5")]


def _union(s: SparkSession, d: str) -> DataFrame:
    one = views.games(s, d)
    other = one.withColumn("dat_ord", F.lit(1)).withColumn("cloneof", F.coalesce("cloneof", "name"))  # all of families of the first
    both = one.unionByName(other.withColumn("name", F.concat("name", F.when(F.col("game_ord") % 2 == 1, " (Rev 2)").otherwise(""))))
    return R.pick_best(D.derive(both), PREFERENCE).select(F.col("dat_ord").cast("long").alias("dat_ord"), *_ord(), "parent_name")


def _comma_lists(s: SparkSession, d: str) -> DataFrame:
    p = s.read.parquet(f"{d}/part.parquet")
    items = FF.comma_list(F.concat_ws(" , ", F.col("p_brand"), F.lit(""), F.col("p_type")))
    return p.select("p_partkey", FF.joined_list(items).alias("lower"), FF.joined_list(items, True).alias("capital"))


# ---- the same in DuckDB SQL

def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(map(_quoted, xs)) + "]::VARCHAR[]"


_REG = "[" + ", ".join(f"{{'code': {_quoted(r.code)}, 'rx': {_quoted('(?:' + r.pattern + ')')}}}" for r in DEFAULT) + "]"
_LANGS = "map {" + ", ".join(f"{_quoted(r.code)}: {_list(r.languages)}" for r in DEFAULT) + "}"


def _ordered_set(x: str) -> str:
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


def _num(group: str) -> str:
    core = rf"regexp_replace({group}, '\.+$', '')"
    fold = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(lower(p), ''), lambda c: ascii(c)::BIGINT)), lambda a, c: a * 16 + c)"
    one = f"CASE WHEN p = '' THEN 0 WHEN regexp_matches(p, '^[a-fA-F0-9]+$') THEN ('0x' || p)::BIGINT ELSE {fold} END"
    return f"CASE WHEN {group} <> '' AND {core} = '' THEN []::BIGINT[] ELSE list_transform(string_split({core}, '.'), lambda p: {one}) END"


def _numbers_sql(rx: str, groups: int = 1) -> str:
    rx = _quoted(rx)
    out = _num(f"regexp_extract(name, {rx}, 1)")
    for g in range(2, groups + 1):
        e = f"regexp_extract(name, {rx}, {g})"
        out = f"list_concat({out}, CASE WHEN {e} <> '' THEN {_num(e)} ELSE []::BIGINT[] END)"
    return f"CASE WHEN regexp_matches(name, {rx}) THEN {out} ELSE []::BIGINT[] END"


def _sql(text: str) -> str:
    return text.replace("AS STRING", "AS VARCHAR")


_GAMES = _sql(views.GAMES)
_PARSED = rf"""WITH {_GAMES},
tok AS (SELECT *, list_transform(flatten(list_transform(regexp_extract_all(name, {_quoted(N.SECTIONS)}, 1), lambda s: string_split(s, ','))), lambda t: trim(t)) AS tokens FROM games),
raw AS (SELECT *, flatten(list_transform(tokens, lambda t: list_transform(list_filter({_REG}, lambda r: regexp_full_match(t, r.rx)), lambda r: r.code)))::VARCHAR[] AS det,
  (CASE WHEN rel_region IS NULL THEN [] ELSE [upper(trim(rel_region))] END)::VARCHAR[] AS regions_provided,
  flatten(list_transform(regexp_extract_all(name, {_quoted(N.LANGUAGES)}, 1), lambda s: regexp_split_to_array(lower(s), '[,+]')))::VARCHAR[] AS ldet,
  (CASE WHEN rel_language IS NULL THEN [] ELSE list_transform(regexp_split_to_array(rel_language, '[,+]'), lambda x: lower(trim(x))) END)::VARCHAR[] AS languages_provided,
  {", ".join(f"{_numbers_sql(rx, g)} AS {c}" for c, rx, g in (("proto", N.PROTO, 1), ("beta", N.BETA, 1), ("demo", N.DEMO, 1), ("sample", N.SAMPLE, 1), ("revision", N.REVISION, 1), ("version", N.VERSION, 2)))},
  contains(lower(name), '[bios]') AS is_bios, cloneof IS NULL AS is_parent, contains(lower(name), '[b]') OR bad_rom AS is_bad, coalesce(cloneof, name) AS parent_name FROM tok),
sets AS (SELECT * EXCLUDE (det, ldet), {_ordered_set("det")} AS regions_detected, {_ordered_set("ldet")} AS languages_detected FROM raw),
unions AS (SELECT *, {_ordered_set("list_concat(regions_detected, regions_provided)")} AS regions, {_ordered_set("list_concat(languages_detected, languages_provided)")} AS languages FROM sets),
parsed AS (SELECT *, CASE WHEN len(languages) > 0 THEN languages ELSE flatten(list_transform(regions, lambda r: coalesce({_LANGS}[r], []::VARCHAR[]))) END AS eff_languages,
  len(proto) + len(beta) + len(demo) + len(sample) > 0 AS is_prerelease FROM unions)
"""


#: The games of two catalogs: the second one's entries are later revisions of the first one's, all of families of the first.
_TWO = _GAMES.replace("games AS (", "first AS (", 1) + """,
games AS (SELECT 0::BIGINT AS dat_ord, * FROM first
  UNION ALL SELECT 1, * REPLACE (name || CASE WHEN ord % 2 = 1 THEN ' (Rev 2)' ELSE '' END AS name, coalesce(cloneof, name) AS cloneof) FROM first)"""


def _join_sql(*cols: str) -> str:
    return ", ".join(f"array_to_string({c}, ',') AS {c}" for c in cols)


def _divergence_sql(kind: str) -> str:
    d, p = f"{kind}_detected", f"{kind}_provided"
    miss, extra, both = f"NOT list_has_all({p}, {d})", f"NOT list_has_all({d}, {p})", f"(len({d}) > 0 AND len({p}) > 0)"
    return f"SELECT ord, false AS ignore, {both} AND {miss} AS one_way, {both} AND ({miss} OR {extra}) AS two_way, {miss} OR {extra} AS always FROM parsed"


def _rank_sql(p: Preference) -> str:
    def index(col: str, order) -> str:
        return f"coalesce(list_min(list_filter(list_transform({col}, lambda x: list_position({_list(order)}, x)), lambda i: i > 0)), 2147483647)"

    def found(patterns) -> str:
        return " + ".join(["0", *(f"CAST(regexp_matches(name, {_quoted(x)}) AS INT)" for x in patterns)])

    late = lambda c, early: c if early else f"{c} DESC"
    region, language = index("regions", p.regions), index("eff_languages", p.languages)
    keys = ["is_bad", *["is_prerelease DESC"] * p.prefer_prereleases, found(p.avoids), *([language, region] if p.prioritize_languages else [region, language]), *["is_parent DESC"] * p.prefer_parents]
    keys += [f"({found(p.prefers)}) DESC", late("revision", p.early_revisions), late("version", p.early_versions), "is_prerelease", *(late(c, p.early_prereleases) for c in ("sample", "demo", "beta", "proto"))]
    keys += [f"len(list_intersect(list_distinct(eff_languages), {_list(p.languages)})) DESC", "len(list_distinct(eff_languages)) DESC", "is_parent DESC"]
    return ", ".join(f"({k[:-5]}) DESC" if k.endswith(" DESC") else f"({k})" for k in keys)


_MANY = r"(CASE WHEN regexp_extract(name, '^Item (\d+) \(', 1)::BIGINT % 12 = 0 AND regexp_extract(name, '^Item (\d+) \(', 1)::BIGINT < 120000 THEN 1 ELSE 0 END + regexp_matches(name, '(?i)item \d*7\d* .*\(JAPAN\)')::INT + regexp_matches(name, '^Item 4\d+ \(Wor(?:ld|k)\) \(en')::INT + regexp_matches(name, '\(v1\.0\)$|\[b\]')::INT)"
_NAME_ORDER = r"regexp_replace(lower(translate(name, '(),[].', chr(18) || chr(19) || chr(2) || chr(20) || chr(21) || chr(9))), '[\s\-]', '', 'g'), lower(name)"
_BEST = f"row_number() OVER (PARTITION BY parent_name ORDER BY {_rank_sql(PREFERENCE)}, ord)"
_MATCHES = f"""{{}}, {_sql(views.ROMS)}, {_sql(views.SCAN)},
k1 AS (SELECT DISTINCT sha1 FROM scan), k2 AS (SELECT DISTINCT md5 FROM scan WHERE md5 IS NOT NULL),
keyed AS (SELECT r.*, CASE WHEN k1.sha1 IS NOT NULL THEN 1 WHEN k2.md5 IS NOT NULL THEN 2 ELSE 3 END AS level FROM roms r LEFT JOIN k1 ON r.sha1 = k1.sha1 LEFT JOIN k2 ON r.md5 = k2.md5),
hits AS (SELECT k.ord, k.rom_ord, k.n_roms, s.path, s.archive_type, s.archive_path FROM keyed k JOIN scan s ON level = 1 AND k.sha1 = s.sha1
  UNION ALL SELECT k.ord, k.rom_ord, k.n_roms, s.path, s.archive_type, s.archive_path FROM keyed k JOIN scan s ON level = 2 AND k.md5 = s.md5
  UNION ALL SELECT k.ord, k.rom_ord, k.n_roms, s.path, s.archive_type, s.archive_path FROM keyed k JOIN scan s ON level = 3 AND k.size = s.size AND k.crc = s.crc),
matches AS (SELECT *, row_number() OVER (PARTITION BY ord, rom_ord ORDER BY CASE WHEN archive_type IS NULL THEN 0 WHEN archive_type = 'zip' THEN 1 ELSE 2 END, path, archive_path NULLS FIRST) AS match_ord FROM hits),
complete AS (SELECT ord FROM matches GROUP BY ord HAVING count(DISTINCT rom_ord) = any_value(n_roms)),
cover AS (SELECT ord, path FROM (SELECT ord, path, count(*) AS n, min({{{{'r': rom_ord, 'm': match_ord}}}}) AS seen FROM matches WHERE archive_type IS NOT NULL GROUP BY ord, path HAVING count(DISTINCT rom_ord) = any_value(n_roms))
  QUALIFY row_number() OVER (PARTITION BY ord ORDER BY n DESC, seen) = 1)
"""
_ONLY_GAMES = _MATCHES.format(f"WITH {_GAMES}")
_WITH_PARSED = _MATCHES.format(_PARSED)
_CHOSEN = f"""{_WITH_PARSED},
best AS (SELECT * FROM (SELECT p.* FROM parsed p JOIN complete USING (ord)) QUALIFY {_BEST} = 1),
loose AS (SELECT * FROM matches JOIN complete USING (ord) WHERE archive_type IS NULL QUALIFY row_number() OVER (PARTITION BY ord, rom_ord ORDER BY match_ord) = 1),
all_loose AS (SELECT ord FROM loose GROUP BY ord HAVING count(*) = any_value(n_roms))
"""


def oracle_sql() -> dict[str, str]:
    where = lambda cond: f"{_PARSED} SELECT ord, name FROM parsed WHERE {cond}"
    has = lambda p: f"regexp_matches(name, {_quoted(p)})"
    cols = lambda *c: f"{_PARSED} SELECT ord, {_join_sql(*c)} FROM parsed"
    f = f"list_has_any(regions, {_list(FILTERED.include_regions)}) AND NOT is_bios AND len(proto) = 0 AND len(beta) = 0 AND NOT ({' OR '.join(map(has, FILTERED.excludes))})"
    ends = ("zip", "rar", "7z", "", "tar", "tar.bz2", "tar.gz", "tar.lz4", "tar.lzma", "tar.xz", "", "", "tar.gz", "")
    place = {"": -1} | {a: i for i, (a, _, _) in enumerate(FF.ARCHIVES)}
    size = "CAST(o_orderkey * o_orderkey * pow(4.0, o_orderkey % 11) AS BIGINT)"
    unit = f"CASE {' '.join(f'WHEN {size} >= {1024**i} THEN {i}' for i in range(6, 0, -1))} ELSE 0 END"
    shown = f"{size} / pow(1024.0, {unit})"
    symbols = f"({_list(FF.UNITS)})"
    out = {
        "select_best": f"{_PARSED} SELECT ord, parent_name, name FROM parsed QUALIFY {_BEST} = 1",
        "select_best_filtered": f"{_PARSED}, kept AS (SELECT * FROM parsed WHERE {f}), fine AS (SELECT * FROM kept WHERE parent_name NOT IN (SELECT parent_name FROM kept WHERE regexp_matches(name, '\\(Rev gz\\)'))) SELECT ord, parent_name, name FROM fine QUALIFY {_BEST} = 1",
        "catalog_sections": f"{_PARSED} SELECT ord, array_to_string(tokens, '|') AS tokens FROM parsed",
        "catalog_regions": cols("regions_detected", "regions"),
        "catalog_regions_provided": cols("regions_provided"),
        "catalog_languages": cols("languages_detected", "languages_provided", "languages"),
        "effective_languages": cols("eff_languages"),
        "catalog_revision": cols("revision"),
        "catalog_version": cols("version"),
        "catalog_prerelease": f"{_PARSED} SELECT ord, {_join_sql('proto', 'beta', 'demo', 'sample')}, is_prerelease FROM parsed",
        "catalog_flags": f"{_PARSED} SELECT ord, is_bios, is_parent, is_bad, parent_name FROM parsed",
        "region_divergence": f"{_PARSED} {_divergence_sql('regions')}",
        "language_divergence": f"{_PARSED} {_divergence_sql('languages')}",
        "filter_bios": where("NOT is_bios"),
        **{f"filter_{c}": where(f"len({c}) = 0") for c in ("proto", "beta", "demo", "sample")},
        "filter_include_regions": where("list_has_any(regions, ['USA', 'BRA'])"),
        "filter_include_languages": where("list_has_any(eff_languages, ['fr', 'ja'])"),
        "filter_exclude_regions": where("NOT list_has_any(regions, ['EUR'])"),
        "filter_exclude_languages": where("NOT list_has_any(eff_languages, ['es', 'pt'])"),
        "filter_name_regex": where(r"NOT (contains(name, 'Rev 1') OR contains(name, '(Demo)')) OR regexp_matches(name, 'Item \d*4 ')"),
        "filter_many_patterns": where(f"NOT ({_MANY} > 0) OR contains(name, '(Rev B)')"),
        "rank_huge_family": f"{_PARSED}, h AS (SELECT * REPLACE (CASE WHEN ord % 3 = 0 THEN 'huge' ELSE parent_name END AS parent_name) FROM parsed) SELECT ord, parent_name, row_number() OVER (PARTITION BY parent_name ORDER BY {_rank_sql(PREFERENCE)}, ord) AS rank FROM h",
        "rank_many_patterns": f"{_PARSED} SELECT ord, parent_name, row_number() OVER (PARTITION BY parent_name ORDER BY {_rank_sql(Preference(regions=('USA',))).replace('((0)) DESC', f'({_MANY}) DESC', 1)}, ord) AS rank FROM parsed",
        "filter_builtin_patterns": where("NOT (" + " OR ".join(map(has, N.BUILT_IN.values())) + ")"),
        "post_filter_families": f"{_PARSED} SELECT ord, parent_name FROM parsed WHERE parent_name NOT IN (SELECT parent_name FROM parsed WHERE contains(name, '(Beta 2)'))",
        "family_sizes": f"{_PARSED} SELECT parent_name, count(*) AS n, min(ord) AS first_ord FROM parsed GROUP BY 1",
        "catalog_validation": f"{_PARSED} SELECT count(*) AS n_games, count(*) FILTER (is_parent) AS n_parents FROM parsed",
        "size_bounds": f"WITH {_GAMES}, {_sql(views.ROMS)} SELECT min(size) AS min_size, max(size) AS max_size FROM roms",
        "size_pruned_scan": f"""WITH {_GAMES}, {_sql(views.ROMS)}, b AS (SELECT min(size) AS lo, max(size) + 512 AS hi FROM roms),
f AS (SELECT l_linenumber % 3 = 1 AS zip, (l_orderkey * 997 + l_partkey) % 131072 AS length FROM lineitem)
SELECT CASE WHEN zip THEN 'zip' END AS archive_type, count(*) AS n, CAST(sum(length) AS BIGINT) AS bytes FROM f, b WHERE zip OR length BETWEEN lo AND hi GROUP BY 1""",
        "digests_documents": "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents",
        "digests_crc": """WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
b AS (SELECT doc_id, t, list_transform(regexp_extract_all(hex(text), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents, t)
SELECT doc_id, lpad(lower(hex(xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295))), 8, '0') AS crc FROM b""",
        "archive_type_of_path": f"SELECT nullif(({_list(ends)})[k + 1], '') AS kind, CAST(list_value({', '.join(str(place[e]) for e in ends)})[k + 1] AS INTEGER) AS place, count(*) AS n FROM (SELECT (l_orderkey + l_linenumber) % {len(ends)} AS k FROM lineitem) GROUP BY ALL",
        "byte_size_format": f"SELECT o_orderkey, printf('%.2f %s', {shown}, {symbols}[{unit} + 1]) AS shown, printf('%7.2f %2s', {shown}, {symbols}[{unit} + 1]) AS fixed FROM orders",
        "byte_size_parse": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 5 THEN CAST(floor(CAST((o_orderkey % 97)::VARCHAR || CASE WHEN o_orderkey % 2 = 0 THEN '.' || (o_orderkey % 4 * 25)::VARCHAR ELSE '' END AS DOUBLE) * [1024.0, 1048576, 1, 1073741824, 1099511627776, 1, 1][o_orderkey % 7 + 1] + 0.5) AS BIGINT) ELSE -1 END AS bytes FROM orders",
        "match_cascade": f"{_ONLY_GAMES} SELECT ord, CAST(rom_ord AS BIGINT) AS rom_ord, path, archive_type, archive_path, match_ord FROM matches",
        "match_first_source": f"{_ONLY_GAMES} SELECT ord, CAST(rom_ord AS BIGINT) AS rom_ord, path, archive_type, archive_path, match_ord FROM matches WHERE match_ord = 1",
        "games_complete": f"{_ONLY_GAMES} SELECT ord FROM complete",
        "games_missing": f"{_ONLY_GAMES} SELECT ord, name FROM games WHERE ord NOT IN (SELECT ord FROM complete)",
        "single_archive_cover": f"{_ONLY_GAMES} SELECT ord, path FROM cover",
        "present_best": f"{_WITH_PARSED} SELECT ord, parent_name, name FROM (SELECT p.* FROM parsed p JOIN complete USING (ord)) QUALIFY {_BEST} = 1",
        "file_plan_kinds": f"""{_CHOSEN}, used AS (SELECT m.* FROM matches m JOIN complete USING (ord) WHERE archive_type IS NOT NULL AND ord NOT IN (SELECT ord FROM all_loose) UNION ALL SELECT * FROM loose),
specs AS (SELECT 'copy' AS kind, NULL AS from_type, 1 AS k FROM used JOIN best USING (ord) WHERE archive_type IS NULL
  UNION ALL SELECT 'extract', any_value(archive_type), count(DISTINCT archive_path) FROM used JOIN best USING (ord) WHERE archive_type IS NOT NULL GROUP BY ord, path)
SELECT kind, from_type, CAST(NULL AS VARCHAR) AS to_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS n_entries FROM specs GROUP BY ALL""",
        "file_plan_archive": f"""{_CHOSEN}, used AS (SELECT m.* FROM matches m JOIN complete USING (ord) JOIN cover USING (ord, path) WHERE archive_type IS NOT NULL AND ord NOT IN (SELECT ord FROM all_loose)
  UNION ALL SELECT * FROM loose WHERE ord IN (SELECT ord FROM all_loose)),
specs AS (SELECT 'compress' AS kind, NULL AS from_type, count(DISTINCT rom_ord) AS k FROM used JOIN best USING (ord) WHERE archive_type IS NULL GROUP BY ord
  UNION ALL SELECT 'archive_copy', any_value(archive_type), count(DISTINCT archive_path) FROM used JOIN best USING (ord) WHERE archive_type IS NOT NULL GROUP BY ord, path)
SELECT kind, from_type, 'zip' AS to_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS n_entries FROM specs GROUP BY ALL""",
        "file_plan_paths": f"{_PARSED} SELECT ord, CASE WHEN n_roms > 1 THEN 'i/' || name ELSE 'i' END AS folder FROM parsed",
        "union_catalogs": f"""{_PARSED.replace(_GAMES, _TWO, 1)}
SELECT dat_ord, ord, parent_name FROM parsed QUALIFY row_number() OVER (PARTITION BY parent_name ORDER BY {_rank_sql(PREFERENCE)}, dat_ord, ord) = 1""",
        "comma_lists": "SELECT p_partkey, lower(p_brand) || ', ' || lower(p_type) AS lower, upper(p_brand[1]) || lower(p_brand[2:]) || ', ' || upper(p_type[1]) || lower(p_type[2:]) AS capital FROM part",
        "hex_text": "SELECT doc_id, md5(regexp_replace(hex(text), '(..)', '\\1 ', 'g')[:-2]) AS spaced_md5, md5(text) AS back_md5 FROM documents",
        "name_order": f"{_PARSED}, b AS (SELECT * FROM parsed QUALIFY {_BEST} = 1) SELECT row_number() OVER (ORDER BY {_NAME_ORDER}, ord) AS place, name FROM b",
    }
    from . import file_queries

    return out | file_queries.oracle_sql() | {k: f"{_PARSED} SELECT ord, parent_name, row_number() OVER (PARTITION BY parent_name ORDER BY {_rank_sql(p)}, ord) AS rank FROM parsed" for k, p in VARIANTS.items()}
