"""Attribute derivation: flags, regions, languages, numbers, family names and divergences, as native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.regions import DEFAULT, Region, codes_of, languages_of


def _or_empty(col: Column, kind: str) -> Column:
    return F.coalesce(col, F.array().cast(kind))


def _languages(text: Column) -> Column:
    return F.transform(F.split(text, "[,+]"), lambda x: F.lower(N.trimmed(x)))


def derive(games: DataFrame, regions: tuple[Region, ...] = DEFAULT) -> DataFrame:
    """games (name, isbios, cloneof, romof, release, rom, disk) with the derived columns.

    Arrays that are null count as empty. Regions are those of name sections, then those of releases, in first-seen order;
    release regions that the table lacks are kept. Without parsed languages those of the regions apply.
    """
    name = F.col("name")
    # fixed field names, so a literal element type does for missing arrays
    release = F.coalesce(F.col("release"), F.filter("release", lambda r: F.lit(False)))
    rel_regions = F.filter(F.transform(F.filter(release, lambda r: F.coalesce(r["region"], F.lit("")) != ""), lambda r: F.upper(N.trimmed(r["region"]))), lambda x: x.isNotNull())
    rel_langs = F.flatten(F.transform(F.filter(release, lambda r: F.coalesce(r["language"], F.lit("")) != ""), lambda r: _languages(r["language"])))
    has_bad = F.coalesce(F.exists("rom", lambda r: r["status"] == "baddump"), F.lit(False)) | F.coalesce(F.exists("disk", lambda d: d["status"] == "baddump"), F.lit(False))
    cloneof, romof = F.coalesce("cloneof", F.lit("")), F.coalesce("romof", F.lit(""))
    out = games.withColumns({
        "is_bios": F.coalesce(F.col("isbios") == "yes", F.lit(False)) | name.rlike(N.BIOS),
        "is_parent": (cloneof == "") & (romof == ""),
        "is_bad": name.rlike(N.BAD) | has_bad,
        "regions_detected": F.array_distinct(F.flatten(F.transform(N.section_tokens(name), lambda t: codes_of(t, regions)))),
        "regions_provided": F.array_distinct(_or_empty(rel_regions, "array<string>")),
        "languages_detected": F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(name, F.lit(N.LANGUAGES), F.lit(1)), lambda s: F.split(F.lower(s), "[,+]")))),
        "languages_provided": F.array_distinct(F.filter(_or_empty(rel_langs, "array<string>"), lambda x: x != "")),
        "proto": N.parse_numbers(name, N.PROTO),
        "beta": N.parse_numbers(name, N.BETA),
        "demo": N.parse_numbers(name, N.DEMO),
        "sample": N.parse_numbers(name, N.SAMPLE),
        "revision": N.parse_numbers(name, N.REVISION),
        "version": N.parse_numbers(name, N.VERSION, 2),
        "parent_name": F.when((cloneof == "") & (romof == ""), name).when(cloneof != "", cloneof).otherwise(romof),
    })
    out = out.withColumns({"regions": F.array_union("regions_detected", "regions_provided"), "languages": F.array_union("languages_detected", "languages_provided")})
    return out.withColumns({
        "eff_languages": F.when(F.size("languages") > 0, F.col("languages")).otherwise(_or_empty(languages_of(F.col("regions"), regions), "array<string>")),
        "is_prerelease": (F.size("proto") > 0) | (F.size("beta") > 0) | (F.size("demo") > 0) | (F.size("sample") > 0),
    })


DIVERGENCE = ("ignore", "one_way", "two_way", "always")


def divergence(detected: Column, provided: Column, mode: str = "one_way") -> Column:
    """Whether provided values disagree with detected ones. one_way: both given and a detected one is not provided; two_way:
    both given and different; always: different; ignore: never."""
    if mode not in DIVERGENCE:
        raise ValueError(f"unknown mode {mode!r}")
    missing = F.size(F.array_except(detected, provided)) > 0
    extra = F.size(F.array_except(provided, detected)) > 0
    both = (F.size(detected) > 0) & (F.size(provided) > 0)
    return {"ignore": F.lit(False), "one_way": both & missing, "two_way": both & (missing | extra), "always": missing | extra}[mode]


