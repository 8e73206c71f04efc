"""Row filters, the family-level post-filter, and catalog validity checks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Filter, InvalidCatalog, PostFilter
from ..functions.names import BUILT_IN, any_match, quote
from .patterns import MANY, counted


def patterns_of(strings: list[str] = (), regexes: list[str] = ()) -> tuple[str, ...]:
    """Literals (quoted, case-sensitive) and regular expressions as one tuple of patterns."""
    return (*map(quote, strings), *regexes)


def built_in_excludes(allowed: dict[str, bool]) -> tuple[str, ...]:
    """Patterns of the built-in classes that are not allowed."""
    return tuple(p for name, p in BUILT_IN.items() if not allowed.get(name, True))


def overlaps(values: Column, wanted: tuple[str, ...]) -> Column:
    return F.arrays_overlap(values, F.array(*map(F.lit, wanted)))


def predicate(f: Filter, excluded: Column | None = None, included: Column | None = None) -> Column:
    """The conjunction of all row filters; cheap flags first. Includes rescue from excludes only. excluded, included: where the
    pattern lists are long, columns that say so already."""
    out = F.lit(True)
    if not f.allow_bios:
        out = out & ~F.col("is_bios")
    for name, ok in (("proto", f.allow_proto), ("beta", f.allow_beta), ("demo", f.allow_demo), ("sample", f.allow_sample)):
        if not ok:
            out = out & (F.size(name) == 0)
    if f.include_regions:
        out = out & overlaps(F.col("regions"), f.include_regions)
    if f.include_languages:
        out = out & overlaps(F.col("eff_languages"), f.include_languages)
    if f.exclude_regions:
        out = out & ~overlaps(F.col("regions"), f.exclude_regions)
    if f.exclude_languages:
        out = out & ~overlaps(F.col("eff_languages"), f.exclude_languages)
    if f.excludes:
        hit = any_match(F.col("name"), list(f.excludes)) if excluded is None else excluded
        out = out & (~hit | (any_match(F.col("name"), list(f.includes)) if included is None else included))
    return out


def apply_filter(games: DataFrame, f: Filter) -> DataFrame:
    if max(len(f.excludes), len(f.includes)) <= MANY:
        return games.where(predicate(f))
    rows = games.where(predicate(replace(f, excludes=(), includes=())))  # the cheap ones first
    rows, of = counted(rows, excludes=f.excludes, includes=f.includes)
    return rows.where(predicate(f, of["excludes"] > 0, of["includes"] > 0)).select(games.columns)


def post_filter(games: DataFrame, f: PostFilter) -> DataFrame:
    """Drop every family of which some member's name matches. Only the names of such families are shuffled; a null family
    name is a family of its own."""
    if not f.excludes:
        return games
    rows, of = counted(games.select("name", "parent_name"), excludes=f.excludes)
    hit = rows.where(of["excludes"] > 0).select(F.col("parent_name").alias("_family")).distinct()
    return games.join(hit, F.col("parent_name").eqNullSafe(F.col("_family")), "left_anti")


def validity(games: DataFrame) -> DataFrame:
    """One row: n_games, n_parents, n_detectors (distinct header detectors; games need `detector`, null for none)."""
    detectors = F.count_distinct("detector") if "detector" in games.columns else F.lit(0).cast("long")
    return games.agg(F.count(F.lit(1)).alias("n_games"), F.count_if("is_parent").alias("n_parents"), detectors.alias("n_detectors"))


def validate(games: DataFrame, needs_one_detector: bool = False) -> None:
    n, parents, detectors = validity(games).first()
    if n == 0:
        raise InvalidCatalog("the catalogs contain no valid entries")
    if n == parents:
        raise InvalidCatalog("the catalogs lack parent/clone information")
    if needs_one_detector and detectors > 1:
        raise InvalidCatalog("catalogs with different header detectors cannot be written as one")
