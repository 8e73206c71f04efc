"""Ranking of families by a preference vector, and the best entry of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Preference
from ..functions.names import count_matches
from ..functions.tables import materialize, running_sum
from .patterns import counted

NO_INDEX = 2147483647


def smallest_index(values: Column, order: tuple[str, ...]) -> Column:
    """The least place in `order` of any value, NO_INDEX without one."""
    if not order:
        return F.lit(NO_INDEX)
    wanted = F.array(*map(F.lit, order))
    places = F.filter(F.transform(values, lambda x: F.array_position(wanted, x)), lambda p: p > 0)
    return F.coalesce(F.array_min(places).cast("int"), F.lit(NO_INDEX))


def selected_count(values: Column, wanted: tuple[str, ...]) -> Column:
    return F.size(F.array_intersect(values, F.array(*map(F.lit, wanted)))) if wanted else F.lit(0)


def rank_columns(p: Preference, avoided: Column | None = None, preferred: Column | None = None) -> list[Column]:
    """The ordering of a family, best first. Arrays must not be null; ties end with the input order (dat_ord, game_ord). avoided,
    preferred: where the pattern lists are long, columns with how many match."""
    name = F.col("name")
    avoided = count_matches(name, list(p.avoids)) if avoided is None else avoided
    preferred = count_matches(name, list(p.prefers)) if preferred is None else preferred

    def late(col: str, early: bool) -> Column:
        return F.col(col).asc() if early else F.col(col).desc()

    # keys that are the same for all rows are left out: as literals a sort would take them for places
    region = [smallest_index(F.col("regions"), p.regions).asc()] * bool(p.regions)
    language = [smallest_index(F.col("eff_languages"), p.languages).asc()] * bool(p.languages)
    out = [F.col("is_bad").asc()]
    out += [F.col("is_prerelease").desc()] if p.prefer_prereleases else []
    out += [avoided.asc()] * bool(p.avoids)
    out += [*language, *region] if p.prioritize_languages else [*region, *language]
    out += [F.col("is_parent").desc()] if p.prefer_parents else []
    out += [preferred.desc()] * bool(p.prefers)
    out += [late("revision", p.early_revisions), late("version", p.early_versions), F.col("is_prerelease").asc()]
    out += [late(c, p.early_prereleases) for c in ("sample", "demo", "beta", "proto")]
    out += [selected_count(F.col("eff_languages"), p.languages).desc()] * bool(p.languages)
    out += [F.size(F.array_distinct("eff_languages")).desc(), F.col("is_parent").desc()]
    return [*out, F.col("dat_ord").asc(), F.col("game_ord").asc()]


def rank(games: DataFrame, p: Preference) -> DataFrame:
    """games with `rank`, 1 for the best of each family."""
    rows, of = counted(games, avoids=p.avoids, prefers=p.prefers)
    order = rank_columns(p, of["avoids"], of["prefers"])
    return rows.select(*games.columns, F.row_number().over(Window.partitionBy("parent_name").orderBy(*order)).alias("rank"))


def rank_by_ranges(games: DataFrame, p: Preference) -> DataFrame:
    """As rank, for families of any size: one sort over all families deals a huge one over many tasks by the rank's own keys, rows
    are numbered by the partitions' offsets, and a rank is the distance to the family's first row. Rows are written before the sort,
    which goes through them twice (its ranges come from a sample), and once sorted."""
    rows, of = counted(materialize(games, "unranked"), avoids=p.avoids, prefers=p.prefers)
    placed = running_sum(rows.orderBy("parent_name", *rank_columns(p, of["avoids"], of["prefers"])).select(games.columns), F.lit(1), "_place")
    first = placed.groupBy(F.col("parent_name").alias("_family")).agg(F.min("_place").alias("_first"))
    out = placed.join(first, F.col("parent_name").eqNullSafe(F.col("_family")))
    return out.select(*games.columns, (F.col("_place") - F.col("_first") + 1).cast("int").alias("rank"))


def pick_best(games: DataFrame, p: Preference) -> DataFrame:
    """The best entry of each family; Spark limits each family to one row before and after the shuffle."""
    return rank(games, p).where("rank = 1").drop("rank")
