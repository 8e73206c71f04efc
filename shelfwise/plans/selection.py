"""The whole selection: derive, check, filter, post-filter, restrict to present files, pick the best, order by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Filter, PostFilter, Preference
from ..functions.names import name_order
from ..functions.regions import DEFAULT, Region
from ..functions.tables import materialize
from ..operators.derive import derive
from ..operators.filters import apply_filter, post_filter, validate
from ..operators.matching import match_levels, present_games, rom_rows
from ..operators.ranking import pick_best


def select_best(games: DataFrame, f: Filter = Filter(), p: Preference = Preference(), post: PostFilter = PostFilter(), scan: DataFrame | None = None,
                regions: tuple[Region, ...] = DEFAULT, one_detector: bool = False, check: bool = True) -> DataFrame:
    """The best (present) game of each family that no post-exclude drops. With check, invalid catalogs raise."""
    parsed = derive(games, regions)
    if check:
        validate(parsed, one_detector)
    kept = post_filter(apply_filter(parsed, f), post)
    if scan is not None:
        kept = present_games(kept, match_levels(rom_rows(kept), scan))
    return pick_best(kept, p)


def ordered(best: DataFrame) -> DataFrame:
    """best in name order; equal names keep their input order."""
    return best.orderBy(*name_order(F.col("name")), "dat_ord", "game_ord")


def numbered(ordered_rows: DataFrame, column: str) -> DataFrame:
    """Sorted rows with how many come before each. The sort's partitions number their rows; the counts of the partitions, one
    row each, give the offsets, so no task sees all rows."""
    rows = materialize(ordered_rows.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn(column, F.col("_before") + F.col("_at")).drop("_id", "_part", "_at", "_before")


def rebuild_names(best: DataFrame) -> DataFrame:
    """place (from 1), name: the selected names in name order."""
    return numbered(ordered(best).select("name"), "place").select((F.col("place") + 1).alias("place"), "name")
