"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import BROADCAST_BYTES
from .common import materialize


def _with_least(edges: DataFrame, rows: int) -> DataFrame:
    """edges with m, the smallest of u and its neighbours v. rows bounds the distinct u: few are broadcast, else the minima
    are written first, so that the join with them can split a hub's rows."""
    mins = edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return edges.join(F.broadcast(mins) if rows * 64 <= BROADCAST_BYTES else materialize(mins, "mins"), "u")


def large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * rows).where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame, rows: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    ends = _with_least(down, rows).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return ends.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of edges (u, v; any orderable type) but roots.

    Loops, repeated and reversed edges count once; null ends are dropped; without edges there are no rows. Edges stay
    in tables of the shared folder; only a count and a checksum of each round reach the driver.
    """
    def checksum(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = materialize(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = checksum(now)
    while before[0]:
        stars = materialize(large_star(now, before[0]), "large-star")
        now = materialize(small_star(stars, 2 * before[0]), "small-star")
        after = checksum(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
