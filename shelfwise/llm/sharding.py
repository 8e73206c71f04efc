"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into a fixed number of cells. Virtual nodes of every shard sit on cells; a row's hash picks its cell, the
next virtual node clockwise owns the cell. Every shard has a capacity, floor or ceiling of rows / shards, and rows that
overflow a full shard continue clockwise to the next shard with room. Only the row count of each cell (a fixed number of
cells) reaches the driver, where the flow is planned; ranks inside cells and the plan decide each row's shard and slot.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, free_name, materialize

CELLS = 1 << 16
#: A cell with this many rows more than four times the mean is crowded: many rows must be equal in key and ties.
CROWDED = 1 << 20


def ring_owners(n_shards: int, vnodes: int, seed: int, cells: int = CELLS) -> np.ndarray:
    """Shards in clockwise order from each cell's owner: array `owner` by cell, from virtual nodes hashed on cells."""
    at: dict[int, tuple[bytes, int]] = {}
    for shard in range(n_shards):
        for v in range(vnodes):
            h = hashlib.sha256(f"{seed}/{shard}/{v}".encode()).digest()
            cell = int.from_bytes(h[:8], "big") * cells >> 64
            at[cell] = min(at.get(cell, (h, shard)), (h, shard))
    points = np.array(sorted(at))
    shards = np.array([at[p][1] for p in points])
    return shards[np.searchsorted(points, np.arange(cells)) % len(points)]


def plan_flow(counts: np.ndarray, owner: np.ndarray, capacity: np.ndarray) -> pd.DataFrame:
    """Pieces (cell, lo, hi, shard, base): rows of the cell ranked lo..hi-1 go to `shard` at slots base + rank - lo.

    Cells are taken clockwise from 0. First every shard takes rows of its own cells while it has room, then what is left
    of each cell continues clockwise to the next shards with room. Capacities must add up to at least the rows.
    """
    room, used = capacity.astype(np.int64).copy(), np.zeros(len(capacity), np.int64)
    pieces, left = [], []

    def take(cell: int, lo: int, hi: int, shard: int) -> int:
        n = min(int(room[shard]), hi - lo)
        if n:
            pieces.append((cell, lo, lo + n, shard, int(used[shard])))
            room[shard] -= n
            used[shard] += n
        return lo + n

    for cell in np.flatnonzero(counts):
        lo = take(int(cell), 0, int(counts[cell]), int(owner[cell]))
        if lo < counts[cell]:
            left.append((int(cell), lo))
    cells = len(owner)
    starts = np.flatnonzero(owner != np.roll(owner, 1))
    for cell, lo in left:
        hi, k = int(counts[cell]), int(np.searchsorted(starts, cell, side="right"))
        while lo < hi:
            if not room.any():
                raise ValueError("capacities are smaller than the rows")
            live = starts[room[owner[starts]] > 0]
            if not len(live):  # a shard without any arc of its own: fill by number
                lo = take(cell, lo, hi, int(np.flatnonzero(room)[0]))
                continue
            k = int(np.searchsorted(live, cell, side="right")) % len(live)
            lo = take(cell, lo, hi, int(owner[live[k]]))
    assert cells
    return pd.DataFrame(pieces, columns=["cell", "lo", "hi", "shard", "base"]).astype({"cell": "int32", "lo": "int64", "hi": "int64", "shard": "int32", "base": "int64"})


def cell_counts(rows: DataFrame, cell: str) -> np.ndarray:
    counts = np.zeros(CELLS, np.int64)
    for r in rows.groupBy(cell).count().toLocalIterator():
        counts[r[0]] = r[1]
    return counts


def shard_rows(df: DataFrame, key: str, n_shards: int, vnodes: int = 64, seed: int = 1, tie: list[str] | None = None, crowded: int = CROWDED) -> DataFrame:
    """df with `shard` (0 to n_shards - 1, row counts at most one apart) and `slot` (gapless from 0 in each shard).

    Rows are dealt to the ring's cells by key and `tie` columns together, so a frequent or null key is spread where ties tell
    its rows apart, and ranked in their cell by the same; rows equal in all of these share a cell and take its slots in
    any order. Where they are so many that a cell has over `crowded` rows more than four times the mean, all rows are written
    with a number each, by which the rows of crowded cells are dealt over the ring, so that no cell is ranked in one long task.
    Texts are not read. An empty table gives no rows. Columns named `shard` and `slot` are replaced, all others kept, whatever
    their names.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    cell, rank, h, lo, hi, base = (free_name(df, c) for c in ("_cell", "_rank", "_h", "_lo", "_hi", "_base"))
    by = [key, *(tie or [])]
    hashed = df.withColumn(h, F.xxhash64(*by, F.lit(seed))).withColumn(cell, F.shiftrightunsigned(h, 48).cast("int"))
    counts, number = cell_counts(hashed, cell), free_name(df, "_number")
    full = np.flatnonzero(counts > crowded + 4 * counts.mean())
    if len(full):
        numbered = materialize(df.withColumn(number, F.monotonically_increasing_id()), "numbered-rows")
        first = F.xxhash64(*by, F.lit(seed))
        dealt = F.when(F.shiftrightunsigned(first, 48).isin(full.tolist()), F.xxhash64(number, F.lit(seed))).otherwise(first)
        hashed = numbered.withColumn(h, dealt).withColumn(cell, F.shiftrightunsigned(h, 48).cast("int"))
        by, counts = [*by, number], cell_counts(hashed, cell)
    n = int(counts.sum())
    capacity = n // n_shards + (np.arange(n_shards) < n % n_shards)
    plan = plan_flow(counts, ring_owners(n_shards, vnodes, seed), capacity)
    # at most one piece for each cell and one more for each shard that fills: bounded by CELLS and n_shards, whatever the rows
    pieces = spark.createDataFrame(plan, f"{cell} int, {lo} long, {hi} long, shard int, {base} long")
    ranked = hashed.withColumn(rank, F.row_number().over(Window.partitionBy(cell).orderBy(h, *by)).cast("long") - 1)
    out = ranked.join(F.broadcast(pieces), cell).where((F.col(rank) >= F.col(lo)) & (F.col(rank) < F.col(hi)))
    return out.withColumn("slot", F.col(base) + F.col(rank) - F.col(lo)).drop(cell, rank, h, lo, hi, base, number)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard_rows(rows, "doc_id", 40, tie=["text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
