"""Near-duplicate groups by SimHash fingerprints of at most a few differing bits.

A fingerprint is cut into segments and mapped to the numbers of ones in them, a point of a grid. The Manhattan distance of two
points is a lower bound of the fingerprints' differing bits, so linked fingerprints are at most 2 steps apart on the grid.
Then some cell lies within one step of both, and the range join deals every fingerprint to its own cell and the cells one
step away (1 + 2 x segments at most) instead of all within two. In a cell, pairs are verified by their differing bits; only a
spanning forest of its links leaves the task. In crowded cells no pairs are made: there the grid is refined to segments of one bit, where
steps are bits, and whoever shares a cell is linked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, mix64, pieces, small
from .components import components

SEGMENT = 4
SEGMENTS = 64 // SEGMENT
SEED = 42
#: Fingerprints in a cell whose pairs are compared one by one; beyond, segments of one bit make fewer rows than pairs.
PAIRED = 128
#: Fingerprints whose neighbours by one bit are held at a time.
REFINED = 16384
#: Bits that may differ. The half-way cell of the range join is one step from both ends, so it is at most 2.
MOST_BITS = 2
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
ONES = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)
SHINGLES = 1 << 16


def popcount(x: np.ndarray) -> np.ndarray:
    return sum(ONES[(x >> np.uint64(k)) & np.uint64(0xFFFF)] for k in (0, 16, 32, 48))


def fingerprint(text: bytes, n: int = 3) -> int:
    """The 64 bits of a text: each is set in over half of the XXH64 hashes of its shingles of n words, repeats included. With
    fewer words the whole sequence is one shingle; without words the fingerprint is 0."""
    ones, total, held = np.zeros(64, np.int64), 0, []

    def count(words: list[bytes]) -> None:
        nonlocal total
        joined, at = b" ".join(words), np.zeros(len(words) + 1, np.int64)
        at[1:] = np.cumsum([len(w) + 1 for w in words])
        begin, end = at[: len(words) - n + 1].tolist(), (at[n:] - 1).tolist()
        for lo in range(0, len(begin), SHINGLES):
            h = b"".join([xxhash.xxh64_digest(joined[a:b], SEED) for a, b in zip(begin[lo : lo + SHINGLES], end[lo : lo + SHINGLES])])
            bits = np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 8), axis=1)
            ones[:] += bits.sum(0, dtype=np.int64)
            total += len(bits)

    for part in pieces(text):
        words = held + part.translate(LOWER).split()
        if len(words) >= n:
            count(words)
            held = words[len(words) - n + 1 :]
        else:
            held = words
    if not total:
        if not held:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(held), SEED)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def segment_counts(fps: np.ndarray) -> np.ndarray:
    """The numbers of ones in the segments of fingerprints: a row of SEGMENTS for each."""
    shifts = np.arange(0, 64, SEGMENT, dtype=np.uint64)
    return ONES[(fps[:, None] >> shifts) & np.uint64((1 << SEGMENT) - 1)]


def cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): each fingerprint's own cell and those one step away, as 64-bit numbers of the grid's points."""
    counts = segment_counts(fps).astype(np.uint64)
    step = np.array([(SEGMENT + 1) ** k for k in range(SEGMENTS)], np.uint64)  # 5 ** 16 < 2 ** 64
    own = (counts * step).sum(1, dtype=np.uint64)
    row, cell = [np.arange(len(fps))], [own]
    for k in range(SEGMENTS):
        for ok, to in ((counts[:, k] < SEGMENT, own + step[k]), (counts[:, k] > 0, own - step[k])):
            row.append(np.flatnonzero(ok))
            cell.append(to[ok])
    return np.concatenate(row), np.concatenate(cell)


class Forest:
    """Components of numbered nodes; edges come in arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (up := self.root[self.root] != self.root).any():
                self.root[up] = self.root[self.root[up]]


def crowded_links(fps: np.ndarray, forest: Forest, at: np.ndarray) -> None:
    """Link the fingerprints of one cell at distance 2 or less by the grid of single bits, in memory linear in their number."""
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    parts = max(1, -(-len(fps) // REFINED))
    for p in range(parts):
        points, who = [], []
        for f in flips:
            x = fps ^ f
            mine = np.flatnonzero(mix64(x) % np.uint64(parts) == np.uint64(p)) if parts > 1 else np.arange(len(fps))
            points.append(x[mine])
            who.append(mine)
        points, who = np.concatenate(points), np.concatenate(who)
        order = np.argsort(points, kind="stable")
        points, who = points[order], who[order]
        same = points[1:] == points[:-1]
        forest.link(at[who[:-1][same]], at[who[1:][same]])


def cell_links(cell: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (u, v) of the links within each cell; equal cells lie together."""
    forest, n = Forest(len(fps)), len(fps)
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(first, n))
    for a, m in zip(first[size > PAIRED].tolist(), size[size > PAIRED].tolist()):
        crowded_links(fps[a : a + m], forest, np.arange(a, a + m))
    end = np.repeat(first + size, size)
    left = np.flatnonzero(np.repeat(size <= PAIRED, size) & (np.arange(n) + 1 < end))
    d = 1
    while len(left):
        near = left[popcount(fps[left] ^ fps[left + d]) <= MOST_BITS]
        forest.link(near, near + d)
        d += 1
        left = left[left + d < end[left]]
    child = np.flatnonzero(forest.root != np.arange(n))
    return fps[child], fps[forest.root[child]]


def links(fps: DataFrame) -> DataFrame:
    """(u, v): links, or chains of them, between distinct fingerprints (column fp, long) that give the components of all links."""

    def deal(batches):
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(x), 4096):
                row, cell = cells(x[lo : lo + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(x[lo + row].view(np.int64))], names=["cell", "fp"])

    def join(batches):
        cell, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            cell = np.concatenate([cell, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            cut = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0  # the last cell may go on in the next batch
            if cut:
                yield _edges(*cell_links(cell[:cut], fp[:cut]))
                cell, fp = cell[cut:], fp[cut:]
        yield _edges(*cell_links(cell, fp))

    def _edges(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    dealt = fps.mapInArrow(deal, "cell long, fp long").repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(join, "u long, v long").distinct()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """id, fp: one row per row of docs, with the fingerprint as a signed number."""

    def run(batches):
        for batch in batches:
            got = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def near_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per row of docs: id_col, fp (64 bits as a signed number), component_id (smallest id reachable over links of at most
    2 differing bits, itself included).

    Texts that are null, empty or without words have fingerprint 0 and are linked like any other; rows that repeat are rows
    each; null ids take the smallest other id of their component, or null if there is none. Texts of any length are read
    whole, in pieces. Other columns are not read, so their names cannot clash. An empty table gives no rows.
    """
    table = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = materialize(table.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    edges = materialize(links(nodes.select("fp")), "links")
    roots = materialize(components(edges), "roots")
    n = roots.count()
    grouped = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    grouped = materialize(grouped.join(nodes.select(F.col("fp").alias("node"), "least"), "node"), "grouped")
    lowest = materialize(grouped.groupBy("root").agg(F.min("least").alias("lowest")), "lowest")
    joined = materialize(grouped.join(small(lowest, n, 32), "root").select(F.col("node").alias("fp"), "lowest"), "joined")
    # distinct fingerprints of two or more rows, or of a component of two or more; all others' component is their own id
    named = nodes.join(small(joined, 2 * n, 32), "fp", "left").select("fp", F.coalesce("lowest", "least").alias("component_id"))
    named = materialize(named, "named")
    out = table.join(small(named, named.count(), 32), "fp", "left")
    return out.select(F.col("id").alias(id_col), "fp", "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_fingerprints(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
