"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are reduced to their lower-case letters and digits. Long items are looked for whole and in overlapping windows, so that a
part of an item is found too. A window of m characters that occurs with at most k edits shares at least m - Q + 1 - k * Q of its q-grams with the text on at most k + 1 neighbouring diagonals. Shared q-grams are counted
in overlapping bands of 2 * (k + 1) diagonals, bands that reach the bound are kept, and each is verified by an alignment
confined to the band. The items are a stated query set, in slices of bounded size: a task goes through the slices for each block
of its documents and holds one slice's index at a time, so what their number costs is time and disk, not memory.
"""

from __future__ import annotations

import pickle
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import scratch
from ..sources.storage import open_input, write_file
from .common import documents, free_name, text_chunks
from .repeats import gram_hashes

Q = 8
EDITS = 0.1
#: Items longer than WINDOW letters and digits are also looked for in windows of WINDOW, one every STRIDE and one at the end.
#: With a stride within the edits of a window, a verbatim part is found wherever it starts if a window's edits can make up for
#: what it lacks: from 108 letters on, and with e edits from 108 + 2 e.
WINDOW, STRIDE = 120, 12
#: Bytes of item texts in one slice, and of documents for which a task goes through several slices at once.
SLICE_BYTES = 4 << 20
BLOCK_BYTES = 32 << 20
#: Letters and digits of a long text that are searched at a time.
PIECE = 1 << 20
#: Pairs (place in a text, place in an item) of shared q-grams that are made at a time.
SLICE = 1 << 18
U = np.uint64
#: No code point; stands for what lies outside a text. Reading it costs no less than leaving out the item's letter.
OUTSIDE = 0xFFFFFFFF
DELETE = bytes(c for c in range(128) if not chr(c).isalnum())
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
NOT_WORD = re.compile(r"[\W_]+")


def reduced(b: bytes) -> np.ndarray:
    """Code points of the lower-case letters and digits of a UTF-8 text."""
    if b.isascii():
        return np.frombuffer(b.translate(LOWER, DELETE), np.uint8).astype(np.uint32)
    return np.frombuffer(NOT_WORD.sub("", b.decode("utf-8", "replace").lower()).encode("utf-32-le"), np.uint32)


def edit_budget(m: int, edits: float = EDITS, q: int = Q) -> int:
    """Allowed edits: a share of the length, but few enough that at least one q-gram must be shared."""
    return max(0, min(int(edits * m), (m - q) // q))


def windows(codes: np.ndarray, window: int | None = None, stride: int | None = None) -> list[tuple[int, np.ndarray]]:
    """(start, codes) of each window, and last of the whole item."""
    window, stride = window or WINDOW, stride or STRIDE
    if len(codes) <= window:
        return [(0, codes)]
    return [*((a, codes[a : a + window]) for a in sorted({*range(0, len(codes) - window, stride), len(codes) - window})), (0, codes)]


class Sums:
    """Counts of values that come in parts; what is held is bounded by the distinct values and one part."""

    def __init__(self):
        self.held, self.size = [], 0

    def add(self, values: np.ndarray) -> None:
        self.held.append(np.unique(values, return_counts=True))
        self.size += len(self.held[-1][0])
        if self.size > 2 * len(self.held[0][0]) + SLICE:
            self.held = [self.result()]
            self.size = len(self.held[0][0])

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted distinct values, counts)"""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        values, where = np.unique(np.concatenate([v for v, _ in self.held]), return_inverse=True)
        return values, np.bincount(where, np.concatenate([c for _, c in self.held]), len(values)).astype(np.int64)


class ItemIndex:
    """q-grams of a slice of items: sorted distinct hashes, a bitmap before them, the (item, place) pairs of each, and the
    items' windows with their edit budgets and least numbers of shared q-grams. Long items as wholes come after all windows."""

    def __init__(self, items: list[tuple[int, np.ndarray]], edits: float = EDITS, q: int = Q, window: int | None = None, stride: int | None = None):
        self.q, self.ids, self.window = q, [i for i, _ in items], window or WINDOW
        grams = [gram_hashes(c, q) for _, c in items]
        flat = np.concatenate(grams) if grams else np.zeros(0, U)
        item = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.keys, first = np.unique(flat[order], return_index=True)
        self.bounds = np.append(first, len(flat))
        self.item, self.place = item[order], place[order]
        self.bits = max(16, min(24, int(4 + np.log2(len(self.keys) + 1))))
        self.bitmap = np.zeros(1 << self.bits, bool)
        self.bitmap[self.keys >> U(64 - self.bits)] = True
        parts = sorted(((i, a, w) for i, (_, c) in enumerate(items) for a, w in windows(c, window, stride)), key=lambda x: len(x[2]) > self.window)
        self.codes, self.owner = [w for *_, w in parts], np.array([i for i, *_ in parts], np.int64)
        self.start, self.length = np.array([a for _, a, _ in parts], np.int64), np.array([len(w) for *_, w in parts], np.int64)
        self.budget = np.array([edit_budget(len(w), edits, q) for *_, w in parts], np.int64)
        self.least = np.maximum(1, self.length - q + 1 - self.budget * q)
        self.n_windows = int((self.length <= self.window).sum())
        self.spots = self.owner[: self.n_windows] << 32 | self.start[: self.n_windows]  # sorted
        self.whole = np.full(len(items), -1)
        self.whole[self.owner[self.n_windows :]] = np.arange(self.n_windows, len(parts))
        self.once = np.ones(len(self.item), bool)  # first place of an item among those of one q-gram
        self.once[1:] = (self.item[1:] != self.item[:-1]) | (flat[order][1:] != flat[order][:-1])
        self.fewest = np.full(len(items), np.iinfo(np.int64).max)
        np.minimum.at(self.fewest, self.owner, self.least)

    def shared(self, buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in buf, place among keys, text) of the q-grams of buf that some item has."""
        h = gram_hashes(buf, self.q)
        at = np.flatnonzero(self.bitmap[h >> U(64 - self.bits)])
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[k] == h[at]
        at, k = at[same], k[same]
        text = np.searchsorted(ends, at, side="right")
        inside = at + self.q <= ends[text]  # not across texts
        return at[inside], k[inside], text[inside]

    def slices(self, k: np.ndarray):
        """(from, to, place of each among them, item place) of runs of k whose q-grams occur about SLICE times in items, so a
        q-gram that items or the text repeat never makes all its pairs at once."""
        n = self.bounds[k + 1] - self.bounds[k]
        total = np.cumsum(n)
        a = 0
        while a < len(k):
            b = max(a + 1, int(np.searchsorted(total, total[a] - n[a] + SLICE, side="right")))
            m, first = n[a:b], self.bounds[k[a:b]]
            yield a, b, np.repeat(np.arange(a, b), m), np.repeat(first - np.cumsum(m) + m, m) + np.arange(m.sum())
            a = b

    def pairs(self, k: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Sorted text * items + item of the pairs that share enough: what a window lacks in places of the text at which the
        item's q-grams stand, it lacks in a band."""
        sums = Sums()
        for _, _, who, ref in self.slices(k):
            once = self.once[ref]  # a place counts once for an item, however often that has its q-gram
            sums.add(text[who[once]] * len(self.ids) + self.item[ref[once]])
        pair, count = sums.result()
        return pair[count >= self.fewest[pair % len(self.ids)]]

    def find(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """search() for one text of any length, in pieces that overlap by more than an occurrence can span."""
        span = int((self.length + self.budget).max(initial=1))
        best: dict[int, int] = {}
        for at in range(0, max(1, len(codes) - span), PIECE):
            for i, d in self.search([codes[at : at + PIECE + span]])[0]:
                best[i] = min(d, best.get(i, d))
        return sorted(best.items())

    def search(self, codes: list[np.ndarray]) -> list[list[tuple[int, int]]]:
        """For each text, (index of item, least edits found) of the items that occur, whole or by a window, within the budget."""
        found: list[dict[int, int]] = [{} for _ in codes]
        sizes = np.array([len(c) for c in codes], np.int64)
        ends = np.cumsum(sizes)
        buf = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
        if len(buf) < self.q or not len(self.keys):
            return [[] for _ in codes]
        at, k, text = self.shared(buf, ends)
        enough = self.pairs(k, text)
        shift, sums = int(self.length.max()) + 1, Sums()
        for _, _, who, ref in self.slices(k) if len(enough) else ():
            pair = text[who] * len(self.ids) + self.item[ref]
            some = enough[np.minimum(np.searchsorted(enough, pair), len(enough) - 1)] == pair
            where, item, place = at[who[some]], self.item[ref[some]], self.place[ref[some]]
            first = np.searchsorted(self.spots, item << 32 | np.maximum(place + self.q - self.window, 0))
            n = np.searchsorted(self.spots, item << 32 | place, side="right") - first  # windows that hold the q-gram
            long = self.whole[item] >= 0
            window = np.concatenate([np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum()), self.whole[item[long]]])
            diagonal = np.concatenate([np.repeat(where - place, n), where[long] - place[long]]) + self.start[window]
            band = (diagonal + shift) // (self.budget[window] + 1)
            sums.add(np.concatenate([window << 40 | band, window << 40 | np.maximum(band - 1, 0)]))
        key, count = sums.result()
        window, band = key >> 40, key & ((1 << 40) - 1)
        good = count >= self.least[window]
        window, band, count = window[good], band[good], count[good]
        low = np.maximum(0, -(-(self.length[window] - self.q + 1 - count) // self.q))  # an edit costs at most q shared q-grams
        order = np.lexsort((low, window >= self.n_windows))  # the most alike first, wholes last
        for w, b, low in zip(window[order].tolist(), band[order].tolist(), low[order].tolist()):
            budget, m, item = int(self.budget[w]), int(self.length[w]), int(self.owner[w])
            first = b * (budget + 1) - shift  # first diagonal of the band
            mid = min(max(first + budget + 1 + m // 2, 0), len(buf) - 1)
            for t in {int(np.searchsorted(ends, x, side="right")) for x in (mid, max(first + budget, 0), min(first + budget + m - 1, len(buf) - 1))}:
                if t >= len(found) or w >= self.n_windows and item in found[t]:  # a whole costs no less than its windows
                    continue
                most = min(budget, found[t].get(item, budget + 1) - 1)  # only fewer edits count
                if low <= most:
                    d = banded(self.codes[w], buf, first, 2 * (budget + 1), most, int(ends[t] - sizes[t]), int(ends[t]))
                    if d <= most:
                        found[t][item] = d
        return [sorted(f.items()) for f in found]


def banded(item: np.ndarray, text: np.ndarray, first: int, width: int, budget: int, begin: int, end: int) -> int:
    """Least edits that turn the whole item into some substring of text[begin:end], over paths that stay on the diagonals
    first - budget to first + width + budget; budget + 1 if there is none within the budget."""
    lo, n = first - budget, width + 2 * budget + 1
    near = np.full(n + len(item), OUTSIDE, np.uint32)
    a, z = min(max(lo, begin), end), max(min(lo + len(near), end), begin)
    if a < z:
        near[a - lo : z - lo] = text[a:z]
    places = np.lib.stride_tricks.as_strided(near, (len(item), n), (near.itemsize, near.itemsize))  # row i: what its diagonals read
    diag = np.arange(n)
    row = -diag  # edits less the diagonal, so that insertions are a running minimum
    for i in range(0, len(item), 8):
        for differs in places[i : i + 8] != item[i : i + 8, None]:
            step = row + differs
            step[:-1] = np.minimum(step[:-1], row[1:] + 2)
            row = np.minimum.accumulate(step)
        if (least := int((row + diag).min())) > budget:
            return budget + 1
    return least


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: float = EDITS, q: int = Q) -> DataFrame:
    """One row per row of docs: the columns of docs but text_col's, and `leaks`, an array of (item_id, edits) by item_id.

    One rule for items of every length: an item leaks into a text if a part of min(its length, WINDOW) letters and digits, or
    the whole item, occurs there within the budget of that part's length (`edit_budget`: 10 %, one less for some lengths under
    WINDOW, so that a q-gram must be left). `edits` is the least number found. Items that are null or have fewer than q
    letters and digits identify nothing and are left out; null and empty texts have no leaks; repeated rows and items each
    count for themselves (equal item_ids appear once, with their least edits); texts of any length are searched whole, in
    bounded memory. Columns of docs named `leaks` are replaced. An empty table of either side gives no leaks.
    """
    usable = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = usable.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    numbers, index_of = item_slices(usable, max(1, -(-total // SLICE_BYTES)), edits, q)
    keep = [c for c in docs.columns if c not in (text_col, "leaks")]
    head = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    hidden = free_name(docs, "_text")
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32())]))

    def run(batches):
        get = lru_cache(1)(index_of)  # one index at a time; a single one stays for the task
        for block in gathered(batches, BLOCK_BYTES if len(numbers) > 1 else 0):
            found = [[{} for _ in range(batch.num_rows)] for batch in block]
            for s in numbers:
                index = get(s)
                for batch, leaks in zip(block, found):
                    for first, texts in text_chunks(batch.select([hidden]), hidden):
                        codes = [reduced(b) for b in texts]
                        short = index.search([c if len(c) <= PIECE else c[:0] for c in codes])
                        for i, got in enumerate(index.find(c) if len(c) > PIECE else x for c, x in zip(codes, short)):
                            best = leaks[first + i]
                            for x, e in got:
                                best[index.ids[x]] = min(e, best.get(index.ids[x], e))
            for batch, leaks in zip(block, found):
                out = [[{"item_id": x, "edits": e} for x, e in sorted(best.items())] for best in leaks]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, "leaks"])

    frame = docs.select(*keep, F.col(text_col).alias(hidden)).mapInArrow(run, head + f"`{hidden}` string, leaks array<struct<item_id:long,edits:int>>")
    return frame.select(*keep, F.col(hidden).alias(text_col), "leaks")


def item_slices(items: DataFrame, slices: int, edits: float, q: int):
    """(slice numbers, function that gives a slice's index in a task) of items (item_id, text) dealt by hash.

    One slice, about SLICE_BYTES of text, is broadcast. Several are built by tasks and written in the shared folder, from which
    each task reads one at a time, so neither the driver nor a task holds more of the items than a slice."""
    dealt = items.distinct().withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)))
    window, stride = WINDOW, STRIDE
    indexed = lambda rows: ItemIndex([(i, c) for i, t in sorted(rows) if len(c := reduced(t.encode())) >= q], edits, q, window, stride)
    if slices == 1:
        held = items.sparkSession.sparkContext.broadcast(indexed(map(tuple, dealt.select("item_id", "text").collect())))
        return [0], lambda s: held.value
    folder = scratch(items.sparkSession, "item-slices")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        index = indexed(zip(pdf["item_id"].tolist(), pdf["text"]))
        write_file(f"{folder}/{pdf['slice'].iloc[0]}", lambda out: pickle.dump(index, out, pickle.HIGHEST_PROTOCOL))
        return pdf[["slice"]].head(1)

    def read(s: int) -> ItemIndex:
        with open_input(f"{folder}/{s}") as f:
            return pickle.load(f)

    return sorted(r[0] for r in dealt.groupBy("slice").applyInPandas(build, "slice long").collect()), read


def gathered(batches, size: int):
    """Lists of batches in order, each but the last of at least `size` bytes."""
    block: list[pa.RecordBatch] = []
    for batch in batches:
        block.append(batch)
        if sum(b.nbytes for b in block) >= size:
            yield block
            block = []
    if block:
        yield block


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(
        "doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").cast("long").alias("n_items"),
        F.array_join(F.transform("leaks", lambda x: x["item_id"].cast("string")), ",").alias("item_ids"), F.array_min(F.transform("leaks", lambda x: x["edits"])).alias("least_edits"),
    )
