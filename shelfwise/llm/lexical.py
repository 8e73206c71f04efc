"""Ranked lexical search: an inverted index in windows of documents, and scores that are summed up window by window.

The index numbers documents densely: a window is a fixed range of WINDOW numbers, given out as a task goes through its rows, so
equal, missing or far apart ids cost nothing and no text is shuffled. A window's row holds its terms and, term by term, the
postings (slot in the window, occurrences). A search goes through the windows: every term of the query set that a
window has adds its weighted parts into an array of WINDOW sums that fits a core's cache, a bitset of the slots touched is
joined from the terms' own, and what is set there and good enough goes into the item's heap. A task sends its heaps only.
Scores are 64-bit integers, so their order of summing cannot change them.
"""

from __future__ import annotations

import heapq
import math
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, pieces

#: Documents of a window: 64 KB of sums.
WINDOW = 8192
#: Postings after which a window ends early, so that a task's memory does not depend on how long texts are.
POSTINGS = 1 << 20
#: Query terms (with repeats over items) that are searched for in one pass over the index.
PASS_TERMS = 400_000
SALTS = 64
#: A-Z lowered; bytes that are no part of a term become spaces. Bytes of characters beyond ASCII are parts of terms.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
INDEX = "terms binary, starts binary, slots binary, tfs binary, ids binary, null_ids binary, lens binary, n_docs long, n_terms long"


def terms_of(text: bytes):
    """The terms of a text, in lists of about a megabyte's."""
    for part in pieces(text.translate(TERM_BYTES)):
        yield part.split()


class _Window:
    """The postings of the documents added since it was made."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.term, self.slot, self.tf = array("I"), array("H"), array("Q")
        self.ids, self.lens = [], []

    def add(self, doc_id: int | None, text: bytes) -> None:
        count, number = {}, self.number
        for words in terms_of(text):
            for w in words:
                count[w] = count.get(w, 0) + 1
        self.term.extend([number.setdefault(w, len(number)) for w in count])
        self.slot.extend([len(self.ids)] * len(count))
        self.tf.extend(count.values())
        self.ids.append(doc_id)
        self.lens.append(sum(count.values()))

    @property
    def full(self) -> bool:
        return len(self.ids) >= WINDOW or len(self.term) >= POSTINGS

    def row(self) -> dict:
        term = np.frombuffer(self.term, np.uint32)
        names = sorted(self.number)
        place = np.empty(len(names), np.int64)
        place[[self.number[w] for w in names]] = np.arange(len(names))
        term = place[term] if len(term) else np.zeros(0, np.int64)
        order = np.argsort(term, kind="stable")
        starts = np.zeros(len(names) + 1, np.int32)
        starts[1:] = np.cumsum(np.bincount(term, minlength=len(names)))
        lens = np.array(self.lens, np.int64)
        return {
            "terms": b" ".join(names), "starts": starts.tobytes(), "slots": np.frombuffer(self.slot, np.uint16)[order].tobytes(), "tfs": np.frombuffer(self.tf, np.uint64)[order].astype(np.int64).tobytes(),
            "ids": np.array([i or 0 for i in self.ids], np.int64).tobytes(), "null_ids": np.array([i is None for i in self.ids]).tobytes(), "lens": lens.tobytes(), "n_docs": int((lens > 0).sum()), "n_terms": int(lens.sum()),
        }


_ARROW = pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in INDEX.split(", ")])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (INDEX) for each window of docs, written to the shared folder. Terms are sorted; ids must fit 64 bits.

    Null texts have no terms; null ids are kept as such; rows that repeat are documents each; texts of any length are read whole,
    in pieces; other columns are not read. An empty table gives an index without windows.
    """

    def run(batches):
        w = _Window()
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                w.add(i, t.as_buffer().to_pybytes() if t.is_valid else b"")
                if w.full:
                    yield pa.RecordBatch.from_pylist([w.row()], _ARROW)
                    w = _Window()
        if w.ids:
            yield pa.RecordBatch.from_pylist([w.row()], _ARROW)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return materialize(rows.mapInArrow(run, INDEX), "index")


def _rows(batches):
    """The windows of an index, one at a time, with column names."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(k)[i].as_buffer() if pa.types.is_binary(batch.schema.field(k).type) else batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}


def _wanted(names: bytes, wanted: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """Places in a window's terms, and numbers, of the terms that are wanted."""
    at, number = [], []
    for k, w in enumerate(names.split(b" ")):
        if (x := wanted.get(w)) is not None:
            at.append(k)
            number.append(x)
    return at, number


def document_counts(index: DataFrame, wanted: dict[bytes, int]) -> dict[int, int]:
    """How many documents hold each wanted term (by its number); terms of no document are left out. Only terms and starts are read."""
    held = index.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        total = np.zeros(len(held.value), np.int64)
        for w in _rows(batches):
            at, number = _wanted(bytes(w["terms"]), held.value)
            total[number] += np.diff(np.frombuffer(w["starts"], np.int32))[at]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    counted = index.select("terms", "starts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in counted.collect()}  # one row per term of a pass, PASS_TERMS at most


def lengths(lens: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 50 + ((50 * n * N) div L) for every document's n; in Python's integers where 64 bits would not do."""
    if not n_terms:
        return np.full(len(lens), 50, np.int64)
    if int(lens.max(initial=0)) * 50 * n_docs < 2**63:
        return 50 + 50 * lens * n_docs // n_terms
    return np.array([50 + 50 * int(n) * n_docs // n_terms for n in lens], np.int64)


class Searcher:
    """The best documents of each item among the windows seen so far."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, top: int):
        self.items, self.weights, self.n_docs, self.n_terms, self.top = items, weights, n_docs, n_terms, top
        self.heaps: list[list[tuple]] = [[] for _ in items]
        self.sums = np.zeros(WINDOW, np.int64)
        self.bits = np.zeros(WINDOW // 8, np.uint8)

    def see(self, w: dict, wanted: dict[bytes, int]) -> None:
        at, number = _wanted(bytes(w["terms"]), wanted)
        if not at:
            return
        starts = np.frombuffer(w["starts"], np.int32)
        slots, tfs = np.frombuffer(w["slots"], np.uint16), np.frombuffer(w["tfs"], np.int64)
        ids, null = np.frombuffer(w["ids"], np.int64), np.frombuffer(w["null_ids"], bool)
        norm = 20 * lengths(np.frombuffer(w["lens"], np.int64), self.n_docs, self.n_terms)
        lists: dict[int, tuple] = {}  # per wanted term: slots, parts, bits
        for k, x in zip(at, number):
            s = slots[starts[k] : starts[k + 1]]
            tf = tfs[starts[k] : starts[k + 1]]
            seen = np.zeros(WINDOW, bool)
            seen[s] = True
            lists[x] = s, self.weights[x] * (1_000_000_000 * tf // (1000 * tf + norm[s])), np.packbits(seen)
        for item, heap in zip(self.items, self.heaps):
            here = [lists[x] for x in item.tolist() if x in lists]
            if not here:
                continue
            for s, parts, bits in here:  # a slot is once in a term's postings
                self.sums[s] += parts
                self.bits |= bits
            touched = np.flatnonzero(np.unpackbits(self.bits))
            self.harvest(heap, touched, ids, null)
            self.sums[touched] = 0
            self.bits[:] = 0

    def harvest(self, heap: list[tuple], touched: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """Put into the heap what belongs among its best: by score, then by id, null ids last."""
        score = self.sums[touched]
        good = score >= (heap[0][0] if len(heap) == self.top else 1)
        touched, score = touched[good], score[good]
        if len(touched) > self.top:  # no more than the best of a window can enter
            best = np.lexsort((ids[touched], null[touched], -score))[: self.top]
            touched, score = touched[best], score[best]
        for x, s in zip(touched.tolist(), score.tolist()):
            entry = (s, not null[x], -int(ids[x]))
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)


def search(index: DataFrame, items: DataFrame, top: int = 50, id_col: str = "item_id", text_col: str = "text", doc_col: str = "doc_id") -> DataFrame:
    """id_col, rank (from 1), doc_col, score: for each item the `top` documents of an index of the highest score above 0.

    A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))); a document's score sums weight * ((10^9 tf) div (1000 tf + 20 m)) over the
    item's terms, once each, m = 50 + (50 n N) div L. Equal scores go by id, null ids last; rows that repeat rank one after the
    other. Items that share an id are one item with the terms of all; null texts have none. Items without a term that a
    document has, and all items of an empty index, have no rows. Other columns are not read.

    The query set is read by the driver in passes of about PASS_TERMS terms, each of which is one job over the index.
    """
    spark = index.sparkSession
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    kind = items.schema[id_col].dataType.simpleString()
    bare = items.select(F.col(id_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = bare.agg(F.coalesce(F.sum(F.octet_length("text") / 2 + 1), F.lit(0))).first()[0]  # no text has more terms than that
    passes = max(1, -(-int(total) // PASS_TERMS))
    found = []
    for p in range(passes):
        wanted: dict[bytes, int] = {}
        of: dict = {}
        for r in bare.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == p).toLocalIterator():
            of.setdefault(r["item"], set()).update(wanted.setdefault(w, len(wanted)) for words in terms_of(r["text"].encode()) for w in words)
        df = document_counts(index, wanted)
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) if x in df else 0 for x in range(len(wanted))], np.int64)
        held = spark.sparkContext.broadcast((wanted, [np.array(sorted(t), np.int64) for t in of.values()], weights))
        names = spark.createDataFrame([(k, i) for k, i in enumerate(of)], f"number long, item {kind}")

        def run(batches, held=held):
            wanted, terms, weights = held.value
            s = Searcher(terms, weights, n_docs, n_terms, top)
            for w in _rows(batches):
                s.see(w, wanted)
            for k, heap in enumerate(s.heaps):
                if heap:
                    score, known, minus = zip(*heap)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(heap), pa.int64()), pa.array([-m if ok else None for m, ok in zip(minus, known)], pa.int64()), pa.array(score, pa.int64())], names=["number", "doc", "score"])

        hits = index.select("terms", "starts", "slots", "tfs", "ids", "null_ids", "lens").mapInArrow(run, "number long, doc long, score long")
        found.append(best_of(hits, top).join(F.broadcast(names), "number").select(F.col("item").alias(id_col), "rank", F.col("doc").alias(doc_col), "score"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def best_of(hits: DataFrame, top: int) -> DataFrame:
    """The `top` of all tasks' hits, with rank. Each item's hits are cut to `top` in SALTS parts first, so no task gets all
    tasks' heaps of an item."""
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    salted = hits.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("number", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order))).where(F.col("rank") <= top).drop("salt")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS l FROM documents),
g AS (SELECT count(*) FILTER (len(l) > 0) AS docs, CAST(sum(len(l)) AS BIGINT) AS total FROM t),
q AS (SELECT DISTINCT item_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS w FROM benchmark),
u AS (SELECT r, doc_id, CAST(len(l) AS BIGINT) AS n, unnest(l) AS w FROM t),
p AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, w, count(*) AS tf FROM u WHERE w IN (SELECT w FROM q) GROUP BY r, w),
d AS (SELECT w, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, g GROUP BY w),
s AS (SELECT q.item_id, p.r, any_value(p.doc_id) AS doc_id, CAST(sum(d.weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * p.n * g.docs) // g.total)))) AS BIGINT) AS score
  FROM q JOIN p USING (w) JOIN d USING (w), g GROUP BY q.item_id, p.r),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""
