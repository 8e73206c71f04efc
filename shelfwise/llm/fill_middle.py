"""Fill-in-the-middle: texts cut into prefix, middle and suffix at code points, and put together in another order.

A batch is worked on as the one buffer of UTF-8 bytes that Arrow holds it in. Each byte's class comes from a table; a byte
begins a code point unless it continues the one before it, which a mask over pairs of neighbouring bytes says. Running sums
of that mask, less their value where a text begins, number the code points of every text at once, and a binary search in
the sums gives the byte of every cut of all texts together. The buffer is gone through in windows that end anywhere, so what
a task holds beside the batch does not grow with its longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: Bytes of a batch that are looked at at a time.
WINDOW = 1 << 20
#: Bytes of texts, or one text, in an output batch.
OUT_BYTES = 4 << 20
MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ("plain", "psm", "spm")

#: 0: a byte of one-byte characters, 1: the first of several, 2: one that continues.
CLASS = np.zeros(256, np.uint8)
CLASS[0x80:0xC0] = 2
CLASS[0xC0:] = 1
#: Whether a byte of the second class begins a code point after one of the first. Where text is no UTF-8, a stray continuing byte after a
#: one-byte character counts as a code point of its own.
BEGINS = np.array([[True, True, True], [True, True, False], [True, True, False]])


def _marked(buf: np.ndarray, starts: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Which bytes of buf[lo:hi] begin a code point; the first byte of a text always does."""
    kind = CLASS[buf[max(lo - 1, 0) : hi]]
    if lo == 0:
        kind = np.concatenate([np.zeros(1, np.uint8), kind])
    mask = BEGINS.ravel()[kind[:-1] * 3 + kind[1:]]
    a, b = np.searchsorted(starts, [lo, hi])
    mask[starts[a:b] - lo] = True
    return mask


def running_counts(buf: np.ndarray, starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The number of code points of buf that begin before each place of `at` (in any order). starts: where non-empty texts begin."""
    order = np.argsort(at, kind="stable")
    places, out, before, done = at[order], np.zeros(len(at), np.int64), 0, 0
    for lo in range(0, len(buf), WINDOW):
        hi = min(lo + WINDOW, len(buf))
        sums = np.cumsum(_marked(buf, starts, lo, hi), dtype=np.int64)
        upto = np.searchsorted(places, hi, side="right")
        here = places[done:upto] - lo
        out[order[done:upto]] = before + np.where(here > 0, sums[here - 1], 0)
        before, done = before + int(sums[-1]), upto
    out[order[done:]] = before
    return out


def places_of(buf: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The least byte before which that many code points of buf have begun and at which the next one begins, for each of
    `counts` (in any order); the end of buf for as many as there are."""
    order = np.argsort(counts, kind="stable")
    want, out, before, done = counts[order], np.full(len(counts), len(buf), np.int64), 0, 0
    for lo in range(0, len(buf), WINDOW):
        hi = min(lo + WINDOW, len(buf))
        sums = np.cumsum(_marked(buf, starts, lo, hi), dtype=np.int64)
        upto = np.searchsorted(want, before + int(sums[-1]))  # the next code point begins in this window
        out[order[done:upto]] = lo + np.searchsorted(sums, want[done:upto] - before, side="right")
        before, done = before + int(sums[-1]), upto
    return out


def cut_batch(buf: np.ndarray, ends: np.ndarray, h: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n, first and second cut in code points, and both cuts in bytes of buf, for texts that lie one after the other.

    ends: len + 1 places in buf where texts begin and end; h: two unsigned numbers per text. Rows of `plain` are counted only.
    Returns n, cuts (2 rows), bytes (2 rows).
    """
    starts = np.unique(ends[:-1][ends[1:] > ends[:-1]])
    base = running_counts(buf, starts, ends)
    n = base[1:] - base[:-1]
    cuts = np.sort(h % (n + 1), axis=0)
    cuts[:, plain] = 0
    # a cut after all code points of a text is at its end, whatever follows
    places = np.where(cuts == n, ends[1:], places_of(buf, starts, (base[:-1] + cuts).ravel()).reshape(2, -1))
    return n, cuts, places


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column's texts and len + 1 places among them; nulls are empty. Nothing is copied but offsets, unless a
    null covers bytes."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def fill_in_middle(docs: DataFrame, keys: list[Column], plain_from: int = 90, spm_below: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n (code points), form, prefix_chars, middle_chars (null if plain), output.

    keys: four columns of unsigned numbers h1 to h4. The prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) code
    points, the middle after the larger. Form is plain if the text is empty, holds a mark or h3 % 100 >= plain_from; else spm if
    h4 % 100 < spm_below, else psm. Output: the text; `<P>`prefix`<S>`suffix`<M>`middle; `<S>`suffix`<P>`prefix`<M>`middle.

    Null texts count as empty. Rows that repeat are rows each; ids may be null; an empty table gives no rows; texts of any
    length are cut whole. Other columns are not read, so their names cannot clash. Null keys count as 0.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    h = [F.coalesce(k, F.lit(0)).cast("long") for k in keys]
    marked = F.contains(text, F.lit(MARKS[0])) | F.contains(text, F.lit(MARKS[1])) | F.contains(text, F.lit(MARKS[2]))
    form = F.when((text == "") | marked | (h[2] % 100 >= plain_from), PLAIN).when(h[3] % 100 < spm_below, SPM).otherwise(PSM)
    rows = docs.select(F.col(id_col).alias("id"), h[0].alias("h1"), h[1].alias("h2"), form.cast("int").alias("form"), text.alias("text"))
    p, s, m = (x.encode() for x in MARKS)

    def run(batches):
        for batch in batches:
            buf, ends = _texts(batch.column(4))
            form = batch.column(3).to_numpy(zero_copy_only=False)
            h = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)])
            n, cuts, places = cut_batch(buf, ends, h, form == PLAIN)
            whole, lo = memoryview(buf), 0
            null = form == PLAIN
            while lo < len(n):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + OUT_BYTES, side="right")) - 1)
                out = []
                for i in range(lo, hi):
                    a, b, c, d = int(ends[i]), int(places[0, i]), int(places[1, i]), int(ends[i + 1])
                    pre, mid, suf = whole[a:b], whole[b:c], whole[c:d]
                    out.append(bytes(whole[a:d]) if null[i] else b"".join((p, pre, s, suf, m, mid) if form[i] == PSM else (s, suf, p, pre, m, mid)))
                part = slice(lo, hi)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n[part]), batch.column(3).slice(lo, hi - lo), pa.array(cuts[0, part], mask=null[part]), pa.array((cuts[1] - cuts[0])[part], mask=null[part]), pa.array(out, pa.binary()).cast(pa.string())],
                    names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )
                lo = hi

    kind = docs.schema[id_col].dataType.simpleString()
    made = rows.mapInArrow(run, f"id {kind}, n long, form int, prefix_chars long, middle_chars long, output string")
    return made.select(F.col("id").alias(id_col), "n", F.element_at(F.array(*map(F.lit, FORMS)), F.col("form") + 1).alias("form"), "prefix_chars", "middle_chars", "output")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from. No mark is in such a text, and none can arise where parts meet."""
    parts = F.split(output, "<P>|<S>|<M>", -1)
    at = lambda *k: F.concat(*(F.get(parts, F.lit(i)) for i in k))
    return F.when(form == "psm", at(1, 3, 2)).when(form == "spm", at(2, 3, 1)).otherwise(output)


def id_keys(doc_id: Column, seed: str = "1:") -> list[Column]:
    """The first four 8-digit groups of the hex SHA-256 of seed and decimal id; a null id counts as no digits."""
    sha = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(sha, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(documents(spark, sf_dir), id_keys(F.col("doc_id")))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = r"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM a),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
