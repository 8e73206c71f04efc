"""Removal of long repeated byte strings with two-stage suffix sorting.

Every string of SPAN bytes has one canonical anchor, the leftmost smallest hash among its K-grams, so two equal strings
have equal anchors. Grams of a short period are taken last, or each start near a run of one byte would be its own anchor.
The starts that share an anchor form a context (their bytes, and SPAN - 1 more); equal contexts that follow each other in a
text are one row with their number. Contexts are counted by (anchor hash, digest): equal contexts settle each other before
any text moves. Where one anchor hash has several
different contexts, one text of each goes to a bucket, and a suffix array of the bucket tells which starts are repeated:
suffixes smaller than their successors are sorted directly, the others are induced by scanning the buckets of first bytes,
and neighbours are compared. Anchors with very many contexts are dealt over several suffix arrays, and what stays single
in each is compared across them by 128-bit fingerprints, dealt by fingerprint.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, mix64, small, text_chunks

SPAN = 400
GRAM = 64
BLOCK = 1 << 19
#: Text of one suffix array, and contexts of one anchor in one of them.
ARRAY_BYTES = 256 << 10
CHUNK = 1000
#: Longest period of grams that are taken last, and bytes of texts in a batch that a task sends on.
PERIOD = 16
SEND_BYTES = 1 << 20
ODD = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def gram_hashes(buf: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of the `length` bytes at each place, built by doubling (any length; empty if buf is shorter)."""
    n = len(buf) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g, out, done, m = buf.astype(np.uint64) + np.uint64(1 + salt), None, 0, 1
    level = 0
    while True:
        if length & m:
            part = g[done : done + n]
            out = part.copy() if out is None else out * ODD[32 + level + salt] + part
            done += m
        if 2 * m > length:
            return mix64(out)
        g = mix64(g[:-m] * ODD[level + salt] + g[m:]) if m == 8 else g[:-m] * ODD[level + salt] + g[m:]
        m, level = 2 * m, level + 1


def periodic(buf: np.ndarray, gram: int) -> np.ndarray:
    """Which grams have a period of at most PERIOD bytes (and a quarter of the gram)."""
    out = np.zeros(max(0, len(buf) - gram + 1), bool)
    for p in range(1, min(PERIOD, gram // 4, len(buf) - 1) + 1):
        same, need = buf[p:] == buf[:-p], gram - p
        if need >= 15 and not (same[: len(same) & ~7].view(np.uint64) == np.uint64(0x0101010101010101)).any():
            continue  # a run of 15 has eight in one word
        edges = np.concatenate([[-1], np.flatnonzero(~same), [len(same)]])
        for k in np.flatnonzero(np.diff(edges) > need):
            out[edges[k] + 1 : edges[k + 1] - need + 1] = True
    return out


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, span: int = SPAN, gram: int = GRAM):
    """(first start, last start, anchor hash) of each run of starts with one anchor; buf holds texts at starts..ends."""
    none = np.zeros(0, np.int64)
    long = ends - starts >= span
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return none, none, none.astype(np.uint64)
    h = gram_hashes(buf, gram)
    cur = ((h >> np.uint64(1)) & ~np.uint64(BLOCK - 1)) | np.arange(len(h), dtype=np.uint64)
    cur[periodic(buf, gram)] |= np.uint64(1 << 63)
    size, width = 1, span - gram + 1
    while size * 2 <= width:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    if size < width:
        cur = np.minimum(cur[: len(cur) - (width - size)], cur[width - size :])
    step = np.zeros(len(cur) + 1, np.int8)
    step[starts] += 1
    step[ends - span + 1] -= 1
    at = np.flatnonzero(np.cumsum(step[:-1]))
    place = (cur[at] & np.uint64(BLOCK - 1)).astype(np.int64)
    cut = np.flatnonzero(np.diff(place)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(at) - 1]])
    return at[first], at[last], h[place[first]]


def blocks(texts: list[bytes], span: int):
    """Yield (buffer, index of each text, its offset in the text, start, end): many texts in a block, or a part of one.
    Parts of a long text overlap by span - 1 bytes, so every start of a string falls into one part."""
    parts, size = [], 0
    for i, b in enumerate(texts):
        for off in range(0, max(1, len(b) - span + 1), BLOCK - span + 1):
            piece = b[off : off + BLOCK] if len(b) > BLOCK else b
            if len(piece) < span:
                continue
            if size + len(piece) > BLOCK and parts:
                yield parts
                parts, size = [], 0
            parts.append((i, off, piece))
            size += len(piece)
    if parts:
        yield parts


def context_rows(texts: list[bytes], span: int, gram: int):
    """Columns text index, first start, number of starts, anchor hash, how many equal contexts follow each other from there,
    digest of the context."""
    out = [[], [], [], [], [], []]
    for parts in blocks(texts, span):
        joined = b"".join(p for _, _, p in parts)
        sizes = np.array([len(p) for _, _, p in parts], np.int64)
        ends = np.cumsum(sizes)
        s1, s2, h = anchors(np.frombuffer(joined, np.uint8), ends - sizes, ends, span, gram)
        n = s2 - s1 + 1
        digests = [hashlib.blake2b(joined[a : b + span], digest_size=16).digest() for a, b in zip(s1.tolist(), s2.tolist())]
        new = np.ones(len(s1), bool)
        like = np.flatnonzero((h[1:] == h[:-1]) & (n[1:] == n[:-1]) & (np.diff(s1) == n[:-1])) + 1
        new[like] = [digests[k] != digests[k - 1] for k in like.tolist()]
        at = np.flatnonzero(new)
        s1, n, h, reps = s1[at], n[at], h[at], np.diff(np.append(at, len(new)))
        own = np.searchsorted(ends, s1, side="right")
        shift = np.array([off for _, off, _ in parts], np.int64) - (ends - sizes)
        out[0].append(np.array([i for i, _, _ in parts], np.int64)[own])
        out[1].append(s1 + shift[own])
        out[2].append(n)
        out[3].append(h.view(np.int64))
        out[4].append(reps)
        out[5] += [digests[k] for k in at.tolist()]
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out[:5]] + [out[5]]


def suffix_array(text: bytes, depth: int) -> np.ndarray:
    """Suffixes in the order of at least their first `depth` bytes, by two-stage sorting."""
    t = np.frombuffer(text, np.uint8)
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    # type: smaller than the successor; runs of one byte take the type of the run's end, and the last suffix is larger
    change = np.concatenate([np.flatnonzero(t[1:] != t[:-1]), [n - 1]])
    nxt = change[np.searchsorted(change, np.arange(n))]
    rising = np.zeros(n, bool)
    inner = nxt < n - 1
    rising[inner] = t[nxt[inner]] < t[nxt[inner] + 1]
    direct = np.flatnonzero(rising).tolist()
    keys = [text[i : i + depth] for i in direct]
    order = sorted(range(len(direct)), key=keys.__getitem__)
    small_ones = np.array(direct, np.int64)[order] if direct else np.zeros(0, np.int64)
    del keys
    bounds = np.searchsorted(t[small_ones], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        layer = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        bucket = []
        while len(layer):
            bucket.append(layer)
            layer = layer[layer > 0] - 1
            layer = layer[t[layer] == c]
        bucket.append(small_ones[bounds[c] : bounds[c + 1]])
        done = np.concatenate(bucket)
        waiting[c] = []
        if not len(done):
            continue
        out.append(done)
        before = done[done > 0] - 1
        before = before[t[before] > c]  # larger than their successors: induced here, in the order of those
        kinds = t[before]
        by = np.argsort(kinds, kind="stable")
        chars, first = np.unique(kinds[by], return_index=True)
        for ch, part in zip(chars.tolist(), np.split(before[by], first[1:])):
            waiting[ch].append(part)
    return np.concatenate(out)


def common_prefixes(text: bytes, sa: np.ndarray, most: int) -> np.ndarray:
    """Lengths, up to `most`, of the common prefixes of neighbours in an array of suffixes. Eight bytes are compared at a time,
    and only where all before them were equal."""
    buf = np.frombuffer(text + b"\xff" * (most + 8), np.uint8)
    words = np.lib.stride_tricks.as_strided(buf, (len(buf) - 8, 8), (1, 1))
    out, left = np.zeros(max(0, len(sa) - 1), np.int64), np.arange(max(0, len(sa) - 1))
    for at in range(0, most, 8):
        same = words[sa[left] + at] == words[sa[left + 1] + at]
        whole = same.all(1)
        out[left] += np.where(whole, 8, same.argmin(1))
        left = left[whole]
        if not len(left):
            break
    return np.minimum(out, most)


def repeated_starts(contexts: list[bytes], own: list[int], span: int) -> list[np.ndarray]:
    """For each context, which of its own starts have a string of span bytes that another own start has too."""
    text = b"\xff".join(contexts) + b"\xff"  # 0xFF is no byte of UTF-8
    sizes = np.array([len(c) + 1 for c in contexts], np.int64)
    begin = np.cumsum(sizes) - sizes
    sa = suffix_array(text, span)
    where = np.searchsorted(begin, sa, side="right") - 1
    is_own = sa - begin[where] < np.array(own, np.int64)[where]
    sa = sa[is_own]
    flag = np.zeros(len(text), bool)
    reach = np.flatnonzero(common_prefixes(text, sa, span) >= span)
    flag[sa[reach]] = flag[sa[reach + 1]] = True
    return [np.flatnonzero(flag[s : s + k]) for s, k in zip(begin.tolist(), own)]


def runs_of(starts: np.ndarray, span: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by strings of span bytes at sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > span) + 1
    return [(int(p[0]), int(p[-1]) + span) for p in np.split(starts, cut)]


def merged(spans) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the spans (lo, hi) cover; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def objects(values: list) -> pd.Series:
    """A column of objects, also where there are none: an empty list alone would be one of floats, which Arrow can't make spans of."""
    return pd.Series(values, dtype=object)


SPANS = "array<struct<lo:int,hi:int>>"


def _key(col) -> list[F.Column]:
    text = F.coalesce(col, F.lit(""))
    return [F.xxhash64(F.lit(1), text).alias("k1"), F.xxhash64(F.lit(2), F.reverse(F.substring(text, 1, 64)), text).alias("k2")]


def find_repeats(docs: DataFrame, text_col: str, span: int, gram: int) -> DataFrame:
    """k1, k2 (128-bit key of a text), spans: repeated runs of bytes, for texts that have any."""

    def make(batches):
        for batch in batches:
            k1, k2 = batch.column(0), batch.column(1)
            for first, texts in text_chunks(batch.select(["_text"]), "_text"):
                who, s1, n, h, reps, dig = context_rows(texts, span, gram)
                at = pa.array(who + first)
                yield pa.RecordBatch.from_arrays(
                    [k1.take(at), k2.take(at), pa.array(s1, pa.int32()), pa.array(n, pa.int32()), pa.array(h, pa.int64()), pa.array(reps, pa.int32()), pa.array(dig, pa.binary())],
                    names=["k1", "k2", "s1", "own", "h", "reps", "dig"],
                )

    keyed = docs.select(*_key(F.col(text_col)), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    long = keyed.where(F.octet_length("_text") >= span)
    table = materialize(long.mapInArrow(make, "k1 long, k2 long, s1 int, own int, h long, reps int, dig binary"), "contexts")

    hot = materialize(table.groupBy("h").agg(F.sum("reps").alias("n")).where("n > 1").select("h"), "hot-anchors")
    hot_rows = materialize(table.join(hot, "h", "left_semi"), "hot-contexts")
    groups = materialize(hot_rows.groupBy("h", "dig").agg(F.sum("reps").alias("n"), F.min(F.struct("k1", "k2", "s1", "own")).alias("at")), "groups")
    several = materialize(groups.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "several")
    picked = groups.join(several, "h").select("h", "dig", "at.*", F.ceil(F.col("c") / CHUNK).cast("int").alias("chunks"))
    wanted = materialize(picked.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "dig", "s1", "own", "chunks")).alias("want"), F.sum(F.col("own") + span).alias("size")), "wanted")
    n_wanted, size = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_buckets = max(1, -(-size // ARRAY_BYTES))

    def cut(batches):
        for batch in batches:
            wants = batch.column(batch.schema.get_field_index("want"))
            cuts, rows = wants.offsets.to_pylist(), pa.RecordBatch.from_struct_array(wants.values)
            s1, own = rows["s1"].to_numpy(), rows["own"].to_numpy()
            rows, at, out, held = rows.select(["h", "dig", "own", "chunks"]), [], [], 0
            for first, texts in text_chunks(batch.select(["_text"]), "_text"):
                for i, b in enumerate(texts, first):
                    for k in range(cuts[i], cuts[i + 1]):
                        at.append(k)
                        out.append(b[s1[k] : s1[k] + own[k] + span - 1])
                        held += len(out[-1])
                        if held >= SEND_BYTES:
                            yield pa.RecordBatch.from_arrays([*rows.take(pa.array(at, pa.int64())).columns, pa.array(out, pa.binary())], schema=CUT)
                            at, out, held = [], [], 0
            yield pa.RecordBatch.from_arrays([*rows.take(pa.array(at, pa.int64())).columns, pa.array(out, pa.binary())], schema=CUT)

    CUT = pa.schema([("h", pa.int64()), ("dig", pa.binary()), ("own", pa.int32()), ("chunks", pa.int32()), ("text", pa.binary())])
    near = long.join(small(wanted.select("k1", "k2"), n_wanted, 32), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    texts = materialize(near.join(wanted, ["k1", "k2"]).select("_text", "want").mapInArrow(cut, "h long, dig binary, own int, chunks int, text binary"), "cut")

    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        got = repeated_starts(pdf["text"].tolist(), pdf["own"].tolist(), span)
        keep = [i for i, g in enumerate(got) if len(g)]
        return pd.DataFrame({"h": pdf["h"].iloc[keep].to_numpy(), "dig": objects(pdf["dig"].iloc[keep].tolist()), "spans": objects([[{"lo": a, "hi": b} for a, b in runs_of(got[i], span)] for i in keep])})

    chunk = F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("dig"), F.col("chunks"))).otherwise(0)
    bucketed = texts.withColumn("bucket", F.pmod(F.xxhash64("h", chunk), F.lit(n_buckets)))
    found = bucketed.groupBy("bucket").applyInPandas(sort, f"h long, dig binary, spans {SPANS}")
    if not texts.where("chunks > 1").isEmpty():
        found = found.unionByName(across(texts.where("chunks > 1"), span))
    whole = groups.where("n > 1").select("h", "dig", F.array(F.struct(F.lit(0).alias("lo"), (F.col("at.own") + span - 1).alias("hi"))).alias("spans"))
    marks = materialize(found.unionByName(whole), "marks")
    placed = hot_rows.join(marks, ["h", "dig"]).select("k1", "k2", F.transform("spans", lambda s: F.struct((s["lo"] + F.col("s1")).alias("lo"), (s["hi"] + F.col("s1") + (F.col("reps") - 1) * F.col("own")).alias("hi"))).alias("spans"))
    sets = placed.groupBy("k1", "k2").agg(F.collect_set("spans").alias("many")).select("k1", "k2", F.flatten("many").alias("spans"))

    def join_up(batches):
        for batch in batches:
            out = [[{"lo": a, "hi": b} for a, b in merged((s["lo"], s["hi"]) for s in x.as_py())] for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))], names=["k1", "k2", "spans"])

    return sets.mapInArrow(join_up, f"k1 long, k2 long, spans {SPANS}")


def across(texts: DataFrame, span: int) -> DataFrame:
    """Repeated starts among contexts of very frequent anchors, whatever array they were in: fingerprints of the strings,
    packed into a few binary rows and dealt by fingerprint, so no task holds all contexts of an anchor."""
    total = texts.agg(F.sum("own")).first()[0]
    parts = max(8, -(-total * 26 // (4 << 20)))
    kind = np.dtype([("a", "<u8"), ("b", "<u8"), ("ctx", "<i4"), ("at", "<i4")])

    def spread(batches):
        for batch in batches:
            rows = batch.to_pydict()
            all_rows = []
            for i, b in enumerate(rows["text"]):
                buf = np.frombuffer(b, np.uint8)
                x = np.zeros(rows["own"][i], kind)
                x["a"], x["b"] = gram_hashes(buf, span, 3)[: len(x)], gram_hashes(buf, span, 9)[: len(x)]
                x["ctx"], x["at"] = i, np.arange(len(x))
                all_rows.append(x)
            x = np.concatenate(all_rows)
            deal = (x["a"] % np.uint64(parts)).astype(np.int64)
            x, deal = x[order := np.argsort(deal, kind="stable")], deal[order]
            cuts = np.searchsorted(deal, np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cuts)):
                y = x[cuts[p] : cuts[p + 1]]
                who, ctx = np.unique(y["ctx"], return_inverse=True)
                y["ctx"] = ctx
                ids = b"".join(rows["h"][i].to_bytes(8, "little", signed=True) + rows["dig"][i] for i in who)
                yield pa.RecordBatch.from_pylist([{"part": int(p), "ids": ids, "strings": y.tobytes()}], schema=SPREAD)

    SPREAD = pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("strings", pa.binary())])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, xs = [], []
        for i, s in zip(pdf["ids"], pdf["strings"]):
            y = np.frombuffer(s, kind).copy()
            y["ctx"] += len(ids)
            ids += [i[k : k + 24] for k in range(0, len(i), 24)]
            xs.append(y)
        x = np.concatenate(xs)
        x = x[np.lexsort((x["b"], x["a"]))]
        same = (x["a"][1:] == x["a"][:-1]) & (x["b"][1:] == x["b"][:-1])
        hit = np.zeros(len(x), bool)
        hit[1:] |= same
        hit[:-1] |= same
        x = x[hit]
        x = x[np.lexsort((x["at"], x["ctx"]))]
        cuts = np.flatnonzero(np.diff(x["ctx"])) + 1
        got = [(ids[p["ctx"][0]], runs_of(p["at"].astype(np.int64), span)) for p in np.split(x, cuts)] if len(x) else []
        return pd.DataFrame({"h": np.array([int.from_bytes(k[:8], "little", signed=True) for k, _ in got], np.int64), "dig": objects([k[8:] for k, _ in got]), "spans": objects([[{"lo": a, "hi": b} for a, b in r] for _, r in got])})

    packed = texts.select("h", "dig", "own", "text").mapInArrow(spread, "part int, ids binary, strings binary")
    return packed.groupBy("part").applyInPandas(meet, f"h long, dig binary, spans {SPANS}")


def remove_repeats(docs: DataFrame, keep: list[str], text_col: str = "text", span: int = SPAN, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """The columns `keep` of docs and n_bytes, n_removed, n_spans, kept_sha256 (and kept_text, bytes) for every row.

    A byte goes if some string of span bytes that covers it starts anywhere else too, in the same text or another row's;
    strings are judged on the input. Rows that repeat are copies of each other and lose all such strings. Null texts are
    empty; texts under span bytes stay whole; texts of any length are read whole; an empty table gives no rows. Other columns
    are not read, kept ones may have any name but those of the results.
    """
    spans = materialize(find_repeats(docs, text_col, span, gram), "spans")
    n, runs = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = F.struct(*keep).alias("kept")  # in a struct, so their names cannot clash
    joined = docs.select(kept, text.alias("_text"), *_key(F.col(text_col))).join(small(spans, 1, 64 * n + 32 * runs), ["k1", "k2"], "left")

    def run(batches):
        for batch in batches:
            marks = batch.column(batch.schema.get_field_index("spans"))
            cols = [[], [], [], [], []]
            for first, texts in text_chunks(batch.select(["_text"]), "_text"):
                for i, b in enumerate(texts):
                    todo = [(x["lo"], x["hi"]) for x in marks[first + i].as_py() or ()]
                    parts, at = [], 0
                    for lo, hi in todo:
                        parts.append(b[at:lo])
                        at = hi
                    left = b"".join([*parts, b[at:]])
                    for c, v in zip(cols, (len(b), sum(hi - lo for lo, hi in todo), len(todo), hashlib.sha256(left).hexdigest(), left if with_text else None)):
                        c.append(v)
            arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())] + [pa.array(cols[4], pa.binary())] * with_text
            yield pa.RecordBatch.from_arrays([*(batch.column(0).field(i) for i in range(len(keep))), *arrays], names=[*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * with_text])

    head = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    tail = ", kept_text binary" if with_text else ""
    return joined.select("kept", "_text", "spans").mapInArrow(run, head + "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + tail)


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), ["doc_id"])


OP2_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, s, md5(b[s:s + 399]) AS h FROM (SELECT doc_id, b, unnest(range(1, n - 398)) AS s FROM d WHERE n >= 400)),
hot AS (SELECT h FROM p GROUP BY h HAVING count(*) > 1),
dup AS (SELECT doc_id, s, s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) > 400 AS gap FROM p SEMI JOIN hot USING (h)),
grp AS (SELECT doc_id, s, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM dup),
runs AS (SELECT doc_id, min(s) AS lo, max(s) + 400 AS hi FROM grp GROUP BY doc_id, g),
kept AS (SELECT doc_id, lag(hi, 1, 1) OVER w AS a, lo - 1 AS z FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY lo)
  UNION ALL SELECT doc_id, coalesce(max(hi), 1), any_value(n) FROM d LEFT JOIN runs USING (doc_id) GROUP BY doc_id),
left_over AS (SELECT doc_id, sha256(from_hex(string_agg(CASE WHEN a <= z THEN hex(b[a:z]) ELSE '' END, '' ORDER BY a))) AS kept_sha256 FROM kept JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(sum(hi - lo), 0) AS BIGINT) AS n_removed, count(hi) AS n_spans, any_value(kept_sha256) AS kept_sha256
FROM d JOIN left_over USING (doc_id) LEFT JOIN runs USING (doc_id) GROUP BY d.doc_id, n
"""
