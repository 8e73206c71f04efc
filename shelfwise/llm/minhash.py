"""Near-duplicate groups by MinHash, banding, signature verification, full-set verification and connected components.

Rows with equal shingle sets are one node. Each node's signature has many universal hash minima; bands of it are bucket
keys. First every node of a bucket meets the bucket's random pivot only, and the components of the verified links are
built. Then nodes of different components that share a bucket are compared by signature in blocks of bounded size, which
give a spanning forest of the candidates instead of all pairs. Each tree of that forest is a closed family: its nodes' full
sets meet in blocks, where all intersections are counted at once, and again only a spanning forest of the links leaves. So
large groups never make all their pairs, no candidate is dropped, and every link is confirmed on the full sets. Buckets and
families too large for that are split first, by the rarest shingles of their sets (`rare_links`).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, mix64, pieces, small, text_chunks
from .components import components

BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: Signature agreement below which a pair is refuted: over 4 deviations under a similarity of 0.8 for 96 minima.
REFUTE = 0.62
PIVOTS = 2
BLOCK = 256
#: Copies of a node in the tasks of one bucket or family; where there would be more, rarest shingles split the family first.
WIDE = 4
#: Nodes with one rare shingle that meet in a task, or half of them where there are more.
MEETING = 4096
_rng = np.random.default_rng(17)
MUL = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
ODD = _rng.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POW = np.cumprod(np.concatenate([[np.uint64(1)], np.full(4095, 0x9E3779B97F4A7C15, np.uint64)]), dtype=np.uint64)
_STEP = (_POW[-1:] * np.uint64(0x9E3779B97F4A7C15))[0]  # the power at 4096


PIECE = 1 << 20


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """64-bit hashes of the words (runs of bytes other than ASCII white space, A-Z lowered) of each text, in order.
    About PIECE bytes are hashed at a time, longer texts in pieces cut at white space."""
    out, group, size = [], [], 0
    for b in texts:
        if size + len(b) > PIECE and group:
            out += _hash_group(group)
            group, size = [], 0
        if len(b) <= PIECE:
            group.append(b)
            size += len(b)
            continue
        parts = [h for p in pieces(b, PIECE) for h in _hash_group([p])]
        out.append(np.concatenate(parts))
    return out + (_hash_group(group) if group else [])


def _hash_group(texts: list[bytes]) -> list[np.ndarray]:
    joined = b"\n".join(texts).translate(LOWER)
    buf = np.frombuffer(joined + b"\n", np.uint8)
    space = IS_SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    first, last = edge[0::2], edge[1::2]
    if not len(first):
        return [np.zeros(0, np.uint64) for _ in texts]
    size = last - first
    inside = np.flatnonzero(~space)
    k = inside - np.repeat(first, size)
    weight = _POW[k & 4095]
    for _ in range(int(size.max() >> 12)):  # words over 4095 bytes
        k = k - 4096
        weight = np.where(k >= 0, weight * _STEP, weight)
    sums = np.add.reduceat((buf[inside].astype(np.uint64) + np.uint64(1)) * weight, np.cumsum(size) - size)
    words = mix64(sums + size.astype(np.uint64) * ODD[15])
    ends = np.cumsum([len(b) + 1 for b in texts])
    return np.split(words, np.searchsorted(first, ends[:-1]))


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct 64-bit shingles of n words; with fewer words the whole sequence is one; without words, none."""
    if not len(words):
        return words
    m = min(n, len(words))
    acc = np.full(len(words) - m + 1, m, np.uint64)
    for j in range(m):
        acc = mix64(acc * ODD[0] + words[j : j + len(acc)])
    return np.unique(acc)


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 2**32 - 1, np.uint64)
    for i in range(0, len(shingles), 4096):
        out = np.minimum(out, ((MUL[:, None] * shingles[None, i : i + 4096] + ADD[:, None]) >> np.uint64(32)).min(1))
    return out.astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    acc = np.arange(BANDS, dtype=np.uint64)
    for part in sig.reshape(BANDS, ROWS).T.astype(np.uint64):
        acc = mix64(acc * ODD[1] + part)
    return acc.view(np.int64)


def similar(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def _keys(text) -> list[F.Column]:
    return [F.xxhash64(F.lit(1), text).alias("k1"), F.xxhash64(F.lit(2), F.reverse(F.substring(text, 1, 64)), text).alias("k2")]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (smallest id reachable over links of at least `percent`
    similarity, itself included).

    Texts that are null, empty or without words have no shingles and stand alone; rows with equal sets are linked; rows
    that share an id share a component only if their texts are linked. Null ids take the smallest non-null id of their
    component. Other columns are not read, texts are read whole, whatever their length, and an empty table gives no rows.
    """
    spark_id = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))

    def sign(batches):
        for batch in batches:
            n_set, digs, sigs, bands = [], [], [], []
            for _, texts in text_chunks(batch.select(["_text"]), "_text"):
                for words in word_hashes(texts):
                    s = shingle_set(words, shingle)
                    n_set.append(len(s))
                    sig = signature(s) if len(s) else None
                    digs.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sigs.append(sig.tobytes() if len(s) else None)
                    bands.append(band_keys(sig) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(n_set, pa.int64()), pa.array(digs, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["id", "k1", "k2", "n", "node", "sig", "bands"],
            )

    keyed = docs.select(F.col(id_col).alias("id"), *_keys(text), text.alias("_text"))
    table = materialize(keyed.mapInArrow(sign, f"id {spark_id}, k1 long, k2 long, n long, node binary, sig binary, bands array<long>"), "signatures")
    nodes = table.where("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.min(F.struct("k1", "k2")).alias("k"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    nodes = materialize(nodes, "nodes")

    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(F.xxhash64("node", "bucket"), "node")).alias("p")).where("m > 1")
    shared = materialize(shared.select("bucket", "m", F.col("p.node").alias("pivot")), "buckets")
    members = materialize(banded.join(shared, "bucket"), "members")
    sigs = materialize(nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "n", "sig", "k"), "member-signatures")

    # each node with the pivots of its buckets
    stars = members.where("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    left = sigs.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    right = sigs.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))

    def estimate(batches):
        for batch in batches:
            sa, sb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, HASHES) for i in (2, 3))
            est = (sa == sb).mean(1)
            keep = pa.array(np.flatnonzero(est >= REFUTE))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(est[est >= REFUTE])], names=["a", "b", "est"])

    sized = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    scored = stars.join(left, "a").join(right, "b").where(sized).select("a", "b", "sa", "sb").mapInArrow(estimate, "a binary, b binary, est double")
    best = scored.groupBy("a").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("est", "b")))), 1, PIVOTS).alias("best"))
    first_links = verify(best.select("a", F.explode("best.b").alias("b")), sigs, keyed, shingle, percent)
    roots = materialize(components(first_links), "roots")

    # pairs of different components that share a bucket
    parts = members.join(small(roots, roots.count(), 64), "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("part"))
    mixed = parts.groupBy("bucket").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo != hi").select("bucket")
    open_rows = materialize(parts.join(materialize(mixed, "mixed"), "bucket", "left_semi"), "open")
    by_part = open_rows.groupBy("bucket", "part").count()
    major = by_part.groupBy("bucket").agg(F.max(F.struct("count", "part")).alias("top"), F.sum("count").alias("m"))
    major = materialize(major.select("bucket", F.col("top.part").alias("major"), F.ceil(F.col("top.count") / BLOCK).cast("int").alias("x"), F.ceil((F.col("m") - F.col("top.count")) / BLOCK).cast("int").alias("y")), "majors")
    # a node goes to y tasks, or to x + y if it is not of the largest component; buckets where that is too many give a star, and
    # their nodes are a family that is split by its rarest shingles
    star = open_rows.join(major.where(f"y > {WIDE}").select("bucket"), "bucket", "left_semi").join(shared.select("bucket", "pivot"), "bucket").where("node != pivot")
    star = star.select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct()
    major = major.where(f"y <= {WIDE}")
    placed = open_rows.join(major, "bucket").withColumn("is_major", F.col("part") == F.col("major"))
    own = F.when(F.col("is_major"), F.pmod(F.xxhash64("node"), "x")).otherwise(F.pmod(F.xxhash64("node"), "y")).cast("int")
    # tasks of a bucket: each block of the largest component with each block of the rest, and the rest's blocks with each other
    with_major = F.transform(F.sequence(F.lit(0), F.col("x") - 1), lambda i: F.struct(i.alias("i"), F.col("own").alias("j")))
    with_rest = F.transform(F.sequence(F.lit(0), F.col("y") - 1), lambda j: F.struct((F.lit(-1) - F.least(j, "own")).alias("i"), F.greatest(j, "own").alias("j")))
    for_major = F.transform(F.sequence(F.lit(0), F.col("y") - 1), lambda j: F.struct(F.col("own").alias("i"), j.alias("j")))
    tasks = placed.withColumn("own", own).withColumn("task", F.explode(F.when(F.col("is_major"), for_major).otherwise(F.concat(with_major, with_rest))))
    work = tasks.select("bucket", "task", "part", "is_major", "node").join(sigs.select("node", "n", "sig"), "node")
    work = work.repartition("bucket", "task").sortWithinPartitions("bucket", "task")

    def compare(group: pd.DataFrame) -> list[tuple]:
        return [(x, y) for x, y in _forest(group["node"].to_numpy(), _candidates(group, percent))]

    trees = by_task(work.select("bucket", "task.i", "task.j", "part", "is_major", "node", "n", "sig"), ["bucket", "i", "j"], compare, "u binary, v binary")
    trees = materialize(trees.unionByName(star), "trees")
    if not trees.isEmpty():
        more = family_links(trees, open_rows, sigs, keyed, shingle, percent)
        roots = materialize(components(first_links.unionByName(more)), "roots")

    # nodes of components of two or more; the others' component is their own smallest id
    grouped = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    grouped = materialize(grouped.join(nodes.select("node", "least"), "node"), "grouped")
    lowest = materialize(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "lowest")
    joined = materialize(grouped.join(small(lowest, lowest.count(), 64), "root").select("node", "component_id"), "joined")
    named = nodes.select("node", "least").join(small(joined, joined.count(), 64), "node", "left")
    named = materialize(named.select("node", F.coalesce("component_id", "least").alias("component_id")), "named")
    out = table.select("id", "n", "node").join(small(named, named.count(), 48), "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def by_task(rows: DataFrame, key: list[str], work, schema: str) -> DataFrame:
    """work(rows of one key) for every key of rows that are sorted by key in their partitions; it returns tuples of schema."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        held = None
        for pdf in frames:
            pdf = pd.concat([held, pdf], ignore_index=True) if held is not None else pdf
            same = np.ones(max(0, len(pdf) - 1), bool)
            for c in key:
                v = pdf[c].to_numpy()
                same &= v[1:] == v[:-1]
            cuts = [0, *(np.flatnonzero(~same) + 1).tolist()]
            held = pdf.iloc[cuts[-1] :] if len(pdf) else None  # the last task may go on in the next batch
            yield pd.DataFrame([x for a, b in zip(cuts, cuts[1:]) for x in work(pdf.iloc[a:b])], columns=names)
        if held is not None:
            yield pd.DataFrame(work(held), columns=names)

    return rows.mapInPandas(run, schema)


def _forest(node: np.ndarray, linked: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Edges of a spanning forest of the graph with the boolean matrix `linked`."""
    fresh, out = np.ones(len(node), bool), []
    for s in range(len(node)):
        if not fresh[s]:
            continue
        fresh[s], stack = False, [s]
        while stack:
            a = stack.pop()
            near = np.flatnonzero(linked[a] & fresh)
            fresh[near] = False
            out += [(node[a], node[b]) for b in near.tolist()]
            stack += near.tolist()
    return out


def _candidates(group: pd.DataFrame, percent: int) -> np.ndarray:
    """Which pairs of a task's nodes are of different components and refuted by neither sizes nor signatures."""
    sig = np.frombuffer(b"".join(group["sig"]), np.uint32).reshape(-1, HASHES)
    n, major = group["n"].to_numpy(np.int64), group["is_major"].to_numpy()
    part = np.unique(group["part"].to_numpy(), return_inverse=True)[1]
    ok = (part[:, None] != part[None]) & (100 * np.minimum(n[:, None], n[None]) >= percent * np.maximum(n[:, None], n[None]))
    if major.any():  # only across; the rest's own pairs have tasks of their own
        ok &= major[:, None] != major[None]
    a, b = np.nonzero(np.triu(ok))
    for i in range(0, len(a), 1 << 16):
        x, y = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
        ok[x, y] = (sig[x] == sig[y]).sum(1) >= REFUTE * HASHES
    return np.triu(ok) | np.triu(ok).T


def families(trees: DataFrame, nodes: DataFrame) -> DataFrame:
    """root, node, blocks and the other columns of nodes (node, part, n), for the nodes of each tree; blocks says how many
    parts a family is cut into to be compared."""
    roots = components(trees)
    named = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).join(nodes, "node")
    named = materialize(named, "families")
    sizes = named.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / (2 * BLOCK)), F.ceil(F.sum("n") * 8 / (8 << 20))).cast("int").alias("blocks"))
    return named.join(materialize(sizes, "family-sizes"), "root")


def rare_links(named: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """A spanning forest (u, v) of candidates within families (root, node, part, n), found by their rarest shingles.

    Linked sets of sizes a and b share at least percent of the larger one. Of a node's shingles only those that another node
    of the family has too can be shared, so a node with too few of these has no link. The others are put in order of their
    frequency in the family: the first shingle that two linked sets have in common is, in each, among the first ones
    that leave enough behind it. Each node sends these few; nodes that meet at one are candidates if sizes and what is
    left behind allow a link. All rows are linear in the sets' sizes.
    """
    words = named.select("root", "node").join(held, "node")

    def explode(batches):
        for batch in batches:
            sets = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(2)]
            sizes = np.array([len(x) for x in sets], np.int64)
            for lo in range(0, len(sets), 64):
                at = pa.array(np.repeat(np.arange(lo, lo + len(sets[lo : lo + 64])), sizes[lo : lo + 64]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(sets[lo : lo + 64]))], names=["root", "node", "token"])

    tokens = materialize(words.select("root", "node", "words").mapInArrow(explode, "root binary, node binary, token long").select("node", F.xxhash64("root", "token").alias("t")), "family-tokens")
    common = materialize(tokens.groupBy("t").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "common-tokens")
    per_node = tokens.join(common, "t").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("ts"))
    per_node = per_node.join(named.select("root", "node", "part", "n"), "node").withColumn("s", F.size("ts"))
    need = F.ceil(F.col("n") * percent / 100).cast("int")
    per_node = per_node.where(F.col("s") >= need)
    first = materialize(per_node.select("node", F.xxhash64("part").alias("part"), "n", "s", F.posexplode(F.slice("ts", F.lit(1), F.col("s") - need + 1)).alias("at", "x")).select("node", "part", "n", "s", "at", "x.t"), "rarest")
    # a shingle among the rarest of very many nodes is cut into blocks, two of which meet in each task
    met = materialize(first.groupBy("t").agg(F.count(F.lit(1)).alias("m"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo != hi").select("t", F.ceil(F.col("m") / MEETING).cast("int").alias("blocks")), "meetings")
    tasks = first.join(met, "t").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    ends = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, "own").alias("i"), F.greatest(j, "own").alias("j")))
    rows = tasks.withColumn("task", F.explode(ends)).select("t", "task.i", "task.j", "node", "part", "n", "s", "at")
    rows = rows.repartition("t", "i", "j").sortWithinPartitions("t", "i", "j")

    def meet(group: pd.DataFrame) -> list[tuple]:
        group = group.sort_values("n", kind="stable")
        node, part, n, s, at = (group[c].to_numpy() for c in ("node", "part", "n", "s", "at"))
        n, left = n.astype(np.int64), s.astype(np.int64) - at  # shingles from this one on
        # partners that are not smaller: at most 100 / percent as large, and small enough for what is left to suffice
        most = np.minimum(n * 100 // percent, left * (100 + percent) // percent - n)
        lo, hi = np.arange(1, len(n) + 1), np.searchsorted(n, most, side="right")
        label, out = np.arange(len(n)), []
        for a in np.flatnonzero(hi > lo).tolist():
            b = np.arange(lo[a], hi[a])
            b = b[(label[b] != label[a]) & (part[b] != part[a]) & (left[b] * (100 + percent) >= percent * (n[a] + n[b]))]
            if len(b):
                old, one = np.unique(label[b], return_index=True)
                out += [(node[a], node[x]) for x in b[one].tolist()]
                label[np.isin(label, old)] = label[a]
        return out

    return materialize(by_task(rows, ["t", "i", "j"], meet, "u binary, v binary").distinct(), "rare-trees")


def family_links(trees: DataFrame, open_rows: DataFrame, sigs: DataFrame, keyed: DataFrame, shingle: int, percent: int) -> DataFrame:
    """A spanning forest of the links (u, v) between different components within each tree's nodes, from their full sets."""
    nodes = open_rows.select("node", "part").distinct().join(sigs.select("node", "n"), "node")
    named = families(trees, nodes)
    held = node_sets(named.select("node"), sigs, keyed, shingle)
    wide = materialize(named.where(f"blocks > {WIDE}"), "wide")
    if not wide.isEmpty():
        split = families(rare_links(wide, held, percent), nodes)
        named = named.where(f"blocks <= {WIDE}").unionByName(split.select(named.columns))
    named = materialize(named, "compared")
    tasks = named.withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    ends = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, "own").alias("i"), F.greatest(j, "own").alias("j")))
    tasks = tasks.withColumn("task", F.explode(ends)).select("root", "task.i", "task.j", "part", "node")
    rows = tasks.join(held, "node").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")

    def link(group: pd.DataFrame) -> list[tuple]:
        sets = [np.frombuffer(x, np.uint64) for x in group["words"]]
        size = np.array([len(x) for x in sets], np.float64)
        _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), size.astype(np.int64))
        used = times > 1  # shingles of one node only are in no intersection
        rank = np.cumsum(used) - 1
        row, col = row[used[col]], rank[col[used[col]]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        both = np.zeros((len(sets), len(sets)), np.float32)  # counts under 2 ** 24 are exact in each step
        total = np.zeros_like(both, dtype=np.float64)
        for lo in range(0, int(used.sum()), 4096):
            a, b = np.searchsorted(col, [lo, lo + 4096])
            m = np.zeros((len(sets), 4096), np.float32)
            m[row[a:b], col[a:b] - lo] = 1
            np.matmul(m, m.T, out=both)
            total += both
        part = np.unique(group["part"].to_numpy(), return_inverse=True)[1]
        ok = (part[:, None] != part[None]) & (100 * total >= percent * (size[:, None] + size[None] - total))
        return _forest(group["node"].to_numpy(), ok)

    return materialize(by_task(rows.select("root", "i", "j", "part", "node", "words"), ["root", "i", "j"], link, "u binary, v binary"), "family-links")


def node_sets(nodes: DataFrame, sigs: DataFrame, keyed: DataFrame, shingle: int) -> DataFrame:
    """node, words: the full shingle sets, made anew from the nodes' texts."""
    ends = materialize(nodes.distinct().join(sigs, "node").select("node", "k.k1", "k.k2"), "ends")

    def sets(batches):
        for batch in batches:
            for first, texts in text_chunks(batch.select(["_text"]), "_text"):
                got = [shingle_set(w, shingle).tobytes() for w in word_hashes(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(got, pa.binary())], names=["node", "words"])

    texts = keyed.select("k1", "k2", "_text").join(small(ends, ends.count(), 64), ["k1", "k2"])
    return materialize(texts.select("node", "_text").mapInArrow(sets, "node binary, words binary").dropDuplicates(["node"]), "sets")


def verify(pairs: DataFrame, sigs: DataFrame, keyed: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The links (u, v) among pairs (a, b): intersections of the full shingle sets, made anew from the nodes' texts."""
    pairs = materialize(pairs, "pairs")
    held = node_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")), sigs, keyed, shingle)

    def check(batches):
        for batch in batches:
            rows = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                z = np.sort(np.concatenate([x, y]), kind="stable")
                if similar(len(x), len(y), int((z[1:] == z[:-1]).sum()), percent):
                    rows.append(i)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["u", "v"])

    joined = pairs.join(held.select(F.col("node").alias("a"), F.col("words").alias("wa")), "a").join(held.select(F.col("node").alias("b"), F.col("words").alias("wb")), "b")
    return materialize(joined.select("a", "b", "wa", "wb").mapInArrow(check, "u binary, v binary"), "links")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir), shingle=2)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (SELECT doc_id, CASE WHEN len(l) = 0 THEN [] WHEN len(l) = 1 THEN l ELSE list_distinct(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) END AS l FROM w),
u AS (SELECT doc_id, len(l) AS n, unnest(l) AS x FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, k.b FROM reach r JOIN links k ON r.b = k.a)
SELECT s.doc_id, CAST(len(s.l) AS BIGINT) AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept FROM s JOIN reach r ON s.doc_id = r.a GROUP BY s.doc_id, s.l
"""
