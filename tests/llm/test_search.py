"""Fill-in-the-middle, ranked lexical search and SimHash groups against plain versions of what each must return."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shelfwise.llm import fill_middle, lexical, simhash
from shelfwise.llm import queries as Q

from .test_operators import clashing, corpus, empty, words

ODD = ["<P> in it", "a<S>b", "<", "<P", "é", "日本語 の テキスト", "x" * 70, "\U0001f600 smile \U0001f600", "A-b_C'd 42", "͸\x00nul\x7f", "<M", ">", "S>"]


@pytest.fixture(scope="module")
def rows():
    made = corpus(9, 150)
    made += list(enumerate(ODD, 10_000))
    return made + made[:3] + [(None, "no id at all"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5).cache()


# ---- fill in the middle

def plain_cut(i, t):
    t = t or ""
    h = [int(hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, t
    if h[3] % 100 < 20:
        return i, n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return i, n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


@pytest.mark.parametrize("window,out", [(fill_middle.WINDOW, fill_middle.OUT_BYTES), (7, 50)])
def test_fill_middle(spark, docs, rows, monkeypatch, window, out):
    monkeypatch.setattr(fill_middle, "WINDOW", window)
    monkeypatch.setattr(fill_middle, "OUT_BYTES", out)
    text = F.col("text")
    for frame in (docs, clashing(docs).withColumn("form", F.lit("?")).withColumn("h1", F.lit("?"))):
        got = fill_middle.fill_in_middle(frame, fill_middle.id_keys(F.col("doc_id")))
        got = got.select("*", fill_middle.restored(F.col("output"), F.col("form")).alias("back")).collect()
        assert Counter(tuple(r)[:6] for r in got) == Counter(plain_cut(i, t) for i, t in rows)
        assert Counter((r["doc_id"], r["back"]) for r in got) == Counter((i, t or "") for i, t in rows)
    assert fill_middle.fill_in_middle(empty(spark), [F.lit(1)] * 4).count() == 0
    none = fill_middle.fill_in_middle(docs.where(text == "one"), [F.lit(None)] * 4).collect()
    assert [(r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in none] == [("spm", 0, 0, "<S>one<P><M>")]


def test_cuts_of_all_texts_together():
    """Every pair of cuts of texts of characters of 1 to 4 bytes, empty ones among them, in windows of every size."""
    texts = ["", "aé日\U0001f600", "", "b", "\U0001f600\U0001f600", ""]
    raw = [t.encode() for t in texts]
    buf, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    for window in (1, 2, 3, 5, 100):
        fill_middle.WINDOW, old = window, fill_middle.WINDOW
        try:
            for a in range(5):
                for b in range(5):
                    n, cuts, places = fill_middle.cut_batch(buf, ends, np.array([[a] * 6, [b] * 6]), np.zeros(6, bool))
                    assert n.tolist() == list(map(len, texts))
                    for k, t in enumerate(texts):
                        x, y = sorted((a % (len(t) + 1), b % (len(t) + 1)))
                        at = [len(t[:c].encode()) + ends[k] for c in (x, y)]
                        assert cuts[:, k].tolist() == [x, y] and places[:, k].tolist() == at
        finally:
            fill_middle.WINDOW = old


def test_stray_bytes_are_code_points():
    buf = np.frombuffer(b"a\x80\x80b\xe4\xbd", np.uint8)
    assert fill_middle.running_counts(buf, np.array([0]), np.array([0, 1, 2, 3, 4, 6])).tolist() == [0, 1, 2, 2, 3, 4]


def test_op13_digests(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.queries()["op13_fill_middle"](spark, str(tmp_path)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert Counter(map(tuple, got)) == Counter((*plain_cut(i, t)[:5], sha(plain_cut(i, t)[5]), sha(t or "")) for i, t in rows)


# ---- ranked lexical search

def terms(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]


def plain_search(rows, items, top=50):
    bags = [(i, Counter(terms(t))) for i, t in rows]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    want = {}
    for item, t in items:
        want.setdefault(item, set()).update(terms(t))
    out = []
    for item, ws in want.items():
        scored = []
        for i, b in bags:
            m = 100 - 50 + 50 * sum(b.values()) * n_docs // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 20 * m)) for w in ws if b[w])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:top], 1)]
    return Counter(out)


ITEMS = [(1, "The quick x y Z one"), (2, None), (3, ""), (4, "日本語 text"), (5, "zzzz-no-such-term"), (6, "A-b_C'd 42 42 42"), (6, "smile \U0001f600"), (None, "one ab"), (7, "...")]


@pytest.mark.parametrize("window,postings,terms_a_pass", [(8192, 1 << 20, 400_000), (16, 300, 800)])
def test_search(spark, docs, rows, monkeypatch, window, postings, terms_a_pass):
    for k, v in (("WINDOW", window), ("POSTINGS", postings), ("PASS_TERMS", terms_a_pass)):
        monkeypatch.setattr(lexical, k, v)
    some = [t for _, t in rows if t and 20 < len(t) < 300][:12]
    items = spark.createDataFrame([*ITEMS, *enumerate(some, 100)], "item_id long, text string")
    want = plain_search(rows, [tuple(r) for r in items.collect()])
    for frame in (docs, clashing(docs)):
        got = lexical.search(lexical.build_index(frame), items.withColumn("number", F.lit("?")).withColumn("term", F.lit("?")))
        assert Counter(map(tuple, got.collect())) == want
    assert got.schema.simpleString() == "struct<item_id:bigint,rank:int,doc_id:bigint,score:bigint>"


def test_search_ties_and_copies(spark):
    """Copies score alike and go by id, null ids last; only the asked number stays."""
    rows = [(i, "some words here") for i in (7, 3, None, 5, 3, -2)] + [(9, "words"), (10, "other"), (11, None), (12, "!?")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = [("a", "words here"), ("b", "other other")]
    for top in (1, 3, 50):
        got = lexical.search(lexical.build_index(docs), spark.createDataFrame(items, "item_id string, text string"), top)
        assert Counter(map(tuple, got.collect())) == plain_search(rows, items, top)


def test_search_of_nothing(spark, docs):
    none, items = empty(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(lexical.build_index(none), items).count() == 0
    assert lexical.search(lexical.build_index(docs), items.limit(0)).count() == 0
    wordless = spark.createDataFrame([(1, "..."), (2, None)], "doc_id long, text string")
    assert lexical.search(lexical.build_index(wordless), items).count() == 0


def test_lengths_beyond_64_bits():
    assert lexical.lengths(np.array([0, 10**9, 3]), 10**11, 10**13).tolist() == [50 + 50 * n * 10**11 // 10**13 for n in (0, 10**9, 3)]


# ---- SimHash

def plain_fingerprint(t, n=3):
    w = words(t)
    parts = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(fps, ids):
    """Smallest id of each row's component, by all pairs of distinct fingerprints."""
    distinct, root = sorted(set(fps)), {}
    for f in distinct:
        root[f] = f

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    least = {}
    for f, i in zip(fps, ids):
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [least.get(find(f)) for f in fps]


def test_fingerprints(rows, monkeypatch):
    long = corpus(3, 3)[-3][1] or "a b c"
    texts = [t or "" for _, t in rows] + ["  A  b\tC\n", "one", "one two", " ".join(["w"] * 9), long * 3]
    for size in (simhash.SHINGLES, 2):
        monkeypatch.setattr(simhash, "SHINGLES", size)
        assert [simhash.fingerprint(t.encode()) for t in texts] == [plain_fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "pieces", lambda b: __import__("shelfwise.llm.common", fromlist=["pieces"]).pieces(b, 5))
    assert [simhash.fingerprint(t.encode()) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_seed_is_the_engines_own(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first()["h"]
    assert got % 2**64 == xxhash.xxh64_intdigest(b"a b c", simhash.SEED)


def test_near_fingerprints(spark, docs, rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    want = Counter((i, f, c) for (i, _), f, c in zip(rows, fps, plain_groups(fps, [i for i, _ in rows])))
    for frame in (docs, clashing(docs).withColumn("fp", F.lit("?")).withColumn("cell", F.lit("?"))):
        got = simhash.near_fingerprints(frame).collect()
        assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got) == want
    assert simhash.near_fingerprints(empty(spark)).count() == 0


def near_numbers(n, seed):
    """Fingerprints at random, and clusters of ones that differ in a few bits, of several sizes; 0 and all bits too."""
    rng = random.Random(seed)
    out = {0, 2**64 - 1, 1, 3, 7, 2**63}
    for size in (2, 3, 10, 60, 300):
        base = rng.getrandbits(64)
        out |= {base ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(5))}) for _ in range(size)}
    return sorted(out | {rng.getrandbits(64) for _ in range(n)})


@pytest.mark.parametrize("paired,refined", [(128, 16384), (3, 16384), (0, 40)])
def test_links_are_those_of_all_pairs(spark, monkeypatch, paired, refined):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    monkeypatch.setattr(simhash, "REFINED", refined)
    fps = near_numbers(200, 5)
    df = spark.createDataFrame([(f - (f >> 63 << 64),) for f in fps], "fp long").repartition(3)
    got = simhash.components(simhash.links(df)).collect()
    root = {r["node"] % 2**64: r["root"] % 2**64 for r in got}
    named = {}
    for f, c in zip(fps, plain_groups(fps, fps)):
        named.setdefault(c, set()).add(f)
    found = {}
    for f in fps:
        found.setdefault(root.get(f, f), set()).add(f)
    assert sorted(map(sorted, named.values())) == sorted(map(sorted, found.values()))


def test_half_way_cells():
    """Fingerprints of at most 2 differing bits share a cell; those that share one differ by at most 2 steps of the grid."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.integers(0, 2**63, dtype=np.uint64) * np.uint64(2) + np.uint64(rng.integers(0, 2))
        bits = rng.choice(64, 2, replace=False)
        for b in (a ^ np.uint64(1 << int(bits[0])), a ^ np.uint64(1 << int(bits[0])) ^ np.uint64(1 << int(bits[1]))):
            x, y = (set(simhash.cells(np.array([v]))[1].tolist()) for v in (a, b))
            assert x & y
        c = rng.integers(0, 2**63, dtype=np.uint64)
        x, y = (set(simhash.cells(np.array([v]))[1].tolist()) for v in (a, c))
        steps = np.abs(np.subtract(*simhash.segment_counts(np.array([a, c])).astype(int))).sum()
        assert not (x & y) or steps <= 2


def test_crowded_cell_in_linear_memory():
    """50,000 fingerprints of one cell: neither their pairs nor all their neighbours at once."""
    rng = np.random.default_rng(1)
    base, fps = rng.integers(0, 2**63, dtype=np.uint64), set()
    while len(fps) < 50_000:
        fps.add(int(base ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, 4, replace=False).astype(np.uint64))))
    fps = np.array(sorted(fps), np.uint64)
    tracemalloc.start()
    try:
        u, _ = simhash.cell_links(np.zeros(len(fps), np.int64), fps)
        assert tracemalloc.get_traced_memory()[1] < 200 << 20
    finally:
        tracemalloc.stop()
    assert 40_000 < len(u) < 50_000
