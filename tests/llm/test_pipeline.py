"""The pipeline's stages, one by one and together, over a small set of tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghio", k=rng.randint(2, 8))) for _ in range(n)) + "."
    leak = prose(30)
    rows = [(i, prose(rng.randint(30, 90)), rng.choice(["en", "de"]), f"src{rng.randrange(20)}") for i in range(300)]
    junk = [(1000 + i, " ".join("".join(rng.choices("AB!#$", k=4)) for _ in range(40)), "en", "src1") for i in range(60)]
    copies = [(2000 + i, t, a, b) for i, (_, t, a, b) in enumerate(rows[:20])] + [(2100 + i, t + " more", a, b) for i, (_, t, a, b) in enumerate(rows[20:40])]
    leaks = [(3000 + i, f"{prose(20)} {leak.upper()} {prose(20)}", "en", "src2") for i in range(10)]
    odd = [(4000, None, None, None), (4001, "", "en", "src3")]
    all_rows = [(*r, len(r[1] or "")) for r in rows + junk + copies + leaks + odd]
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(all_rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, *_ in rows] + [(i, 0, 0) for i, *_ in junk], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, junk, copies, leaks


def test_stages(spark, tables):
    d, rows, junk, copies, leaks = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    f = dict(corpus_pipeline.STAGES)
    assert list(f) == ["quality", "near_dedup", "decontaminate", "mixing", "sharding"]
    kept = ids(f["quality"](spark, docs, d))
    assert len(kept & {r[0] for r in junk}) <= 2 and len({r[0] for r in rows} - kept) <= 3
    kept = ids(f["near_dedup"](spark, docs, d))
    assert not kept & {r[0] for r in copies} and {r[0] for r in rows} <= kept and {4000, 4001} <= kept
    assert ids(f["decontaminate"](spark, docs, d)) == ids(docs) - {r[0] for r in leaks}
    mixed = f["mixing"](spark, docs, d)
    words = lambda df: df.agg(F.sum(F.size(F.split(F.trim("text"), " +")))).first()[0]
    assert mixed.columns == docs.columns and 0.6 < words(mixed) / words(docs) <= 0.81
    shards = f["sharding"](spark, docs, d)
    assert shards.count() == docs.count() and set(shards.columns) == {*docs.columns, "shard", "slot"}


def test_run(spark, tables):
    d, rows, *_ = tables
    out = corpus_pipeline.run(spark, d).collect()
    got = {r["doc_id"] for r in out}
    assert len(out) == len(got) and len(got & {r[0] for r in rows}) > 0.5 * len(rows)
    assert len([i for i in got if 1000 <= i < 4000]) <= 2  # junk, copies and leaks
    sizes = [sum(r["shard"] == s for r in out) for s in range(corpus_pipeline.SHARDS)]
    assert max(sizes) - min(sizes) <= 1


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept_by_hand(rows):
    """Ids of rows (id, text) that stay: the least of each component of links of similarity 0.8 or more."""
    rows = sorted(rows)
    sets, top = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0:
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {rows[i][0] for i in range(len(rows)) if root(i) == i}


def grams(t):
    w = "".join(c for c in (t or "").lower() if c.isalnum())
    return {w[i : i + 8] for i in range(len(w) - 7)}


def test_whole_run_by_hand(spark, tables):
    """The rows after each stage of run(), from plain forms of the stages over what the stage before kept: near copies with one to
    four words in ten changed, leaks with the q-gram bound that a leak cannot miss, and shares of leaves."""
    d, *_ = tables
    leak = spark.read.parquet(f"{d}/benchmark.parquet").first()["text"]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rng, f = random.Random(5), dict(corpus_pipeline.STAGES)
    near = []
    for i, r in enumerate(docs.where("doc_id < 120").orderBy("doc_id").collect()):
        w = r["text"].split()
        for at in rng.sample(range(len(w)), len(w) * (i % 5) // 100 + i % 3):
            w[at] = "changed"
        near.append((5000 + i, " ".join(w), r["lang"], r["source"], 0))
    docs = docs.unionByName(spark.createDataFrame(near, docs.schema)).repartition(3)
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}

    now = f["near_dedup"](spark, docs, d)
    kept = ids(now)
    assert kept == kept_by_hand(text.items()) and 0 < len({i for i in kept if i is not None and i >= 5000}) < 120
    now = f["decontaminate"](spark, now, d)
    least = 120 - 7 - 12 * 8  # q-grams that a window within its edits shares
    surely, never = {i for i in kept if leak.lower() in (text[i] or "").lower()}, {i for i in kept if len(grams(text[i]) & grams(leak)) < least}
    assert surely | never == kept and surely and ids(now) == kept - surely
    kept -= surely
    now = f["mixing"](spark, now, d)
    mixed, words = ids(now), lambda some: sum(len((text[i] or "").split()) for i in some)
    assert mixed <= kept and 0.7 * words(kept) < words(mixed) <= 0.8 * words(kept)
    out = f["sharding"](spark, now, d).collect()
    assert {r["doc_id"] for r in out} == mixed and len(out) == len(mixed) and all(r["text"] == text[r["doc_id"]] for r in out)
    for s in range(corpus_pipeline.SHARDS):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots))) and len(slots) in (len(out) // corpus_pipeline.SHARDS, len(out) // corpus_pipeline.SHARDS + 1)


def test_repeated_rows_and_null_ids(spark):
    """Decisions are rows', not ids': repeated rows, one id with several texts, and null ids."""
    rng = random.Random(2)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghio", k=rng.randint(2, 8))) for _ in range(n))
    t = [prose(60) for _ in range(8)]
    near = t[3] + " more"
    rows = [(1, t[0])] * 4 + [(2, t[1]), (2, t[2]), (3, t[1]), (None, t[3]), (None, t[3]), (None, near), (None, t[4]), (None, t[0]), (5, t[5]), (None, t[5]), (None, None), (None, None), (6, ""), (6, "")]
    frame = lambda rows: spark.createDataFrame([(i, x, "en", "src1", len(x or "")) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    f = dict(corpus_pipeline.STAGES)
    out = f["near_dedup"](spark, frame(rows), "")
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert len([x for x in got if x[1] in (t[3], near)]) == 1
    want = [(1, t[0]), (2, t[1]), (2, t[2]), (None, t[4]), (5, t[5]), (None, None), (None, None), (6, ""), (6, "")]
    assert sorted(map(str, (x for x in got if x[1] not in (t[3], near)))) == sorted(map(str, want))
    many = [(None, prose(20)) for _ in range(50)] + [(7, prose(20)) for _ in range(50)] + [(8, t[0])] * 5
    words = lambda rows: sum(len(x.split()) for _, x in rows)
    mixed = [(r["doc_id"], r["text"]) for r in f["mixing"](spark, frame(many), "").collect()]
    assert 0.7 * words(many) < words(mixed) <= 0.8 * words(many)


def test_stages_on_empty_tables(spark, tables, tmp_path):
    d = tables[0]
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
