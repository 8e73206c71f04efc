"""The registered corpus queries on a small set of tables, against plain versions of what each must return."""

import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import decontaminate, language, quality
from shelfwise.llm import queries as Q

from .test_operators import corpus, words


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents with repeated and null rows, labels with repeated and unknown ids, and benchmark items."""
    d, rows = str(tmp_path_factory.mktemp("contract")), corpus(4, 120)
    rows = rows + rows[:2] + [(None, "no id"), (None, None)]
    frame = spark.createDataFrame([(i, t, ("en", "de")[k % 2], f"src{k % 20}", len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(len(t or "") > 300), 0) for i, t in rows if i is not None] + [(10**6, 1, 0), (None, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(7, next(t for _, t in rows if t and len(t) > 200)[:90]), (8, "none of the texts has this one in it at all")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows


def remainder(i, mod):
    return zlib.crc32(("" if i is None else str(i)).encode()) % mod


def run(spark, d, name):
    return Q.queries()[name](spark, d).collect()


def test_op8(spark, tables):
    d, rows = tables
    got = run(spark, d, "op8_sharding")
    plain = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == plain
    assert {r["law"] for r in got} == {"rows"} and all(r["grown_shard"] is None for r in got)
    for s in range(40):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots))) and len(slots) - len(rows) // 40 in (0, 1)


def test_op7(spark, tables):
    d, rows = tables
    got = run(spark, d, "op7_quality")
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (remainder(r["doc_id"], 5) == 0) for r in got)
    model = quality.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)

    def plain(t):
        x = dict(zip(quality.STATS, quality.stats_of((t or "").encode())))
        z = model.bias + sum(c for c, rule in model.rules if all((x[quality.STATS[j]] <= v) == (op == "<=") for j, op, v in rule))
        return 1 / (1 + math.exp(-z))

    assert sorted((str(r["doc_id"]), round(r["score"], 9)) for r in got) == sorted((str(i), round(plain(t), 9)) for i, t in rows)


def test_op9(spark, tables):
    d, rows = tables
    got = run(spark, d, "op9_language_id")
    assert len(got) == len(rows) and all(r["held_out"] == (remainder(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in got)
    text = {i: t for i, t in rows if i is not None}
    und = lambda t: not any(c.isalpha() for c in t or "")
    assert all((r["lang_pred"] == "und") == und(text[r["doc_id"]]) for r in got if r["doc_id"] is not None)


def test_network_by_hand():
    """Class scores of one window, filter by filter and place by place."""
    net, x = language.ByteCNN(3), np.frombuffer(b"window of text".ljust(language.WINDOW, b"\0"), np.uint8)
    e, p, pooled = net.p["emb"][x], net.p, []
    for f in range(p["conv"].shape[1]):
        w = language.WIDTHS[f // language.FILTERS]
        kernel = p["conv"][: w * language.EMBED, f].reshape(w, language.EMBED)
        best = max(float((e[i : i + w] * kernel).sum()) for i in range(language.WINDOW - max(language.WIDTHS) + 1))
        pooled.append(max(best + float(p["cb"][f]), 0.0))
    z = np.array(pooled) @ p["out"] + p["ob"]
    assert np.allclose(net.log_probs(x[None])[0], z - np.log(np.exp(z).sum()), atol=1e-4)


def test_op10(spark, tables):
    d, rows = tables
    c = Counter()
    for i, t in rows:
        if remainder(i, 7) != 2:
            c.update([*words(t), None])
    n, kinds = sum(c.values()), len(c)
    got = run(spark, d, "op10_lm_score")
    plain = [(i, [*words(t), None]) for i, t in rows]
    want = Counter((i, remainder(i, 7) == 2, len(w), sum(c[x] > 0 for x in w), n) for i, w in plain)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == want
    base = sorted(sum(math.log10((c[x] + 1) / (n + kinds + 1)) for x in w) for _, w in plain)
    assert np.allclose(sorted(r["base_score"] for r in got), base, atol=1e-6)


def test_op5(spark, tables):
    d, rows = tables
    got = run(spark, d, "op5_decontaminate")
    part = next(t for _, t in rows if t and len(t) > 200)[:90]
    assert len(got) == len(rows) and {r["doc_id"] for r in got if r["contaminated"]} >= {i for i, t in rows if t and part in t}
    assert all((r["n_items"] > 0) == r["contaminated"] and "8" not in r["item_ids"].split(",") for r in got)


def test_repeated_letters_in_bounded_memory():
    """An item and a text of one letter: every place of one meets every place of the other, a slice at a time."""
    index = decontaminate.ItemIndex([(1, decontaminate.reduced(b"a" * 110)), (2, decontaminate.reduced(b"ab" * 55))])
    codes = decontaminate.reduced(b"a" * 400_000)
    tracemalloc.start()
    try:
        assert index.find(codes) == [(0, 0)]
        assert tracemalloc.get_traced_memory()[1] < 300 << 20
    finally:
        tracemalloc.stop()
