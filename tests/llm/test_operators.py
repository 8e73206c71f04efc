"""Every operator against brute force on a small corpus, and on nulls, empty and long texts, ties, repeats, empty tables and
columns whose names clash with the operators' own."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import common, decontaminate, elias_fano, exact_dedup, fuse, language, lm_score, minhash, mixing, quality, repeats, sharding, tokens
from shelfwise.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = r"[\x20\x09-\x0D]+"


def words(t):
    return [w for w in re.split(SPACE, (t or "").translate(LOWER)) if w]


def corpus(seed=1, n=160):
    """(id, text): prose with exact and near copies, shared passages, nulls, empty, odd and long texts."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijklmnoprstuvwé") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda k: " ".join(rng.choice(vocab) for _ in range(k)).capitalize() + "."
    passage = prose(110)
    out = []
    for i in range(n):
        kind = rng.random()
        if out and kind < 0.15:
            t = rng.choice(out)
        elif out and kind < 0.35:
            w = (rng.choice(out) or "x").split(" ")
            for _ in range(max(1, len(w) // 40)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            t = " ".join(w)
        elif kind < 0.5:
            t = f"{prose(rng.randint(5, 60))} {passage} {prose(rng.randint(5, 60))}"
        else:
            t = prose(rng.randint(1, 200))
        out.append(t)
    out += [None, "", " \t\n", "one", "One", "ab", "a" * 1500, "ab" * 900, "x  y\tz", "x y z", "naïve ÉTÉ <|endoftext|> it's 42 b", prose(9000), "́e", "!!! ???"]
    return list(enumerate(out, 5))


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(5).cache()


#: Columns named as the operators' own; they must do no harm.
CLASH = ("id", "node", "n", "h", "own", "bucket", "keep_id", "digest", "norm", "spans", "score", "leaks", "shard", "slot", "_cell", "_rank", "_text", "k1", "k2", "part", "block", "lang_pred", "s_upper", "cap", "budget", "order")


def clashing(df):
    return df.withColumns({c: F.lit("?") for c in CLASH if c not in df.columns})


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def test_fuse():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 10, 1000, 30000):
        keys = rng.integers(0, 2**63, n, dtype=np.uint64)
        f = fuse.BinaryFuse.from_bytes(fuse.BinaryFuse.build(np.concatenate([keys, keys])).to_bytes())
        assert f.holds(keys).all() and f.holds(rng.integers(0, 2**63, 20000, dtype=np.uint64)).sum() < 8
        assert len(f.table) < 1.4 * n + 200


def test_exact_dedup(spark, docs):
    rows, df = docs
    norm = {i: re.sub(SPACE, " ", t or "") for i, t in rows}
    groups = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    for frame in (df, clashing(df)):
        got = exact_dedup.exact_dedup(frame, F.col("doc_id") % 2 == 0).collect()
        assert {r["doc_id"]: (r["keep_id"], r["group_size"], bytes(r["digest"]).hex()) for r in got} == {
            i: (min(groups[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}
        assert len(got) == len(rows)
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "b")], "doc_id long, text string")
    assert sorted((r["keep_id"] or 0, r["group_size"]) for r in exact_dedup.exact_dedup(twice, F.lit(True)).collect()) == [(0, 1), (1, 3), (1, 3), (1, 3)]
    assert exact_dedup.exact_dedup(empty(spark), F.lit(False)).count() == 0


def test_exact_dedup_unknown_snapshot(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "a", True), (4, "b", None), (5, "b", False), (6, "c", None), (7, "c", None)], "doc_id long, text string, flag boolean")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(rows, F.col("flag")).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (4, 2), 5: (4, 2), 6: (6, 2), 7: (6, 2)}


class FirstLetterDigests:
    """pyspark's functions with a SHA-256 that sees a text's first byte only."""

    def __getattr__(self, name):
        return (lambda col, bits: F.sha2(F.substring(col, 1, 1) if bits == 256 else col, bits)) if name == "sha2" else getattr(F, name)


def test_exact_dedup_with_equal_digests(spark, monkeypatch):
    """Different texts of one digest are told apart by their bytes, in the snapshot, in the batch and across both."""
    monkeypatch.setattr(exact_dedup, "F", FirstLetterDigests())
    texts = ["apple", "avocado", "apple", "bear", "bear", "cat", "cow", "dog", "avocado", "apple  tree", "apple tree", None, "", "eel"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    norm = [re.sub(SPACE, " ", t or "") for t in texts]
    want = {i: (norm.index(t), norm.count(t)) for i, t in enumerate(norm)}
    for old in (F.col("doc_id") % 2 == 0, F.col("doc_id") < 3, F.lit(True), F.lit(False)):
        got = exact_dedup.exact_dedup(df, old).collect()
        assert len(got) == len(texts) and {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got} == want


def brute_repeats(texts, span):
    count = Counter(b[i : i + span] for b in texts for i in range(len(b) - span + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - span + 1):
            if count[b[i : i + span]] > 1:
                gone[i : i + span] = True
        runs = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_pieces():
    for b in (b"", b"a b  c\nddd e", b"x" * 30, b"x " * 20, b" " * 9):
        for size in (1, 3, 100):
            got = list(common.pieces(b, size))
            assert b"".join(got) == b and [w for p in got for w in p.split()] == b.split()


@pytest.mark.parametrize("span,gram,chunk,clash", [(400, 64, 1000, False), (120, 16, 3, True), (50, 50, 1000, False)])
def test_repeats(spark, docs, monkeypatch, span, gram, chunk, clash):
    rows, df = docs
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    monkeypatch.setattr(repeats, "BLOCK", 4096)
    want = dict(zip((i for i, _ in rows), brute_repeats([(t or "").encode() for _, t in rows], span)))
    got = repeats.remove_repeats(clashing(df) if clash else df, ["doc_id", *["k1", "_text", "spans"] * clash], span=span, gram=gram).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want
    assert repeats.remove_repeats(empty(spark), ["doc_id"]).count() == 0


def test_repeats_of_repeated_rows(spark):
    t = "".join(random.Random(3).choices("abcdef ", k=600))
    df = spark.createDataFrame([(1, t), (1, t), (None, t[:450]), (3, None)], "doc_id long, text string")
    got = repeats.remove_repeats(df, ["doc_id"], with_text=True).collect()
    assert sorted((r["n_removed"], bytes(r["kept_text"])) for r in got) == [(0, b""), (450, b""), (600, b""), (600, b"")]


def test_repeats_of_runs():
    rng = random.Random(5)
    texts = [("Hg" * 200 + " ".join(str(rng.random()) for _ in range(25))).encode() for _ in range(50)] + [b"a" * n for n in (5000, 5003)]
    rows = repeats.context_rows(texts, 400, 64)
    assert len(rows[0]) < sum(map(len, texts)) / 80  # not a context for each start
    who, s1, own, h, reps, dig = rows
    buf = np.frombuffer(b"x" + b"ab" * 40 + b"y" + b"c" * 63, np.uint8)
    assert np.flatnonzero(repeats.periodic(buf, 64)).tolist() == list(range(1, 18))
    starts = sorted((w, s + k) for w, s, n, r in zip(who.tolist(), s1.tolist(), own.tolist(), reps.tolist()) for k in range(n * r))
    assert starts == [(w, s) for w, t in enumerate(texts) for s in range(len(t) - 399)]


@pytest.mark.parametrize("send", [1 << 20, 1])
def test_repeats_among_runs(spark, monkeypatch, send):
    monkeypatch.setattr(repeats, "SEND_BYTES", send)
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    line = noise(37)
    texts = ["a" * 2000, "a" * 451, "b" * 399, "b" * 400, "Hg" * 203, "gH" * 201 + noise(500), noise(300) + "Hg" * 450 + noise(300), line * 20, line[9:] + line * 12 + noise(90), *("Hg" * 199 + noise(400) for _ in range(6))]
    got = repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == dict(enumerate(brute_repeats([t.encode() for t in texts], 400)))


@pytest.mark.parametrize("chunk", [1000, 1])
def test_repeats_where_none_is_found(spark, monkeypatch, chunk):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdefgh ", k=390))  # starts of several texts share an anchor, but no 400 bytes
    texts = ["".join(rng.choices("abcdefgh ", k=300)) + x + passage + y + "".join(rng.choices("abcdefgh ", k=300)) for x, y in ("12", "34", "56")]
    got = repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in got) == [(992, 0)] * 3


def test_suffix_array():
    rng = random.Random(7)
    for text in [b"", b"a", b"aaaa", b"banana\xff", b"abab\xffabab\xff", bytes(rng.choices(b"ab\xff", k=500)), bytes(rng.choices(range(256), k=700))]:
        assert repeats.suffix_array(text, 10_000).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def brute_components(rows, n):
    sets, ids = {}, [i for i, _ in rows]
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("n,block,wide,clash", [(2, 256, 4, False), (5, 2, 4, True), (1, 4, 4, False), (2, 2, 0, False)])
def test_minhash(spark, docs, monkeypatch, n, block, wide, clash):
    rows, df = docs
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "WIDE", wide)
    got = minhash.near_duplicates(clashing(df) if clash else df, shingle=n).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, n) and len(got) == len(rows)


@pytest.mark.parametrize("wide,meeting", [(4, 4096), (0, 4096), (0, 5)])
def test_minhash_large_groups(spark, monkeypatch, wide, meeting):
    """A family whose members are near each other, but many not near enough: all links hang on exact comparison, also where
    the family is split by its rarest shingles first."""
    monkeypatch.setattr(minhash, "WIDE", wide)
    monkeypatch.setattr(minhash, "MEETING", meeting)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(60)] = f"z{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows + [(7, rows[7][1]), (None, rows[3][1])], "doc_id long, text string")
    got = minhash.near_duplicates(df, shingle=2).collect()
    want = brute_components(rows, 2)
    assert all((r["n_shingles"], r["component_id"]) == want[3 if r["doc_id"] is None else r["doc_id"]] for r in got) and len(got) == 152
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_long_words_and_pieces(monkeypatch):
    monkeypatch.setattr(minhash, "PIECE", 50)
    texts = ["", "a b", "x" * 9000 + " y " + "x" * 9000, " ".join(map(str, range(300))), "  lead", "tail  "]
    got = minhash.word_hashes([t.encode() for t in texts])
    assert [len(g) for g in got] == [len(t.split()) for t in texts] and got[2][0] == got[2][2] != got[2][1]
    assert len(set(np.concatenate(got).tolist())) == len({w for t in texts for w in t.split()})


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500), (1, None)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u int, v int")).collect()}
    root = {x: x for e in edges for x in e if x is not None}
    for _ in range(400):
        for a, b in edges:
            if b is not None:
                root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if x != r}
    assert components(spark.createDataFrame([], "u int, v int")).count() == 0


def test_token_counts(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    rows, df = docs
    text = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    t = tokenizers.Tokenizer.from_str(text)
    extra = [(900 + i, s) for i, s in enumerate(["It's we'LL don't", "İstanbul ΣΑΣ ﬁ", "a b\u0085c\x1cd", "x<|startoftext|>y", "日本語 テキスト", "é́ ́", "퟿\U0001f600!!", "A" * 3000])]
    got = tokens.count_tokens(clashing(df.unionByName(spark.createDataFrame(extra, df.schema))), text).collect()
    want = {i: (len((s or "").encode()), len(t.encode(s or "", add_special_tokens=False).ids)) for i, s in rows + extra}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got} == want and all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)
    assert all(len(t.encode(w, add_special_tokens=False).ids) == 1 for w in list(tokens.prove_whole(text))[:500])
    assert tokens.count_tokens(empty(spark), text).count() == 0


def sellers(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("piece,slice_bytes,block", [(1 << 20, 1 << 20, 1 << 20), (1 << 20, 600, 1 << 20), (50, 600, 1)])
def test_decontaminate(spark, monkeypatch, piece, slice_bytes, block):
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", slice_bytes)  # one slice or several
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontaminate, "WINDOW", 60)
    monkeypatch.setattr(decontaminate, "STRIDE", 30)
    rng = random.Random(9)
    item = lambda n: "".join(rng.choices("abcdefgh ij", k=n))
    items = [(k, item(rng.randint(30, 150)).upper()) for k in range(12)] + [(20, None), (21, ""), (22, "short"), (None, item(80)), (3, "A copy of the id 3 with another text, long enough.")]
    rows = [(0, None), (1, ""), (2, item(400)), (3, "A copy — of the id 3, with another text: long enough!")]
    for k in range(60):
        w = list(items[k % 12][1].lower())
        for _ in range(rng.randint(0, max(1, len(w) // 7))):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], ["é"], [w[at], "z"]])
        rows.append((10 + k, item(rng.randint(0, 90)) + "\n" + "".join(w) + " " + item(rng.randint(0, 90))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: {x["item_id"]: x["edits"] for x in r["leaks"]} for r in decontaminate.find_leaks(df, bench).collect()}
    norm = lambda s: re.sub(r"[\W_]+", "", (s or "").lower())
    for i, t in rows:
        want = {}
        for k, s in items:
            m = norm(s)
            for _, w in decontaminate.windows(list(m)) if k is not None and len(m) >= decontaminate.Q else ():
                if (d := sellers(w, norm(t))) <= decontaminate.edit_budget(len(w)):
                    want[k] = min(d, want.get(k, d))
        assert got[i] == want, (i, got[i], want)
    assert sum(map(bool, got.values())) > 20
    assert decontaminate.find_leaks(df.limit(0), bench).count() == 0
    assert all(not r["leaks"] for r in decontaminate.find_leaks(df, bench.limit(0)).collect())


def test_whole_items():
    """Items over WINDOW with edits that lie together in the windows' overlap, against alignments that do not use windows()."""
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    items = [letters(n) for n in (150, 179, 185, 240, 326, 90)]
    index = decontaminate.ItemIndex([(k, decontaminate.reduced(s.encode())) for k, s in enumerate(items)])
    texts, only_whole = [], 0
    for s in items:
        mid = len(s) // 2
        for n in (0, 8, 12, 13, 15, 17, 19, 34):
            texts += [letters(40) + s[:mid] + letters(n) + s[mid:] + letters(40), letters(40) + s[: mid - n // 2] + letters(n) + s[mid - n // 2 + n :] + letters(40)]
    got = index.search([decontaminate.reduced(t.encode()) for t in texts])
    for t, found in zip(texts, got):
        want = {}
        for k, s in enumerate(items):
            starts = [*range(0, len(s) - decontaminate.WINDOW, decontaminate.STRIDE), len(s) - decontaminate.WINDOW] if len(s) > decontaminate.WINDOW else []
            parts = [d for a in starts if (d := sellers(w := s[a : a + decontaminate.WINDOW], t)) <= len(w) // 10]
            whole = [d for d in [sellers(s, t)] if d <= len(s) // 10]
            only_whole += bool(whole and starts and not parts)
            if parts or whole:
                want[k] = min(parts + whole)
        assert dict(found) == want
    assert only_whole > 5


def test_parts_of_items():
    """Parts of a long item are found wherever they start."""
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    item = letters(305)
    index = decontaminate.ItemIndex([(0, decontaminate.reduced(item.encode()))])
    cuts = [(at, n) for n in (108, 115, 130) for at in range(305 - n + 1)]
    got = index.search([decontaminate.reduced((letters(30) + item[at : at + n] + letters(30)).encode()) for at, n in cuts])
    assert [c for c, found in zip(cuts, got) if not found] == []
    edited = []
    for at in range(0, 305 - 116, 3):  # four edits in 116 letters
        part = list(item[at : at + 116])
        for place in rng.sample(range(116), 4):
            part[place] = "0"
        edited.append(letters(30) + "".join(part) + letters(30))
    assert all(index.search([decontaminate.reduced(t.encode()) for t in edited]))


def test_water_filling(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 100), ("a", "x", "2", 1000), ("a", "y", "3", 50), ("b", "x", "4", 400)], "domain string, language string, origin string, tokens long")
    get = lambda share, epochs, w: {r["origin"]: r["quota"] for r in mixing.leaf_budgets(leaves, share, epochs, w).collect()}
    # 1000 tokens: b's 500 are capped at 400, so a has 600; y's 300 are capped at 50, so x has 550: 1 is capped at 100
    assert get(1000 / 1550, 1, {"domain": {"a": 1, "b": 1}, "language": {"x": 1, "y": 1}}) == {"1": 100, "2": 450, "3": 50, "4": 400}
    assert get(1.0, 1, {}) == {"1": 100, "2": 1000, "3": 50, "4": 400}
    assert get(2.0, 2, {}) == {"1": 200, "2": 2000, "3": 100, "4": 800}


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s2", None])) for i in range(400)] + [(3, "tie", "en", "s1"), (3, "tie", "en", "s1"), (None, None, None, None)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").drop("n"))
    got = mixing.mix(df, {"d": ["s1"]}, {"language": {"en": 0.7}}, 0.9, 2, 7).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault((r["domain"], r["language"], r["origin"]), []).append(r)
    for own in by.values():
        total, quota = sum(r["n_tokens"] for r in own), own[0]["quota"]
        taken = sum(r["n_tokens"] * r["epochs_taken"] for r in own)
        whole = min(quota // total, 2) if total else 0
        assert taken <= quota and {r["epochs_taken"] for r in own} <= {whole, whole + 1}
        if whole < 2 and total:  # a prefix of the seeded order, and the longest that fits
            order = sorted(own, key=lambda r: (hashlib.md5(f"7/{whole}/{'?' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest(), r["n_tokens"]))
            run = np.cumsum([r["n_tokens"] for r in order])
            assert [r["epochs_taken"] - whole for r in order] == (run <= quota - whole * total).astype(int).tolist()
    assert mixing.mix(empty(spark), {}, {}, 1.0, 1, 1).count() == 0


def test_quality(spark):
    rng = random.Random(6)
    prose = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(rng.randint(20, 80))) + "."
    junk = lambda: " ".join("".join(rng.choices("ABC!#$", k=5)) for _ in range(rng.randint(20, 80)))
    rows = [(i, prose() if i % 3 else junk(), int(i % 3 > 0)) for i in range(600)]
    df = spark.createDataFrame([r[:2] for r in rows] + [(1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.train(df, labels, F.col("doc_id") % 5 != 0)
    assert 0 < len(model.rules) < 120 and all(len(r) <= 3 for _, r in model.rules)
    got = {r["doc_id"]: r["score"] for r in quality.score_documents(clashing(df), model, ["doc_id"]).collect()}
    held = [(got[i] >= 0.3) == bool(q) for i, _, q in rows if i % 5 == 0]
    assert np.mean(held) > 0.95 and 0 <= got[1000] == got[1001] <= 1 and len(got) == 602
    x = np.array([quality.stats_of((t or "").encode()) for _, t, _ in rows])
    assert np.allclose([got[i] for i, _, _ in rows], model.score(x))  # the compiled column is the ensemble
    full = quality.score_documents(clashing(df), model, clashing(df).columns)
    assert full.count() == 602
    none = quality.train(df, labels.limit(0), F.lit(True))
    assert quality.score_documents(df, none, ["doc_id"]).select("score").distinct().collect()[0][0] == pytest.approx(0.5)
    assert quality.score_documents(empty(spark), model, ["doc_id"]).count() == 0


def test_pair_statistics_of_long_texts():
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(300)]
    for text in (" ".join(rng.choices(vocab, k=400_000)), " ".join(rng.choices(vocab, k=50)), "a b " * 700_000, "one"):
        w = text.split()
        want = 1 - len(set(zip(w, w[1:]))) / (len(w) - 1) if len(w) > 1 else 0.0
        assert quality.stats_of(text.encode())[quality.STATS.index("pair_dups")] == pytest.approx(want, abs=1e-12)


def ring_by_hand(cells, owner, room):
    """One key at a time: own shard first for all, then the rest clockwise."""
    out, rest = {}, []
    for cell, key in cells:
        if room[owner[cell]]:
            room[owner[cell]] -= 1
            out[key] = owner[cell]
        else:
            rest.append((cell, key))
    for cell, key in rest:
        c = cell
        while not room[owner[c % len(owner)]]:
            c += 1
        room[owner[c % len(owner)]] -= 1
        out[key] = owner[c % len(owner)]
    return out


def test_ring_flow():
    rng = np.random.default_rng(3)
    for shards, n in ((7, 1000), (5, 3), (1, 20), (4, 0)):
        owner = sharding.ring_owners(shards, 16, 1, 512)
        cells = np.sort(rng.integers(0, 512, n) // rng.integers(1, 4))
        counts = np.bincount(cells, minlength=512)
        capacity = n // shards + (np.arange(shards) < n % shards)
        plan = sharding.plan_flow(counts, owner, capacity)
        rank = np.arange(n) - np.searchsorted(cells, cells)
        got = {k: next(int(p.shard) for p in plan.itertuples() if p.cell == c and p.lo <= r < p.hi) for k, (c, r) in enumerate(zip(cells, rank))}
        assert got == {k: int(s) for k, s in ring_by_hand(list(zip(cells.tolist(), range(n))), owner, capacity.copy()).items()}


def test_sharding(spark, docs):
    rows, df = docs
    more = df.unionByName(df.limit(30)).unionByName(spark.createDataFrame([(None, "x"), (None, None)], df.schema))
    n = more.count()
    got = sharding.shard_rows(clashing(more), "doc_id", 9, tie=["text"]).collect()
    assert len(got) == n
    for s in range(9):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots))) and len(slots) - n // 9 in (0, 1)
    eight = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(df, "doc_id", 9).collect()}
    nine = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(df, "doc_id", 10).collect()}
    assert sum(eight[k] == nine[k] for k in eight) > len(eight) / 3
    assert sharding.shard_rows(empty(spark), "doc_id", 4).count() == 0


def test_sharding_of_many_equal_rows(spark, docs):
    """A third of the rows equal in all columns: dealt over the ring by number, the other keys as before."""
    rows, df = docs
    n = df.count()
    same = spark.range(0, n // 2, 1, 4).selectExpr("cast(null as long) AS doc_id", "'x' AS text")
    more = df.unionByName(same)
    cut = sharding.shard_rows(more, "doc_id", 6, tie=["text"], crowded=10)
    got = cut.collect()
    assert cut.columns == [*more.columns, "shard", "slot"] and Counter((r["doc_id"], r["text"]) for r in got) == Counter((r["doc_id"], r["text"]) for r in more.collect())
    for s in range(6):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots))) and len(slots) - len(got) // 6 in (0, 1)
    assert len({r["shard"] for r in got if r["doc_id"] is None}) == 6
    whole = sharding.shard_rows(more, "doc_id", 6, tie=["text"]).collect()
    assert sorted((r["shard"], r["slot"]) for r in whole) == sorted((r["shard"], r["slot"]) for r in got)


def test_language(spark):
    rng = random.Random(8)
    kinds = {"en": ["the", "and", "tion", "ing"], "de": ["sch", "ung", "ein", "ä"], "fr": ["eau", "que", "é", "oi"]}
    text = lambda k: " ".join("".join(rng.choices(kinds[k], k=3)) for _ in range(rng.randint(5, 120)))
    rows = [(i, text(k), k) for i in range(600) for k in [rng.choice(list(kinds))]]
    odd = [(1000, None, "en"), (1001, "", "de"), (1002, "123 !!! ٠", "fr"), (1003, text("fr"), None), (1004, "Ω", "en")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    classes, net = language.train(df, F.col("doc_id") % 4 != 2)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(clashing(df), classes, net).collect()}
    assert classes == ["de", "en", "fr"] and np.mean([got[i][0] == k for i, _, k in rows if i % 4 == 2]) > 0.97
    assert [got[i] for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3 and got[1003][0] == "fr" and got[1004][0] in classes
    assert all(0 <= s <= 1 for _, s in got.values())
    assert language.train(df.limit(0), F.lit(True)) == ([], None)
    assert {r["lang_pred"] for r in language.predict(df, [], None).collect()} == {"und"}
    assert {(r["lang_pred"], r["score"]) for r in language.predict(df.limit(5), ["en"], None).collect()} == {("en", 1.0)}


def test_language_of_whole_texts(spark, monkeypatch):
    """Predictions window by window: the mean of all windows' log probabilities by bytes, over chunks and long texts."""
    rng = random.Random(4)
    kinds = {"x": "abcdef", "y": "mnopqr", "z": "\u00e9\u00e8stuv"}
    text = lambda k, n: " ".join("".join(rng.choices(kinds[k], k=rng.randint(1, 7))) for _ in range(n))
    rows = [(i, text(k, rng.choice([1, 3, 30, 200])), k) for i, k in enumerate("xyz" * 20)]
    rows += [(100, text("x", 300) + " " + text("y", 310), None), (101, text("z", 20000), None), (102, None, "x"), (103, "", "y"), (104, "12 34 --", "z"), (105, "a" * language.WINDOW, None), (7, rows[7][1], "y"), (None, text("y", 9), "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    classes, net = language.train(df, F.lit(True))
    assert classes == ["x", "y", "z"]

    def plain(t):
        b = (t or "").encode()
        if not any(c.isalpha() for c in t or ""):
            return "und", 0.0
        total = np.zeros(len(classes))
        for i in range(0, len(b), language.WINDOW):
            part = b[i : i + language.WINDOW]
            total += len(part) * net.log_probs(np.frombuffer(part.ljust(language.WINDOW, b"\0"), np.uint8)[None])[0].astype(float)
        q = np.exp(total / len(b))
        return classes[int(q.argmax())], float(q.max() / q.sum())

    got = sorted(((str(r["doc_id"]), r["lang_pred"], r["score"]) for r in language.predict(df, classes, net).collect()))
    want = sorted((str(i), *plain(t)) for i, t, _ in rows)
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-4)
    assert language.predict(df.limit(0), classes, net).count() == 0


def test_network_gradients():
    rng = np.random.default_rng(1)
    net = language.ByteCNN(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(0, 256, (6, language.WINDOW), dtype=np.uint8), rng.integers(0, 3, 6)
    loss = lambda: -net.log_probs(x)[np.arange(6), y].mean()
    g = net.grads(x, y)
    for k in net.p:
        for at in [np.unravel_index(np.abs(g[k]).argmax(), g[k].shape), np.unravel_index(np.abs(g[k]).argsort(axis=None)[-5 if g[k].size > 5 else 0], g[k].shape)]:
            keep = net.p[k][at]
            net.p[k][at] = keep + 1e-6
            up = loss()
            net.p[k][at] = keep - 1e-6
            down = loss()
            net.p[k][at] = keep
            assert g[k][at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 1), (5, 2**63), (1000, 50), (70000, 10**9), (140000, 2**62)):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        e = elias_fano.EliasFano.build(v)
        assert (e.decode(0, n) == v).all() and (e.decode(n // 3, n // 2) == v[n // 3 : n // 2]).all()
        at = np.sort(rng.integers(0, max(n, 1), 50)) if n else np.zeros(0, np.int64)
        assert (e.at(at) == v[at]).all()
        asked = np.unique(np.concatenate([v[:200], rng.integers(0, top, 200, dtype=np.uint64)]))
        place = e.find(asked)
        assert all((p >= 0) == (a in set(v.tolist())) and (p < 0 or v[p] == a) for p, a in zip(place.tolist(), asked.tolist()))


def test_trie():
    rng = random.Random(3)
    pairs = sorted({(rng.randrange(300) << 50, rng.randrange(900) << 40) for _ in range(5000)})
    v, w = (np.array(x, np.uint64) for x in zip(*pairs))
    lp = -np.arange(len(pairs)) / 500
    t = elias_fano.Trie.build(v, w, lp).mapped()
    asked = sorted(set(pairs) | {(rng.randrange(310) << 50, rng.randrange(910) << 40) for _ in range(5000)})
    codes = t.lookup(*(np.array(x, np.uint64) for x in zip(*asked)))
    known = dict(zip(pairs, lp))
    for p, c in zip(asked, codes.tolist()):
        assert (c > 0) == (p in known) and (c == 0 or abs(t.book[c - 1] - known[p]) < 0.06)


@pytest.mark.parametrize("small_blocks", [False, True])
def test_lm_score(spark, docs, monkeypatch, small_blocks):
    if small_blocks:  # many blocks and partitions, frequent words dealt by the next word
        monkeypatch.setattr(lm_score, "BLOCK_BYTES", 4000)
        monkeypatch.setattr(lm_score, "PART_TOKENS", 500)
        monkeypatch.setattr(lm_score, "HOT", 30)  # frequent words and pairs are dealt by the next word
    rows, df = docs
    rows = rows + rows[:3]
    df = df.unionByName(spark.createDataFrame(rows[:3], df.schema))
    train = lambda i: i % 7 != 2
    c, c2, c3, n_docs = Counter(), Counter(), Counter(), 0
    for i, t in rows:
        if train(i):
            w = [*words(t), None]
            c.update(w)
            c2.update(zip(["<s>", *w], w))
            c3.update(zip(["<s>", *w], w, w[1:]))
            n_docs += 1
    n, kinds, d = sum(c.values()), len(c), lm_score.DISCOUNT
    after, after2 = Counter(v for v, _ in c2), Counter(k[:2] for k in c3)  # kinds of successors
    got = lm_score.score_texts(clashing(df), F.col("doc_id") % 7 != 2).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        w = [*words(text[r["doc_id"]]), None]
        base = [(c[x] + 1) / (n + kinds + 1) for x in w]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(map(math.log10, base)), abs=1e-6)
        of = lambda v: n_docs if v == "<s>" else c[v]
        p = [(max(c2[v, x] - d, 0) + d * after[v] * b) / of(v) if of(v) else b for v, x, b in zip(["<s>", *w], w, base)]
        for k in range(1, len(w)):
            u, v, x = ["<s>", *w][k - 1], w[k - 1], w[k]
            if c2[u, v]:
                p[k] = (max(c3[u, v, x] - d, 0) + d * after2[u, v] * p[k]) / c2[u, v]
        assert abs(r["score"] - sum(map(math.log10, p))) < 0.02 * len(w)
    assert lm_score.score_texts(empty(spark), F.lit(True)).count() == 0
    untrained = lm_score.score_texts(df.limit(3), F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == pytest.approx(r["base_score"]) for r in untrained)


def test_id_hash(spark):
    from shelfwise.llm.common import id_hash

    got = spark.range(50).select(id_hash(F.col("id"), 7)).collect()
    assert [r[0] for r in got] == [zlib.crc32(str(i).encode()) % 7 for i in range(50)]
