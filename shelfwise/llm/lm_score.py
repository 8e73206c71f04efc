"""Language-model scores from a trigram model in Elias-Fano tries that are dealt over partitions.

Texts are packed into blocks with a vocabulary of their own. A block sends its distinct words, then its distinct bigrams and
trigrams, with their counts in training texts, to the partitions of their first words; a partition adds up the blocks'
counts, builds its trie of three levels and answers each block's n-grams in the order asked. Nothing of the corpus is broadcast
and nothing of it reaches the driver but sums; a block sends messages only to partitions that it has something for.

A word that is more than a set share of all tokens is frequent; blocks learn which of their words are from the counts of
words. Bigrams of a frequent word are dealt by their second word too, and trigrams that begin with two frequent words by
their third, so no partition gets all that follows one word or one pair.

P(w | u v) = (c - D(c) + B(u v) * P(w | v)) / count(u v), with c = count(u v w), D the discount of a seen n-gram by its count and
B(u v) the sum of the discounts of what follows u v; P(w | v) alike over P(w) = (count(w) + 1) / (N + V + 1). Without a
count of the context the shorter context's probability stands alone. The first part of a seen n-gram is kept as a quantised
log10 in the trie, and so are answers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, documents, id_hash, materialize, mix64, small, text_chunks
from .elias_fano import Trie
from .minhash import word_hashes

U = np.uint64
END, BEGIN = U(0xE11D), U(0xBE61)  # hashes of the end token and of the context before the first word
#: The discount of a seen n-gram, whatever its count: what recurs keeps more of its count than what was seen once.
DISCOUNT = 0.75
BLOCK_BYTES = 6 << 20
#: Tokens for each partition; words over 1 / (HOT * partitions) of all tokens are frequent.
PART_TOKENS = 1_250_000
HOT = 4


def pack(hashed: list[np.ndarray]) -> tuple[bytes, bytes, bytes, int]:
    """(words, lengths, tokens, number of tokens) of a block: words by falling count, texts as places among them."""
    lengths = np.array([len(h) for h in hashed], np.int32)
    flat = np.concatenate(hashed)
    hashed.clear()
    words, tokens, count = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    planes = rank[tokens].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return words[order].tobytes(), lengths.tobytes(), zstandard.ZstdCompressor(level=1).compress(planes), int(lengths.sum())


def unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, lengths, tokens, training flag of each text)"""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["tokens"]), np.uint8)
    tokens = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    return np.frombuffer(row["words"], U), np.frombuffer(row["lengths"], np.int32), tokens, np.array(row["train"], bool)


def dealt_words(words: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of words by partition and hash, partition of each in that order)"""
    part = (mix64(words ^ U(77)) % U(parts)).astype(np.int64)
    order = np.lexsort((words, part))
    return order, part[order]


def places(order: np.ndarray) -> np.ndarray:
    """The inverse of a permutation."""
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def runs(sorted_values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, from, to) of the runs of equal values."""
    cuts = np.flatnonzero(np.diff(sorted_values)) + 1
    first, last = np.append(0, cuts), np.append(cuts, len(sorted_values))
    return list(zip(sorted_values[first].tolist(), first.tolist(), last.tolist())) if len(sorted_values) else []


class Grams:
    """The distinct bigrams and trigrams of a block, by partition. words: the block's vocabulary; spread: over how many
    partitions each word's n-grams are dealt, and one more for the begin of a text; given: counts of frequent words, else 0.

    Level one holds contexts: words, and pairs of frequent words (a hash of both), whose count the partition cannot know.
    Level two holds what follows a context, level three what follows a pair of words that are not both frequent. Contexts
    are told apart by 48 bits of their hashes, what follows one by 40.
    """

    def __init__(self, words, lengths, tokens, train, parts: int, spread: np.ndarray, given: np.ndarray):
        n = len(words)
        named = np.append(words, BEGIN)
        home, context, word = mix64(named ^ U(99)) % U(parts), named >> U(16), words >> U(24)
        last = np.cumsum(lengths) - 1
        first = np.zeros(len(tokens), bool)  # the first token of a text
        first[np.concatenate([[0], last[:-1] + 1])] = True
        taught = np.repeat(train, lengths)
        self.before = np.empty(len(tokens), np.int64)
        self.before[1:] = tokens[:-1]
        self.before[first] = n
        by_context, by_word = np.argsort(context), np.argsort(word)
        c_rank, w_rank = places(by_context), places(by_word)[tokens]
        key, at = np.unique(c_rank[self.before] * n + w_rank, return_inverse=True)
        u, v = by_context[key // n], by_word[key % n]
        count = np.bincount(at, taught, len(key)).astype(np.int64)
        both = (spread[u] > 1) & (spread[v] > 1)  # pairs whose successors are dealt by the third word
        third = ~first
        third[1:] &= both[at[:-1]]
        late = np.flatnonzero(third)
        key3, at3 = np.unique(at[late - 1] * n + w_rank[late], return_inverse=True)
        pair, w = key3 // n, by_word[key3 % n]
        twice, one, back = np.unique(pair, return_index=True, return_inverse=True)
        pair_hash = mix64(named[u[twice]] + mix64(named[v[twice]] ^ U(31)))
        every = np.concatenate([context, pair_hash >> U(16)])
        rank = places(np.argsort(every, kind="stable"))
        who = np.concatenate([u, n + 1 + back])  # contexts as places among every
        homes = np.concatenate([home, mix64(pair_hash ^ U(99)) % U(parts)])
        over = np.concatenate([spread, np.minimum(spread[u[twice]], spread[v[twice]])])
        base = np.concatenate([given, np.ones(len(twice), np.int64)])  # 1: the block divides by the pair's count
        next_word = np.concatenate([v, w])
        part = ((homes[who] + mix64(word[next_word] ^ U(55)) % over[who].astype(U)) % U(parts)).astype(np.int64)
        order = np.argsort(part * len(every) + rank[who], kind="stable")  # words of a context are in order already
        place = places(order)
        self.context, self.word, self.part, self.given = every[who[order]], word[next_word[order]], part[order], base[who[order]]
        self.count = np.concatenate([count, np.bincount(at3, taught[late], len(key3)).astype(np.int64)])[order]
        self.pair = place[: len(key)][at]  # of each token, the place of its bigram
        self.split = np.full(len(tokens), -1)  # of each token, the place of its trigram on level two, or -1
        self.split[late] = place[len(key) :][at3]
        # what a context in several partitions weighs is the sum of what it weighs in each, so all of them are asked
        used = np.zeros(len(every), bool)
        used[who] = True
        wide = np.flatnonzero(used & (over > 1))
        k = over[wide]
        step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        ask = np.concatenate([part * len(every) + rank[who], ((np.repeat(homes[wide], k) + step.astype(U)) % U(parts)).astype(np.int64) * len(every) + np.repeat(rank[wide], k)])
        ask = np.unique(ask)
        by_rank = np.argsort(rank)
        asked = by_rank[ask % len(every)]
        self.ask_part, self.ask, self.ask_given = ask // len(every), every[asked], base[asked]
        self.names = context  # of words, and of the begin of a text
        # level three
        late = np.flatnonzero(~first & ~third)
        key3, at3 = np.unique(self.pair[late - 1] * n + w_rank[late], return_inverse=True)
        self.inner, self.word3 = key3 // n, word[by_word[key3 % n]]
        self.count3 = np.bincount(at3, taught[late], len(key3)).astype(np.int64)
        self.part3 = self.part[self.inner]
        self.triple = np.full(len(tokens), -1)
        self.triple[late] = at3

    def messages(self):
        """(partition, contexts, bigrams, trigrams) as slices of the arrays, for the partitions that are asked something."""
        three = {p: slice(a, b) for p, a, b in runs(self.part3)}
        two = {p: slice(a, b) for p, a, b in runs(self.part)}
        for p, a, b in runs(self.ask_part):
            yield p, slice(a, b), two.get(p, slice(0, 0)), three.get(p, slice(0, 0))

    def message(self, one: slice, two: slice, three: slice) -> bytes:
        contexts, word, word3 = self.ask[one], self.word[two], self.word3[three]
        known, place = np.unique(np.concatenate([word, word3]), return_inverse=True)
        sizes = np.bincount(np.searchsorted(contexts, self.context[two]), minlength=len(contexts))
        sizes3 = np.bincount(self.inner[three] - two.start, minlength=len(word))
        near = steps(place[: len(word)])  # words of a context are in order, so differences are small
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        near[starts] = place[starts]
        head = np.array([len(contexts), len(known), len(word), len(word3)], "<i8").tobytes()
        body = [*map(shrink, (steps(contexts), steps(known), self.ask_given[one], sizes, near, self.count[two], sizes3, place[len(word) :], self.count3[three]))]
        return zstandard.ZstdCompressor(level=1).compress(b"".join([head, *body]))


def read_message(d: bytes) -> tuple[np.ndarray, ...]:
    """(contexts, given counts, contexts of bigrams, words, counts, bigrams of trigrams as places, words, counts)"""
    d = zstandard.ZstdDecompressor().decompress(d)
    k, m, n, n3 = np.frombuffer(d, "<i8", 4).tolist()
    at, out = 32, []
    for size in (k, m, k, k, n, n, n, n3, n3):
        x, at = grown(d, at, size)
        out.append(x)
    contexts, known, given, sizes, place, count, sizes3, place3, count3 = out
    contexts, known = np.cumsum(contexts).astype(U), np.cumsum(known).astype(U)
    starts, filled = (np.cumsum(sizes) - sizes)[sizes > 0], sizes[sizes > 0]
    total = np.cumsum(place)
    place = total - np.repeat(total[starts] - place[starts], filled)
    return contexts, given, np.repeat(contexts, sizes), known[place], count, np.repeat(np.arange(n), sizes3), known[place3], count3


def steps(a: np.ndarray) -> np.ndarray:
    """Differences of a sorted array, the first from 0."""
    return np.diff(a.astype(np.int64), prepend=0)


def shrink(a: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes as the largest needs, after how many these are; bytes of equal weight together."""
    a = a.astype("<u8")
    width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def grown(d: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    width = d[at]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(d, np.uint8, n * width, at + 1).reshape(width, n).T
    return out.view("<i8").reshape(n), at + 1 + n * width


def distinct(major: np.ndarray, minor: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(major, minor, summed count) of the distinct pairs in order, and the place among them of each pair."""
    order = np.lexsort((minor, major))
    major, minor = major[order], minor[order]
    new = np.ones(len(major), bool)
    new[1:] = (major[1:] != major[:-1]) | (minor[1:] != minor[:-1])
    at = np.flatnonzero(new)
    where = np.empty(len(order), np.int64)
    where[order] = np.cumsum(new) - 1
    return major[at], minor[at], np.add.reduceat(count[order], at) if len(at) else count, where


def level(context: np.ndarray, owner: np.ndarray, word: np.ndarray, count: np.ndarray, base: np.ndarray) -> tuple[Trie, np.ndarray]:
    """(trie, weight of each context) of counted n-grams; owner: each one's context as a place among the bases."""
    seen = count > 0
    own = owner[seen]
    mass = np.bincount(own, minlength=len(base)) * DISCOUNT
    trie = Trie.build(context[seen], word[seen], np.log10((count[seen] - DISCOUNT) / base[own])).mapped()
    return trie, coded(np.where(base > 0, mass / np.maximum(base, 1), 1.0))


def answers_of(messages: list[bytes]) -> list[bytes]:
    """What a partition answers each message: books, then the weights of contexts, codes and counts of bigrams, the weights of
    bigrams as contexts, and codes of trigrams."""
    got = [read_message(d) for d in messages]
    ends2, ends3, ends = (np.cumsum([len(x[i]) for x in got])[:-1] for i in (2, 5, 0))
    start2 = np.append(0, ends2)
    asked, given, v, w, c, at, w3, c3 = (np.concatenate([x[i] + start2[k] if i == 5 else x[i] for k, x in enumerate(got)]) for i in range(8))
    hot = [x[1] > 1 for x in got]
    hot = [np.isin(x[2], x[0][h]) for h, x in zip(hot, got)]  # bigrams of frequent words, whose counts the block may need
    del got
    contexts, own = np.unique(asked, return_inverse=True)
    base = np.zeros(len(contexts), np.int64)
    np.maximum.at(base, own, given)
    v, w, c, where2 = distinct(v, w, c)
    owner = np.searchsorted(contexts, v)
    base = np.where(base > 0, base, np.bincount(owner, c, len(contexts)).astype(np.int64))
    two, weight = level(v, owner, w, c, base)
    at, w3, c3, where3 = distinct(where2[at], w3, c3)
    three, weight3 = level(at.astype(U), at, w3, c3, c)
    codes, codes3 = two.lookup(v, w), three.lookup(at.astype(U), w3)  # one pass for the questions of all blocks
    books = b"".join(len(t.book).to_bytes(4, "little") + np.asarray(t.book, "<f2").tobytes() for t in (two, three))
    out = []
    for k2, k3, k1, h in zip(np.split(where2, ends2), np.split(where3, ends3), np.split(own, ends), hot):
        body = [books, planes(weight[k1]), codes[k2].tobytes(), shrink(c[k2[h]]), planes(weight3[k2]), codes3[k3].tobytes()]
        out.append(zstandard.ZstdCompressor(level=1).compress(b"".join(body)))
    return out


def coded(x: np.ndarray) -> np.ndarray:
    """Weights from 0 as 16-bit codes, 1/500 of an octave apart; 0 stays 0."""
    return np.where(x > 0, np.round(np.log2(np.maximum(x, 1e-18)) * 500) + 32768, 0).astype("<u2")


def weights(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 2.0 ** ((codes.astype(np.float64) - 32768) / 500), 0.0)


def planes(x: np.ndarray) -> bytes:
    """16-bit codes with bytes of equal weight together."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 2).T.tobytes()


def read_answer(d: bytes, n_contexts: int, n: int, n_hot: int, n3: int) -> tuple[np.ndarray, ...]:
    """(weights of contexts, first parts of bigrams, counts of frequent words' bigrams, weights of bigrams, first parts of trigrams)"""
    d, at, books = zstandard.ZstdDecompressor().decompress(d), 0, []
    for _ in range(2):
        k = int.from_bytes(d[at : at + 4], "little")
        books.append(np.concatenate([[0.0], 10.0 ** np.frombuffer(d, "<f2", k, at + 4).astype(np.float64)]))
        at += 4 + 2 * k

    def read(k: int, at: int) -> np.ndarray:
        return weights(np.ascontiguousarray(np.frombuffer(d, np.uint8, 2 * k, at).reshape(2, k).T).view("<u2").reshape(k))

    weight, at = read(n_contexts, at), at + 2 * n_contexts
    first, at = books[0][np.frombuffer(d, np.uint8, n, at)], at + n
    counts, at = grown(d, at, n_hot)
    weight3, at = read(n, at), at + 2 * n
    return weight, first, counts, weight3, books[1][np.frombuffer(d, np.uint8, n3, at)]


def probabilities(g: Grams, tokens: np.ndarray, unigram: np.ndarray, answers: dict[int, bytes]) -> np.ndarray:
    """P of each token of a block, from the partitions' answers."""
    weight = np.zeros(len(g.ask))
    first, pair_weight, pair_count, first3 = (np.zeros(n) for n in (len(g.word), len(g.word), len(g.word), len(g.word3)))
    for p, one, two, three in g.messages():
        hot = np.flatnonzero(g.given[two] > 1)
        weight[one], first[two], counts, pair_weight[two], first3[three] = read_answer(answers[p], one.stop - one.start, two.stop - two.start, len(hot), three.stop - three.start)
        pair_count[two.start + hot] = counts
    contexts, where = np.unique(g.ask, return_inverse=True)
    total = np.bincount(where, weight, len(contexts))  # over the partitions of a context
    place = np.minimum(np.searchsorted(contexts, g.names), len(contexts) - 1)
    own = np.where(contexts[place] == g.names, total[place], 0.0)
    p = first[g.pair] + own[g.before] * unigram[tokens]
    longer = p.copy()
    at = np.flatnonzero(g.triple >= 0)
    longer[at] = first3[g.triple[at]] + pair_weight[g.pair[at - 1]] * p[at]
    at = np.flatnonzero(g.split >= 0)
    count, place = pair_count[g.pair[at - 1]], g.split[at]
    raw = first[place] + total[np.searchsorted(contexts, g.context[place])] * p[at]
    longer[at] = np.where(count > 0, raw / np.maximum(count, 1), p[at])
    return longer


MESSAGE = "part int, block long, data binary"
_MESSAGE = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("data", pa.binary())])
_BLOCK = ("block", "words", "lengths", "tokens", "train")


def make_blocks(docs: DataFrame, id_col: str, text_col: str, is_train: F.Column) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        texts, ids, train, size, made = [], [], [], 0, TaskContext.get().partitionId() << 32

        def flush():
            words, lengths, tokens, n = pack(texts)
            joined = pa.concat_arrays(ids)
            lists = pa.ListArray.from_arrays(pa.array([0, len(joined)], pa.int32()), joined)
            return pa.RecordBatch.from_arrays(
                [pa.array([made], pa.int64()), lists, pa.array([train], pa.list_(pa.bool_())), *(pa.array([x], pa.binary()) for x in (words, lengths, tokens)), pa.array([n], pa.int64())],
                names=["block", "ids", "train", "words", "lengths", "tokens", "n"],
            )

        for batch in batches:
            flags = [bool(x) for x in batch.column(1).to_pylist()]
            for first, part in text_chunks(batch.select(["_text"]), "_text"):
                ids.append(batch.column(0).slice(first, len(part)))
                train += flags[first : first + len(part)]
                texts += [np.append(w, END) for w in word_hashes(part)]
                size += sum(map(len, part))
                if size >= BLOCK_BYTES:
                    yield flush()
                    texts, ids, train, size, made = [], [], [], 0, made + 1
        if texts:
            yield flush()

    rows = docs.select(id_col, is_train.alias("_train"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"block long, ids array<{kind}>, train array<boolean>, words binary, lengths binary, tokens binary, n long")


def score_texts(docs: DataFrame, is_train: F.Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_tokens, n_known, train_tokens, base_score, score.

    Null texts are empty; an empty text is its end token only. Words are runs of anything but ASCII white space with A-Z
    lowered, each text ends with one end token. Without training rows N is 0 and all words are unknown. Rows may repeat;
    each counts. A null is_train means held out. A text of any length is scored whole, as one block where it is longer than
    BLOCK_BYTES, so one text must fit a task. Other columns are not read; an empty table gives no rows.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()[0]
    # blocks are read three times and joined with what partitions answer; in buckets, they are never shuffled for it
    blocks = bucketed(make_blocks(docs, id_col, text_col, F.coalesce(is_train, F.lit(False))), "block", min(10_000, max(4, size // BLOCK_BYTES)), "blocks")
    total, train_docs = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size(F.filter("train", lambda x: x))), F.lit(0))).first()
    parts = max(4, -(-total // PART_TOKENS))

    def send_words(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words, lengths, tokens, train = unpack(row)
                count = np.bincount(tokens, np.repeat(train, lengths), len(words)).astype(np.int64)
                order, part = dealt_words(words, parts)
                for p, a, b in runs(part):
                    own = order[a:b]
                    yield pa.RecordBatch.from_pylist([{"part": p, "block": row["block"], "data": zstandard.ZstdCompressor(level=1).compress(len(own).to_bytes(8, "little") + shrink(np.diff(words[own], prepend=U(0)).view(np.int64)) + shrink(count[own]))}], schema=_MESSAGE)

    def add_words(pdf: pd.DataFrame) -> pd.DataFrame:
        data = [zstandard.ZstdDecompressor().decompress(d) for d in pdf["data"]]
        sizes = [int.from_bytes(d[:8], "little") for d in data]
        got = []
        for d, n in zip(data, sizes):
            gaps, at = grown(d, 8, n)
            got.append((np.cumsum(gaps.view(U), dtype=U), grown(d, at, n)[0]))
        words, where = np.unique(np.concatenate([w for w, _ in got]), return_inverse=True)
        count = np.bincount(where, np.concatenate([c for _, c in got]), len(words)).astype(np.int64)
        each = np.split(where, np.cumsum(sizes)[:-1])
        often = count * (HOT * parts) > total
        frequent = [np.concatenate([words[k], count[k].view(U)]).tobytes() for k in (w[often[w]] for w in each)]
        first = np.arange(len(pdf)) == 0
        return pd.DataFrame({"part": pdf["part"], "block": pdf["block"], "data": [zstandard.ZstdCompressor(level=1).compress(shrink(count[w])) for w in each], "tokens": np.where(first, count.sum(), 0), "kinds": np.where(first, (count > 0).sum(), 0), "often": frequent})

    counted = blocks.select(*_BLOCK).mapInArrow(send_words, MESSAGE).groupBy("part").applyInPandas(add_words, MESSAGE + ", tokens long, kinds long, often binary")
    counted = materialize(counted, "word-counts")
    n_train, kinds, hot_bytes = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0)), F.coalesce(F.sum(F.length("often") + 16), F.lit(0))).first()
    often = counted.where(F.length("often") > 0).groupBy("block").agg(F.collect_list("often").alias("often"))
    known = blocks.select(*_BLOCK).join(small(often, 1, hot_bytes), "block", "left")  # each block with its own frequent words

    def grams(words, lengths, tokens, train, frequent: list[bytes] | None) -> Grams:
        """The n-grams of a block; a word's share of all tokens says over how many partitions its n-grams are dealt."""
        found = [np.split(np.frombuffer(x, U), 2) for x in frequent or ()]
        keys, count = np.concatenate([np.zeros(0, U), *(w for w, _ in found)]), np.concatenate([np.zeros(0, U), *(c for _, c in found)]).astype(np.int64)
        given, place = np.zeros(len(words) + 1, np.int64), np.argsort(words)
        given[place[np.searchsorted(words, keys, sorter=place)]] = count
        given[:-1][words == END] = 0  # nothing follows the end
        given[-1] = train_docs if train_docs * HOT * parts > total else 0
        spread = np.where(given > 1, np.minimum(parts, 1 + (given / max(total, 1) * HOT * parts).astype(np.int64)), 1)
        return Grams(words, lengths, tokens, train, parts, spread, np.where(given > 1, given, 0))

    def send_grams(batches):
        for batch in batches:
            for row in batch.to_pylist():
                g = grams(*unpack(row), row["often"])
                for p, *slices in g.messages():
                    yield pa.RecordBatch.from_pylist([{"part": p, "block": row["block"], "data": g.message(*slices)}], schema=_MESSAGE)

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": pdf["part"], "block": pdf["block"], "data": answers_of(pdf["data"].tolist())})

    found = known.select(*_BLOCK, "often").mapInArrow(send_grams, MESSAGE).groupBy("part").applyInPandas(answer, MESSAGE)
    answers = counted.select(F.lit(0).alias("kind"), "part", "block", "data", "often").unionByName(found.select(F.lit(1).alias("kind"), "part", "block", "data", F.lit(None).cast("binary").alias("often")))

    def score(own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in own.iterrows():
            words, lengths, tokens, train = unpack(row)
            order, part = dealt_words(words, parts)
            by_words = got[got["kind"] == 0].sort_values("part")
            count = np.empty(len(words), np.int64)
            count[order] = np.concatenate([grown(zstandard.ZstdDecompressor().decompress(d), 0, b - a)[0] for d, (_, a, b) in zip(by_words["data"], runs(part))])
            g = grams(words, lengths, tokens, train, [x for x in by_words["often"] if x])
            base = (count + 1) / (n_train + kinds + 1)
            begins = np.cumsum(lengths) - lengths
            p = probabilities(g, tokens, base, {k: d for k, d in got.loc[got["kind"] == 1, ["part", "data"]].itertuples(index=False)})
            out.append(pd.DataFrame({
                id_col: list(row["ids"]), "n_tokens": lengths.astype(np.int64), "n_known": np.add.reduceat((count[tokens] > 0).astype(np.int64), begins), "train_tokens": n_train,
                "base_score": np.add.reduceat(np.log10(base)[tokens], begins), "score": np.add.reduceat(np.log10(p), begins),
            }))
        return pd.concat(out) if out else pd.DataFrame(columns=[id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.select("block", "ids", "train", "words", "lengths", "tokens").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(score, schema)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = id_hash(F.col("doc_id"), 7) == 2
    out = score_texts(documents(spark, sf_dir), ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
