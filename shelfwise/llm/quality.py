"""Quality classifier: a sparse rule ensemble over text statistics.

Shallow boosted trees are grown on the statistics of a bounded sample of labelled rows, every path from a root becomes a
conjunctive rule, a lasso logistic regression keeps a few rules with weights, and the kept rules are compiled into one
Spark column over the statistics of every whole text.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, documents, free_name, id_hash, pieces, text_chunks

#: Bound of the training sample.
TRAIN_ROWS = 20_000
STATS = (
    "log_bytes", "log_words", "word_len", "upper", "digit", "punct", "symbol", "wide", "space", "bang", "pipe", "sentence_end",
    "distinct_words", "top_word", "line_len", "dup_lines", "caps_words", "symbol_words", "long_words", "short_words", "pair_dups", "char_entropy", "links", "max_word", "comma", "lines",
)
LINK = re.compile(rb"https?://|www\.|@")
KIND = np.zeros(256, np.uint8)  # 1 upper, 2 digit, 3 punctuation, 4 symbol, 5 wide, 6 space
for _lo, _hi, _k in ((65, 90, 1), (48, 57, 2), (33, 47, 3), (58, 64, 3), (91, 96, 4), (123, 126, 4), (128, 255, 5), (9, 13, 6), (32, 32, 6)):
    KIND[_lo : _hi + 1] = _k
KIND[[ord(c) for c in "#$%&*+/<=>@"]] = 4


def stats_of(b: bytes) -> list[float]:
    """The statistics in STATS of one text; all zero for an empty one."""
    if not b:
        return [0.0] * len(STATS)
    n = len(b)
    hist = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    kinds = np.bincount(KIND, hist, 7) / n
    count, seen, last, size, total, top_size, caps, odd, long_ones, short_ones, m = Counter(), [], [], 0, 0, 0, 0, 0, 0, 0, 0
    for piece in pieces(b):
        words = piece.split()
        count.update(words)
        run = last + words
        near = set(map(hash, zip(run, run[1:])))  # 64 bits of each pair
        seen.append(np.fromiter(near, np.int64, len(near)))
        last = run[-1:]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        total, size, top_size = total + len(words), size + int(sizes.sum()), max(top_size, int(sizes.max(initial=0)))
        caps += sum(w.isupper() and len(w) > 1 for w in words)
        odd += sum(not w.isalnum() and not w[:1].isalpha() and w[0] < 128 for w in words)
        long_ones, short_ones = long_ones + int((sizes > 20).sum()), short_ones + int((sizes < 3).sum())
    pairs = len(seen[0]) if len(seen) == 1 else len(np.unique(np.concatenate(seen)))
    m = max(1, total)
    lines = [x for x in b.split(b"\n") if x.strip()]
    p = hist[hist > 0] / n
    return [
        float(np.log1p(n)), float(np.log1p(total)), size / m, *(float(kinds[k]) for k in range(1, 7)), hist[33] / n, hist[124] / n, (hist[46] + hist[63] + hist[33]) / m,
        len(count) / m, max(count.values(), default=0) / m, n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
        caps / m, odd / m, long_ones / m, short_ones / m, 1 - pairs / max(1, total - 1) if total > 1 else 0.0, float(-(p * np.log2(p)).sum()), len(LINK.findall(b)) / m, float(np.log1p(top_size)), hist[44] / m, float(np.log1p(len(lines))),
    ]


def statistics(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns `keep` of df and one double column per statistic of the whole text (null counts as empty).
    Columns of df that are named as a statistic's are left out."""
    keep = [c for c in keep if c not in {f"s_{s}" for s in STATS}]
    own = text_col if text_col in keep else free_name(df, "_text")

    def run(batches):
        for batch in batches:
            rows = [stats_of(b) for _, texts in text_chunks(batch, own) for b in texts]
            cols = np.array(rows, np.float64).reshape(len(rows), len(STATS)).T
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c) for c in cols)], names=[*keep, *(f"s_{s}" for s in STATS)])

    head = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    extra = [] if text_col in keep else [F.col(text_col).alias(own)]
    return df.select(*keep, *extra).mapInArrow(run, ", ".join(filter(None, [head, *(f"s_{s} double" for s in STATS)])))


Rule = tuple[tuple[int, str, float], ...]


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, bins: int = 32, rate: float = 0.3, seed: int = 3) -> list[Rule]:
    """Rules (conjunctions of statistic <= or > threshold) from the paths of gradient-boosted trees."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)])  # bin b: value <= cuts[b]
    score, rules = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), set()

    def tidy(path) -> Rule:
        low, high = {}, {}
        for j, op, t in path:
            if op == ">":
                low[j] = max(t, low.get(j, t))
            else:
                high[j] = min(t, high.get(j, t))
        return tuple(sorted([(j, ">", t) for j, t in low.items()] + [(j, "<=", t) for j, t in high.items()]))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p) + 1e-9
        use = rng.random(len(y)) < 0.5
        features = rng.permutation(x.shape[1])[: max(1, x.shape[1] * 2 // 3)]
        nodes = [(np.arange(len(y)), ())]
        for level in range(depth + 1):
            nxt = []
            for rows, path in nodes:
                own = rows[use[rows]]
                best = None
                if level < depth and len(own) >= 40:
                    gs, hs = g[own].sum(), h[own].sum()
                    for j in features:
                        if not len(cuts[j]):
                            continue
                        gl = np.cumsum(np.bincount(binned[j][own], g[own], len(cuts[j]) + 1))[:-1]
                        hl = np.cumsum(np.bincount(binned[j][own], h[own], len(cuts[j]) + 1))[:-1]
                        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                        k = int(gain.argmax())
                        if gain[k] > 1e-3 and (best is None or gain[k] > best[0]):
                            best = (gain[k], j, k)
                if best is None:
                    score[rows] += rate * g[own].sum() / (h[own].sum() + 1)
                    continue
                _, j, k = best
                left = binned[j][rows] <= k
                for part, op in ((rows[left], "<="), (rows[~left], ">")):
                    step = (*path, (int(j), op, float(cuts[j][k])))
                    rules.add(tidy(step))
                    nxt.append((part, step))
            nodes = nxt
    return sorted(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, op, t in rule:
        out &= x[:, j] <= t if op == "<=" else x[:, j] > t
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, lam: float, start: np.ndarray | None = None, steps: int = 300) -> np.ndarray:
    """Weights (the first is the unpenalised bias) that minimise mean log loss + lam * |w|_1, by accelerated proximal steps."""
    a = np.column_stack([np.ones(len(r), np.float32), r])
    v = np.random.default_rng(0).normal(size=a.shape[1]).astype(np.float32)
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 4 * len(y) / float(np.linalg.norm(a @ v) ** 2 + 1e-9)
    w = np.zeros(a.shape[1], np.float32) if start is None else start.copy()
    z, t = w.copy(), 1.0
    for _ in range(steps):
        grad = a.T @ (1 / (1 + np.exp(-np.clip(a @ z, -30, 30))) - y) / len(y)
        new = z - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * lam, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = (new + (t - 1) / t2 * (new - w)).astype(np.float32), new.astype(np.float32), t2
    return w


class RuleEnsemble:
    def __init__(self, bias: float, rules: list[tuple[float, Rule]]):
        self.bias, self.rules = bias, rules

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
        """With fewer than two labels among the rows, a constant score: the share of label 1, or 0.5 without rows."""
        if len(y) == 0 or y.min() == y.max():
            p = min(0.999, max(0.001, float(y.mean()) if len(y) else 0.5))
            return cls(float(np.log(p / (1 - p))), [])
        rules = grow_rules(x, y)
        r = np.column_stack([holds(k, x) for k in rules]).astype(np.float32) if rules else np.zeros((len(y), 0), np.float32)
        keep = (r.mean(0) > 0.002) & (r.mean(0) < 0.998)
        rules, r = [k for k, ok in zip(rules, keep) if ok], r[:, keep]
        fold = np.arange(len(y)) % 5 == 0
        best, w = None, None
        for lam in (0.01, 0.003, 0.001, 0.0003):
            w = lasso_logistic(r[~fold], y[~fold], lam, w, 150)
            p = np.clip(1 / (1 + np.exp(-(w[0] + r[fold] @ w[1:]))), 1e-6, 1 - 1e-6)
            loss = -np.mean(y[fold] * np.log(p) + (1 - y[fold]) * np.log(1 - p))
            if best is None or loss < best[0] - 1e-4:
                best = (loss, lam, w)
        w = lasso_logistic(r, y, best[1], best[2])
        return cls(float(w[0]), [(float(c), k) for c, k in zip(w[1:], rules) if abs(c) > 1e-3])

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.bias + sum((c * holds(k, x) for c, k in self.rules), np.zeros(len(x)))
        return 1 / (1 + np.exp(-z))

    def column(self) -> F.Column:
        """The score as one Spark expression over the statistics' columns."""
        z = F.lit(self.bias)
        for c, rule in self.rules:
            cond = F.lit(True)
            for j, op, t in rule:
                s = F.col(f"s_{STATS[j]}")
                cond = cond & ((s <= t) if op == "<=" else (s > t))
            z = z + F.when(cond, F.lit(c)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def train(docs: DataFrame, labels: DataFrame, usable: F.Column, rows: int = TRAIN_ROWS, seed: int = 3) -> RuleEnsemble:
    """Fit on at most `rows` labelled rows (doc_id, quality) where `usable` holds on doc_id, in a seeded hash order.

    Null labels and ids are left out. Equal labels of a doc_id count once, different ones once each; of documents that share
    a doc_id the one of the least statistics counts, so no more than `rows` rows reach the driver. Without labels the model
    is a constant.
    """
    ids = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & usable).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    ids = bounded_sample(ids, "doc_id", rows, seed, ids.count())
    picked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most `rows` ids
    names = [f"s_{s}" for s in STATS]
    each = statistics(picked, "text", ["doc_id", "quality"]).groupBy("doc_id", "quality").agg(F.min(F.struct(*names)).alias("s"))
    got = each.select("doc_id", "quality", "s.*").toPandas().sort_values(["doc_id", "quality"], ignore_index=True)
    x = got[names].to_numpy(np.float64)
    return RuleEnsemble.fit(x, (got["quality"].to_numpy() == 1).astype(np.float32))


def score_documents(docs: DataFrame, model: RuleEnsemble, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of docs and `score`, 0 to 1, for every row, repeated rows too; null and empty texts get the score of
    empty statistics, texts of any length that of the whole text, equal texts equal scores. Kept columns that are named
    `score` or like a statistic (`s_...`) are left out. An empty table gives no rows."""
    scored = statistics(docs, text_col, [c for c in keep if c != "score"])
    return scored.select(*(c for c in scored.columns if c in keep), model.column().alias("score"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, id_hash(F.col("doc_id"), 5) != 0)
    out = score_documents(docs, model, ["doc_id"])
    return out.select("doc_id", (id_hash(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
