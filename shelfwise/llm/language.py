"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed windows, the maximum over positions of each filter feeds a
softmax. The network is trained in numpy on windows of a bounded sample of labelled rows and applied to every window of
every text; a text's prediction is the mean of its windows' log probabilities, weighted by their bytes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, documents, id_hash, text_chunks

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 8
#: Bound of the training sample: rows, and windows of at most WINDOW characters taken from each.
TRAIN_ROWS = 8000
TRAIN_WINDOWS = 2
ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(b: bytes) -> bool:
    return bool(ASCII_LETTER.search(b)) or (not b.isascii() and any(c.isalpha() for c in b.decode("utf-8", "replace")))


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, owner, bytes): all texts cut into windows of WINDOW bytes, the last of each padded with zeros."""
    per = np.array([-(-len(b) // WINDOW) for b in texts], np.int64)
    flat = np.frombuffer(b"".join(b.ljust(n * WINDOW, b"\0") for b, n in zip(texts, per.tolist())), np.uint8)
    x = flat.reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(texts)), per)
    size = np.full(len(x), WINDOW, np.int64)
    last = np.cumsum(per)[per > 0] - 1
    rest = np.array([len(b) % WINDOW for b in texts], np.int64)[per > 0]
    size[last] = np.where(rest == 0, WINDOW, rest)
    return x, owner, size


class ByteCNN:
    """Parameters: embedding (256, EMBED), one filter matrix for all widths, filter bias, output matrix and bias."""

    def __init__(self, n_classes: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        span, n = max(WIDTHS), FILTERS * len(WIDTHS)
        self.mask = np.concatenate([np.repeat([[1.0] * (w * EMBED) + [0.0] * ((span - w) * EMBED)], FILTERS, 0) for w in WIDTHS]).T.astype(np.float32)
        self.p = {
            "emb": rng.normal(0, 0.5, (256, EMBED)), "conv": rng.normal(0, 0.3, (span * EMBED, n)) * self.mask, "cb": np.zeros(n),
            "out": rng.normal(0, 0.3, (n, n_classes)), "ob": np.zeros(n_classes),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def conv(self, x: np.ndarray) -> np.ndarray:
        e = self.p["emb"][x]
        cols = np.lib.stride_tricks.as_strided(e, (len(x), WINDOW - max(WIDTHS) + 1, max(WIDTHS) * EMBED), e.strides)
        return (np.ascontiguousarray(cols).reshape(-1, cols.shape[2]) @ self.p["conv"]).reshape(*cols.shape[:2], -1)

    def log_probs(self, x: np.ndarray, step: int = 256) -> np.ndarray:
        out = []
        for i in range(0, len(x), step):
            z = np.maximum(self.conv(x[i : i + step]).max(1) + self.p["cb"], 0) @ self.p["out"] + self.p["ob"]
            z = z - z.max(1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, len(self.p["ob"])), np.float32)

    def grads(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n, span = self.p, len(x), max(WIDTHS)
        a = self.conv(x)
        at = a.argmax(1)
        pooled = np.take_along_axis(a, at[:, None, :], 1)[:, 0] + p["cb"]
        h = np.maximum(pooled, 0)
        z = h @ p["out"] + p["ob"]
        q = np.exp(z - z.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[np.arange(n), y] -= 1
        q /= n
        dh = (q @ p["out"].T) * (pooled > 0)
        seen = x[np.arange(n)[:, None, None], at[:, :, None] + np.arange(span)]  # (n, filters, span): bytes under each maximum
        e = p["emb"][seen].reshape(n, at.shape[1], -1)
        g = {"out": h.T @ q, "ob": q.sum(0), "cb": dh.sum(0), "conv": np.einsum("nf,nfk->kf", dh, e) * self.mask}
        de = (dh[:, :, None] * p["conv"].T[None]).reshape(-1, EMBED)
        flat = seen.ravel()
        g["emb"] = np.stack([np.bincount(flat, de[:, j], 256) for j in range(EMBED)], 1)
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.01, seed: int = 5) -> ByteCNN:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        t, total = 0, epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                t += 1
                now = rate * (1 - t / (total + 1))
                for k, g in self.grads(x[order[i : i + batch]], y[order[i : i + batch]]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self


def train(df: DataFrame, usable: F.Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, seed: int = 9):
    """(classes, network or None) from at most `rows` rows where `usable` holds and lang is not null, in a seeded hash order.
    Windows start at seeded places of the texts, so what reaches the driver is bounded by rows * TRAIN_WINDOWS * WINDOW characters."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.length(text)
    places = [F.when(n > WINDOW, F.pmod(F.xxhash64(F.lit(seed + i), F.lit(text_col), n), n - WINDOW)).otherwise(0).cast("int") + 1 for i in range(TRAIN_WINDOWS)]
    cut = F.array(*(F.substring(text, p, F.lit(WINDOW)) for p in places))
    open_rows = df.where(usable & F.col(lang_col).isNotNull())
    picked = open_rows.where(text.rlike(r"\p{L}")).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), cut.alias("cut"))
    got = sorted(bounded_sample(picked, "id", rows, seed, open_rows.count()).select("lang", "cut").collect())
    classes = sorted({r["lang"] for r in got})
    if len(classes) < 2:
        return classes, None
    xs, ys = [], []
    for r in got:
        for s in r["cut"]:
            b = s.encode()[:WINDOW]
            if has_letter(b):
                xs.append(b.ljust(WINDOW, b"\0"))
                ys.append(classes.index(r["lang"]))
    x = np.frombuffer(b"".join(xs), np.uint8).reshape(-1, WINDOW)
    return classes, ByteCNN(len(classes)).fit(x, np.array(ys))


def predict(df: DataFrame, classes: list[str], net: ByteCNN | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score for each row. `und` with score 0 for texts that are null, empty or without a letter, and for
    all rows if nothing could be learned; with one class, that class with score 1. Every window of a text counts,
    however long it is. Of equally likely classes the first in order is taken; repeated rows and null ids are rows like others; an
    empty table gives no rows. Columns but these two are not read, so their names cannot clash."""

    def run(batches):
        for batch in batches:
            names, scores = [], []
            for _, texts in text_chunks(batch.select(["_text"]), "_text"):
                total = np.zeros((len(texts), len(classes)))
                if net is not None:
                    x, owner, size = windows_of(texts)
                    part = net.log_probs(x).astype(np.float64) * size[:, None]
                    for c in range(len(classes)):
                        total[:, c] = np.bincount(owner, part[:, c], len(texts))
                    total /= np.maximum(np.bincount(owner, size, len(texts)), 1)[:, None]
                q = np.exp(total - total.max(1, keepdims=True)) if classes else total
                for i, b in enumerate(texts):
                    ok = bool(classes) and has_letter(b)
                    k = int(q[i].argmax()) if ok else 0
                    names.append(classes[k] if ok else "und")
                    scores.append(float(q[i, k] / q[i].sum()) if ok else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    classes, net = train(docs, id_hash(F.col("doc_id"), 4) != 2)
    out = predict(docs.select("doc_id", "text"), classes, net)
    return out.select("doc_id", (id_hash(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
