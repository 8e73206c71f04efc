"""Token counts with a whole-token shortcut.

Offline, on the driver, every vocabulary string that ends a word is run through the tokenizer; those that come back as
exactly one token are proven whole. On the executors a text is cut at ASCII white space, which no pre-token crosses, each
piece is cut into pre-tokens, whole ones count 1 straight from the table and only the rest goes through the merges.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, pieces, text_chunks

#: The pre-token pattern of the tokenizer file, narrowed to lower-case ASCII without control characters.
ASCII_PRE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
PLAIN = re.compile(rb"[!-~]*\Z")
CACHE_WORDS = 400_000
#: Bytes of the longest pieces whose counts are kept.
LONGEST = 64


def prove_whole(tokenizer_json: str) -> frozenset[str]:
    """Lower-case ASCII pre-tokens that the tokenizer gives back as one token. Bounded by the vocabulary."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenizer_json)
    suffix = t.model.end_of_word_suffix or ""
    strings = [s[: len(s) - len(suffix)] for s in t.get_vocab(with_added_tokens=False) if s.endswith(suffix)]
    strings = [s for s in strings if s and PLAIN.match(s.encode()) and ASCII_PRE.findall(s) == [s]]
    return frozenset(s for s, e in zip(strings, t.encode_batch(strings, add_special_tokens=False)) if len(e.ids) == 1)


class WordCounts(dict):
    """Token counts by white-space delimited piece, made on demand; emptied by `trim` when it has grown too large."""

    def __init__(self, tokenizer_json: str, whole: frozenset[str]):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_str(tokenizer_json)
        self.special = [a.content.encode() for a in self.t.get_added_tokens_decoder().values()]
        self.whole = whole
        self.held = lru_cache(200_000)(self.merge)  # of short pre-tokens, so bounded in bytes too

    def merge(self, pre: str) -> int:
        return len(self.t.model.tokenize(pre))

    def merged(self, pre: str) -> int:
        return self.held(pre) if len(pre) <= LONGEST else self.merge(pre)

    def __missing__(self, word: bytes) -> int:
        if PLAIN.match(word) and not any(s in word for s in self.special):
            n = sum(1 if pre in self.whole else self.merged(pre) for pre in ASCII_PRE.findall(word.decode().lower()))
        else:
            n = len(self.t.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)
        if len(word) <= LONGEST:
            self[word] = n
        return n

    def trim(self) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()


def count_tokens(df: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per row of df: id_col, n_bytes, n_tokens, over_limit. Null and empty texts have 0 tokens; texts of any length
    are counted whole; repeated rows each count; other columns, whatever their names, are not read. An empty table gives no rows."""
    sc = df.sparkSession.sparkContext
    held = sc.broadcast((tokenizer_json, prove_whole(tokenizer_json)))  # bounded by the vocabulary, not by the input

    def run(batches):
        counts = WordCounts(*held.value)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for _, texts in text_chunks(batch.select(["_text"]), "_text"):
                for b in texts:
                    n_bytes.append(len(b))
                    n_tokens.append(sum(sum(map(counts.__getitem__, p.split())) for p in pieces(b)))
                counts.trim()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, df[text_col].alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    with open(tokenizer_path, encoding="utf-8") as f:
        return count_tokens(documents(spark, sf_dir), f.read())
