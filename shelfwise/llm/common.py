"""Helpers shared by the corpus operators: shared scratch tables, checked broadcasts, Arrow text access."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import bucketed, materialize, shared_dir, small  # noqa: F401 (used by the operators)

#: ASCII white space of the corpus contracts.
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def norm_text(col) -> F.Column:
    """Runs of ASCII white space become one space; null becomes empty. Single spaces are left alone, so few matches."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def id_hash(col, mod: int) -> F.Column:
    """crc32 of the id's decimal text, modulo `mod`; null ids count as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df has it."""
    while name in df.columns:
        name += "_"
    return name


def bounded_sample(df: DataFrame, key: str, rows: int, seed: int, eligible: int) -> DataFrame:
    """At most `rows` rows of df in the order of a seeded hash of key (equal keys together). A hash threshold from the number
    of eligible rows comes first, so tasks send on few rows whatever their number."""
    share = min(1.0, (1.5 * rows + 1000) / max(eligible, 1))
    h = F.xxhash64(F.lit(seed), F.col(key))
    return df.where(h <= min(2**63 - 1, int(share * 2**64) - 2**63)).orderBy(h, key).limit(rows)


def text_chunks(batch: pa.RecordBatch, col: str = "text", max_bytes: int = 1 << 20):
    """Yield (first row, list of UTF-8 bytes) for slices of a batch; a slice ends once it holds max_bytes."""
    values = batch.column(batch.schema.get_field_index(col))
    if not pa.types.is_binary(values.type) and not pa.types.is_large_binary(values.type):
        values = values.cast(pa.large_binary())
    first, part, size = 0, [], 0
    for i, v in enumerate(values):
        b = v.as_py() or b""
        part.append(b)
        size += len(b)
        if size >= max_bytes:
            yield first, part
            first, part, size = i + 1, [], 0
    if part:
        yield first, part


WHITE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(b: bytes, size: int = 1 << 20):
    """b in pieces of about size bytes that end after white space (longer where there is none)."""
    at = 0
    while len(b) - at > size:
        cut = WHITE.search(b, at + size)
        if cut is None:
            break
        yield b[at : cut.end()]
        at = cut.end()
    yield b[at:] if at else b


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (multiply and xor-shift), bijective on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
