"""Exact deduplication against immutable snapshots that carry static binary-fuse filters.

A snapshot holds one row per distinct digest, dealt into buckets by digest, and one filter per bucket. An incoming batch
is first grouped by digest on its own, so copies inside the batch meet there; each distinct digest is then screened by its
bucket's filter, and only positives are joined with the snapshot's bucket. Groups that come out with more than one row are
checked byte for byte: their texts are grouped by (digest, text), with a partial aggregate before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_hash, materialize, norm_text, small
from .fuse import BinaryFuse

#: Digests of a bucket: a filter of about 0.5 MB, built in one task.
BUCKET_KEYS = 200_000


def _keys(digests) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(d[:8]) for d in digests), ">u8").astype(np.uint64) if len(digests) else np.zeros(0, np.uint64)


def digest_groups(rows: DataFrame, buckets: int) -> DataFrame:
    """bucket, digest, keep (smallest id), n: one row per distinct digest of rows (id, digest)."""
    g = rows.groupBy("digest").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int"))


def snapshot_filters(snapshot: DataFrame) -> DataFrame:
    """bucket, filter: the binary-fuse filter of each bucket of a snapshot, of about BUCKET_KEYS digests."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "filter": [BinaryFuse.build(_keys(pdf["digest"].tolist())).to_bytes()]})

    return snapshot.select("bucket", "digest").groupBy("bucket").applyInPandas(build, "bucket int, filter binary")


def screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """incoming groups with `maybe`: False means that the snapshot surely lacks the digest."""

    def probe(inc: pd.DataFrame, flt: pd.DataFrame) -> pd.DataFrame:
        hit = BinaryFuse.from_bytes(flt["filter"].iloc[0]).holds(_keys(inc["digest"].tolist())) if len(flt) and len(inc) else np.zeros(len(inc), bool)
        return inc.assign(maybe=hit)

    ids = incoming.schema["keep"].dataType.simpleString()
    return incoming.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(probe, f"digest binary, keep {ids}, n long, bucket int, maybe boolean")


def exact_dedup(docs: DataFrame, in_snapshot: F.Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, digest (SHA-256 of the normalised text), keep_id, group_size.

    Rows where in_snapshot holds are the immutable snapshot, the others, null included, the incoming batch. Null texts count as empty and
    are one group with empty and all-white texts' own form (a single space stays a space). Of equal texts the smallest id
    stays; rows that repeat the id of the row that stays carry it as keep_id too; null ids stay only among themselves.
    Other columns are not read, so their names cannot clash. An empty table gives no rows. Texts of any length that Spark holds in
    a row count whole; for the byte check a text is one grouping key, so a task holds a few at a time.
    """
    norm = norm_text(F.col(text_col))
    digested = docs.select(F.col(id_col).alias("id"), norm.alias("norm"), F.coalesce(in_snapshot, F.lit(False)).alias("old"))
    digested = digested.withColumn("digest", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
    rows = materialize(digested.select("id", "digest", "old"), "digests")

    buckets = max(1, -(-rows.count() // BUCKET_KEYS))
    snapshot = materialize(digest_groups(rows.where("old"), buckets), "snapshot")
    filters = materialize(snapshot_filters(snapshot), "filters")
    fresh = materialize(screen(digest_groups(rows.where("not old"), buckets), filters), "screened")

    hits = fresh.where("maybe").select("digest", F.col("keep").alias("keep2"), F.col("n").alias("n2"))
    exact = snapshot.select("digest", "keep", "n").join(hits, "digest", "full").select(
        "digest", F.least("keep", "keep2").alias("keep"), (F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n")
    )
    groups = exact.unionByName(fresh.where("not maybe").select("digest", "keep", "n"))
    many = materialize(groups.where("n > 1"), "groups")
    n_many = many.count()

    # byte check of every group of two or more; copies merge before the shuffle
    checked = digested.join(small(many.select("digest"), n_many, 48), "digest", "left_semi")
    variants = checked.groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    counted = materialize(variants.select("digest", "keep_id", "group_size", F.sha2(F.col("norm").cast("binary"), 512).alias("other")), "checked")
    clash = counted.groupBy("digest").count().where("count > 1").select("digest")
    single = counted.join(clash, "digest", "left_anti") if (broken := not clash.isEmpty()) else counted
    out = rows.join(small(single.select("digest", "keep_id", "group_size"), n_many, 64), "digest", "left")
    if broken:  # different texts with one SHA-256: told apart by the texts' own bytes
        apart = digested.join(clash, "digest", "left_semi").join(variants, ["digest", "norm"]).select("id", "digest", "old", "keep_id", "group_size")
        out = out.join(clash, "digest", "left_anti").select(apart.columns).unionByName(apart)
    return out.select(
        F.col("id").alias(id_col), F.coalesce("keep_id", "id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "digest"
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = exact_dedup(docs, id_hash(F.col("doc_id"), 2) == 0)
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


OP1_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM n
"""
