"""The corpus pipeline: quality, near-duplicates, benchmark leaks, source mixing, shards, each over what the one before kept.

Every stage works on rows: a row that repeats is a row each time, ids and any other column may be null, texts may be null,
empty or of any length, ties are broken by id and then by the order of rows, and an empty table gives an empty table. All
columns of documents stay, whatever their names; only the last stage adds `shard` and `slot`, in place of columns so named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import documents, free_name, id_hash, materialize, small
from shelfwise.llm.decontaminate import find_leaks
from shelfwise.llm.minhash import near_duplicates
from shelfwise.llm.mixing import DOMAINS, WEIGHTS, mix
from shelfwise.llm.quality import score_documents, train
from shelfwise.llm.sharding import shard_rows

THRESHOLD = 0.3
MIX_SHARE = 0.8
SHARDS = 40


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, and that column's name. They are written, so that the numbers stay."""
    row = free_name(docs, "_row")
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def _with_rows(docs: DataFrame, row: str, kept: DataFrame) -> DataFrame:
    """The rows of docs whose number is in kept, without it."""
    kept = materialize(kept, "kept")
    return docs.join(small(kept, kept.count(), 32), row, "left_semi").drop(row)


def _apart(docs: DataFrame) -> tuple[DataFrame, list[F.Column]]:
    """docs with the columns that stages do not read under names that no operator uses, and what names them back."""
    names = {c: c if c in ("doc_id", "text") else f"_own{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), [F.col(n).alias(c) for c, n in names.items()]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores THRESHOLD or more; texts that are null or empty have the score of no words."""
    docs, back = _apart(docs)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), id_hash(F.col("doc_id"), 5) != 0)
    return score_documents(docs, model, docs.columns).where(F.col("score") >= THRESHOLD).select(back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the row of the smallest id; null ids come
    last, and of rows with one id the first stays. Rows without words stand alone and stay."""
    docs, row = _numbered(docs)
    key, text = free_name(docs, "_key"), F.xxhash64("text")
    ranked = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), text.alias("c"), F.col(row).alias("row"))  # the order of ids
    groups = near_duplicates(docs.select(ranked.alias(key), "text"), id_col=key)
    return _with_rows(docs, row, groups.where(F.col(f"{key}.row") == F.col("component_id.row")).select(F.col(f"{key}.row").alias(row)))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs within its edit budget; texts that are null or empty have none."""
    docs, back = _apart(docs)
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("leaks") == 0).select(back)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MIX_SHARE of all words, dealt over domains, languages and sources by weight; each row at most once."""
    docs, row = _numbered(docs)
    chosen = mix(docs, DOMAINS, WEIGHTS, MIX_SHARE, 1, 20, keep=(row,))
    return _with_rows(docs, row, chosen.where(F.col("epochs_taken") > 0).select(row))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot; equal or null ids are told apart by n_chars."""
    return shard_rows(docs, "doc_id", SHARDS, tie=["n_chars"])


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mixing", mixing), ("sharding", sharding)]

#: MinHash links, edit budgets and the trained rules are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
