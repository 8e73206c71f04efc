"""Scratch tables in the folder that driver and executors share, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only when its measured size stays under this; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Where that is unset, a temporary folder of this
    process, but only in local mode: on a cluster executors would write to folders of their own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="shelfwise-"))
        path = _own[0]
    return path.rstrip("/")


_written: list[str] = []


def release(spark: SparkSession) -> None:
    """Delete the scratch tables that this process has written; call it once results that read them are written."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in _written:
        at = fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _written.clear()
    for table in _tables:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    _tables.clear()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which `release` deletes."""
    path = f"{shared_dir(spark)}/shelfwise/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_tables: list[str] = []


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """Like materialize, in buckets by key: what is grouped or joined by key is not shuffled again on this side."""
    spark, table = df.sparkSession, f"shelfwise_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).format("parquet").option("path", scratch(spark, name)).saveAsTable(table)
    _tables.append(table)
    return spark.table(table)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if rows * row_bytes is within BROADCAST_BYTES; else df, for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over a number of tasks that follows from the cluster alone: for rows that are few bytes and much work
    (paths, specs), which Spark would otherwise put into one task by their bytes."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def running_sum(ordered_rows: DataFrame, value: Column, column: str) -> DataFrame:
    """Sorted rows with the sum of `value` over the rows before each, and `_row`, a number that keeps their order. The sort's
    partitions are summed up one by one; their totals, one row each, give the offsets, so no task sees all rows."""
    rows = materialize(ordered_rows.withColumns({"_row": F.monotonically_increasing_id(), "_value": value}), "ordered")
    rows = rows.withColumn("_part", F.shiftright("_row", 33))
    within = F.sum("_value").over(Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1))
    totals = rows.groupBy("_part").agg(F.sum("_value").alias("_n"))
    before = totals.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before_part"))
    summed = rows.withColumn(column, F.coalesce(within, F.lit(0))).join(F.broadcast(before), "_part")
    return summed.withColumn(column, F.col("_before_part") + F.col(column)).drop("_part", "_value", "_before_part")
