"""Registered queries against their DuckDB SQL on tables of a few rows, and the entry without the corpus operators."""

import importlib
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfwise import queries as Q

duckdb = pytest.importorskip("duckdb")
ROOT = Path(__file__).parent.parent


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    n = 60
    part = spark.range(n).select(F.col("id").alias("p_partkey"), F.concat(F.lit("P"), "id").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("SMALL TIN").alias("p_type"), (F.col("id") % 50 + 1).cast("int").alias("p_size"))
    lines = spark.range(800).select((F.col("id") * 37 % n).alias("l_partkey"), (F.col("id") / 4).cast("long").alias("l_orderkey"), (F.col("id") % 100).alias("l_suppkey"), (F.col("id") % 4 + 1).cast("int").alias("l_linenumber"))
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 3 == 0, "The text of ").otherwise("é"), F.col("id").cast("string"), F.lit(" and some more")).alias("text"))
    orders = spark.range(300).select((F.col("id") * 7).alias("o_orderkey"))
    events = spark.range(50).select(F.col("id").alias("event_id"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 1_234_567).cast("timestamp_ntz").alias("ts"))
    for name, df in (("part", part), ("lineitem", lines), ("documents", docs), ("orders", orders), ("events", events)):
        df.coalesce(1).write.parquet(f"{d}/{name}.parquet")
    con = duckdb.connect()
    for name in ("part", "lineitem", "documents", "orders", "events"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet/*.parquet'")
    return d, con


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, tables, name):
    d, con = tables
    got = Q.queries()[name](spark, d).toPandas()
    want = con.sql(Q.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[cols].astype(object).where(df[cols].notna(), None).astype(str).values.tolist()))
    assert rows(got) == rows(want)


def test_every_query_runs(spark, tables):
    for name in sorted(set(Q.queries()) - set(Q.oracle_sql())):
        assert Q.queries()[name](spark, tables[0]).count() > 0


def test_workers_of_a_session_from_another_folder(tmp_path):
    """Python workers and the process of a stream's source find the package though neither their folder nor PYTHONPATH leads to it."""
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from shelfwise.workers import ship
from shelfwise.operators.headers import BUNDLED
ship(spark); ship(spark)
def run(batches):
    import shelfwise.operators.headers as h
    for b in batches:
        assert len(h.BUNDLED) == {13}
        yield b
print("rows", spark.range(10).mapInArrow(run, "id long").count())
from shelfwise.sources.listing import arriving_files
open("a", "w").write("1")
q = arriving_files(spark, ["."]).writeStream.foreachBatch(lambda df, _: print("arrived", df.count())).trigger(availableNow=True).start()
q.awaitTermination()
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert "rows 10" in out.stdout and "arrived 1" in out.stdout, out.stderr[-2000:]


def test_entry_without_corpus_operators(tmp_path):
    """The entry imports where the corpus operators' folder and the pipeline are gone, and only then is their absence passed over."""
    for p in ROOT.iterdir():
        if p.name in ("__spark_entry__.py",):
            (tmp_path / p.name).write_bytes(p.read_bytes())
    package = tmp_path / "shelfwise"
    for p in (ROOT / "shelfwise").rglob("*.py"):
        if "llm" not in p.parts:
            to = package / p.relative_to(ROOT / "shelfwise")
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_bytes(p.read_bytes())
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    out = run()
    assert out.returncode == 0 and out.stdout.split()[0] == str(len(Q.queries())), out.stderr
    (package / "llm").mkdir()
    (package / "llm" / "__init__.py").write_text("")
    (package / "llm" / "queries.py").write_text("import no_such_module\n")
    assert "no_such_module" in run().stderr
    importlib.invalidate_caches()
