"""Physical plans: one shuffle by family, limits before it, no Python on the catalog path, pruned scans."""

from pyspark.sql import functions as F

from shelfwise.config import Filter, PostFilter, Preference
from shelfwise.operators.derive import derive
from shelfwise.operators.filters import apply_filter, post_filter
from shelfwise.operators.ranking import pick_best
from shelfwise.sources.files import list_files, scan

from .test_catalog import table


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def details_of(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_family_plan(spark):
    games = derive(table(spark, ["A (USA)", ("B", "A (USA)")]))
    plan = plan_of(pick_best(games, Preference(regions=("USA",))))
    assert plan.count("Exchange hashpartitioning(parent_name") == 1 and plan.count("WindowGroupLimit") == 2
    plan = plan_of(pick_best(post_filter(apply_filter(games, Filter(include_regions=("USA",))), PostFilter(("x",))), Preference()))
    # the families to drop go by a small exchange of their own; of the games only each task's best of a family are shuffled
    assert plan.count("WindowGroupLimit") == 2 and plan.index("WindowGroupLimit") < plan.index("LeftAnti") and "Python" not in plan and "Pandas" not in plan


def test_scan_plan(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    held = spark.read.format("binaryFile").load(str(tmp_path))
    assert "LessThanOrEqual(length" in plan_of(scan(held, (1, 10), by_content=True))
    listing = list_files(spark, [str(tmp_path)], (1, 10), archives=False).where(F.col("length").between(1, 10))
    assert "PushedFilters: [IsNotNull(length), GreaterThanOrEqual(length,1), LessThanOrEqual(length,10)]" in details_of(listing) and listing.count() == 1
    wider = list_files(spark, [str(tmp_path)], (1, 10), archives=False).where(F.col("length").between(1, 9))
    assert "LessThanOrEqual(length,9)" not in details_of(wider).split("(2)")[0].split("PushedFilters")[-1] and "content" not in details_of(wider)


def test_games_of_one_split_are_dealt(spark, tmp_path):
    """A table of one split gives games in many tasks, neighbours together and each game once."""
    from shelfwise.plans import views

    spark.range(5000).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    rows = views.games(spark, str(tmp_path)).select("game_ord", F.spark_partition_id().alias("task"))
    tasks = [r["n"] for r in rows.groupBy("task").agg(F.count("*").alias("n")).collect()]
    assert len(tasks) > 4 and max(tasks) < 2500 and sum(tasks) == 5000
    assert rows.groupBy((F.col("game_ord") / 256).cast("int")).agg(F.count_distinct("task").alias("n")).where("n > 1").isEmpty()


def test_ranks_by_ranges_work_on_games_once(spark, tmp_path):
    """The sort's sample and the sort itself read written rows: what makes the games runs once a row."""
    from shelfwise.operators.ranking import rank_by_ranges
    from shelfwise.plans import views

    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(k):
        seen.add(1)
        return k

    spark.range(1000).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    games = derive(views.games(spark, str(tmp_path))).withColumn("made", counted("game_ord"))
    assert rank_by_ranges(games, Preference(regions=("USA",))).agg(F.sum("made"), F.count("rank")).first()[:] == (499500, 1000)
    assert seen.value == 1000
