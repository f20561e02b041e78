from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from tillstar.operators.joins import gathered, keep_existing, pin_small
from tillstar.operators.ranking import change_pct_vs_previous, first_per_group, top_n


def test_top_n_with_tie_break(spark):
    df = spark.createDataFrame([(3, 10), (1, 10), (2, 5), (4, None)], "k int, v int")
    out = top_n(df, 3, [F.col("v").desc_nulls_first(), F.col("k")])
    assert [r["k"] for r in out.collect()] == [4, 1, 3]
    assert "TakeOrderedAndProject" in out._jdf.queryExecution().executedPlan().toString()


def test_first_per_group_is_distinct_on(spark):
    df = spark.createDataFrame(
        [(1, "b", 5), (1, "a", 5), (1, "c", 3), (2, "z", 1), (2, None, 1)], "k int, name string, m int")
    out = first_per_group(df, ["k"], "name", [-F.col("m"), F.col("name")], "best")
    got = {r["k"]: r["best"] for r in out.collect()}
    assert got == {1: "a", 2: None}  # ties -> name ascending, NULL first


def test_change_vs_previous_row(spark):
    df = spark.createDataFrame([(1, Decimal("100")), (2, Decimal("0")), (3, Decimal("50")), (4, Decimal("75"))],
                               "m int, v decimal(12,2)")
    out = df.select("m", change_pct_vs_previous("v", ["m"]).alias("chg")).orderBy("m").collect()
    assert [r["chg"] for r in out] == [None, Decimal("-100.00"), None, Decimal("50.00")]


def test_keep_existing_is_inner_semantics_without_duplicates(spark):
    stats = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "k int, s int")
    dim = spark.createDataFrame([(1,), (1,), (3,)], "k int")  # duplicate key in the dimension
    assert sorted(tuple(r) for r in keep_existing(stats, dim, "k").collect()) == [(1, 10), (3, 30)]


def test_pin_small_cuts_lineage(spark):
    df = spark.range(100).groupBy((F.col("id") % 3).alias("g")).count()
    pinned = pin_small(df)
    assert sorted(tuple(r) for r in pinned.collect()) == [(0, 34), (1, 33), (2, 33)]
    assert "Exchange" not in pinned._jdf.queryExecution().executedPlan().toString()


def test_sorted_by_nulls_last(spark):
    from tillstar.operators.ranking import sorted_by

    df = spark.createDataFrame([(1, 5), (2, None), (3, 7), (4, 5)], "k int, v int")
    assert [r["k"] for r in sorted_by(df, "v").collect()] == [1, 4, 3, 2]
    assert [r["k"] for r in sorted_by(df, "v", ascending=False).collect()] == [3, 1, 4, 2]


def test_pinned_rows_keep_their_size_for_the_planner(spark):
    """Few pinned rows are broadcast and many are not, without hints."""
    def plan(n):
        big = spark.range(0, 100_000).selectExpr("id AS k", "repeat('x', 100) AS pad")
        top = pin_small(top_n(big, n, [F.col("k")]))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
        try:
            joined = spark.range(0, 1_000_000).selectExpr("id AS k").join(top, "k")
            return joined._jdf.queryExecution().sparkPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    assert "BroadcastHashJoin" in plan(10)
    assert "BroadcastHashJoin" not in plan(50_000)


def test_checkpoint_folder_is_required_off_local(spark, monkeypatch):
    import pytest

    from tillstar import session

    class Context:
        def __init__(self, current):
            self.current = current

        def getCheckpointDir(self):
            return self.current

        def setCheckpointDir(self, path):
            self.current = path

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        def __init__(self, **conf):
            self.conf, self.sparkContext = Conf({k.replace("_", "."): v for k, v in conf.items()}), Context(None)

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.ensure_checkpoint_dir(Session(spark_master=master))
        assert session.ensure_checkpoint_dir(Session(spark_master=master, spark_checkpoint_dir="hdfs:///x")) == "hdfs:///x"
    assert session.ensure_checkpoint_dir(Session(spark_master="local[2]")).startswith("/")


def test_spread_join_as_the_plain_join(spark):
    from tillstar.operators.joins import spread_join

    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 400)).alias("k"),
        "id", F.lit(1).alias("__salt"))
    dim = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("k5", "c"), ("other", "d"), (None, "e")] + [(f"k{i}", "x") for i in range(100, 200)], "k string, name string")
    for how in ("inner", "left"):
        got, want = spread_join(rows, dim, "k", how, tasks=4), rows.join(dim, "k", how)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    empty = spread_join(rows.limit(0), dim, "k", "left", tasks=4)
    assert empty.count() == 0 and spread_join(rows, dim.limit(0), "k", tasks=4).count() == 0


def test_hot_key_makes_no_task_without_adaptive_execution(spark):
    """A third of all rows has one key: no task has over twice the median."""
    from tillstar.operators.joins import spread_join

    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for k, v in zip(old, ("false", "-1", "6")):
        spark.conf.set(k, v)
    try:
        rows = spark.range(120_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5000).cast("long").alias("k"), "id")
        dim = spark.range(5000).select(F.col("id").alias("k"), F.lit("d").alias("name"))

        def sizes(df):
            assert "SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString()
            return sorted(r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())

        plain, spread = sizes(rows.join(dim, "k").select("id")), sizes(spread_join(rows, dim, "k").select("id"))
        assert sum(plain) == sum(spread) == 120_000
        assert plain[-1] > 2 * plain[len(plain) // 2]
        assert len(spread) == 6 and spread[-1] <= 2 * spread[3]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_spread_join_runs_the_plan_of_its_rows_once(spark):
    from tillstar.operators.joins import spread_join

    rows = spark.range(50).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    out = spread_join(rows, spark.range(3).withColumnRenamed("id", "k"), "k")
    assert out.count() == 50 and any("/spread-" in f for f in out.inputFiles())


def test_gathered_rows_of_a_key_meet_and_a_hot_key_is_split(spark):
    df = spark.range(0, 40_000, 1, 8).select((F.col("id") % 500).alias("k"), F.col("id").alias("v"))
    places = gathered(df, "k").select("k", F.spark_partition_id().alias("p")).distinct()
    assert places.count() == 500 and df.select("k", F.spark_partition_id().alias("p")).distinct().count() == 4000
    hot = spark.range(0, 200_000, 1, 8).select(F.when(F.col("id") % 4 > 0, 1).when(F.col("id") % 8 > 0, F.col("id")).alias("k"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    try:
        parts = gathered(hot, "k").select("k", "v", F.spark_partition_id().alias("p")).groupBy("k", "p").agg(F.max("v")).where("k = 1")
        assert parts.count() > 1
        sums = lambda rows: sorted(map(tuple, rows.groupBy("k").agg(F.sum("v"), F.count("v")).collect()), key=str)
        assert sums(gathered(hot, "k")) == sums(hot)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
