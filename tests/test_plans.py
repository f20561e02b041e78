"""Plan-shape checks: the properties the queries rely on at scale."""

from __future__ import annotations

import os
import re
import tempfile

import pytest

from tillstar.plans import analytics as A
from tillstar.plans.conform import star_from_dir
from tillstar.sources.parquet_store import read_star, write_star

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def stored(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")  # untruncated scan details
    root = tempfile.mkdtemp(prefix="tillstar-plans-")
    write_star(star_from_dir(spark, SF), root, fact_partitions=4)
    return read_star(spark, root)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def fact_scans(df) -> list[str]:
    """Formatted-explain blocks of the fact table's parquet scans."""
    jvm = df.sparkSession._jvm
    text = jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    blocks = text.split("\n\n")
    return [b for b in blocks if b.lstrip().startswith("(") and "Scan parquet" in b and "fact_sales" in b]


def test_fact_scan_is_pruned_and_filter_pushed(stored):
    # (top products ranks in a pinned job; its top-N operator is tested in test_operators)
    q = A.category_performance(stored)
    scans = fact_scans(q)
    assert scans
    for scan in scans:
        schema = re.search(r"ReadSchema: struct<(.*?)>\n", scan + "\n").group(1)
        assert "customer_sk" not in schema and "store_sk" not in schema and "tax_amount" not in schema
        pushed = re.search(r"PushedFilters: \[(.*)\]", scan).group(1)
        assert "EqualTo(return_flag" in pushed


def test_year_filter_reaches_parquet(stored):
    scans = fact_scans(A.monthly_revenue_trends(stored, 1998))
    assert any("GreaterThanOrEqual(time_sk" in s and "LessThanOrEqual(time_sk" in s for s in scans)


def test_dimension_check_stays_above_aggregate(spark):
    from pyspark.sql import functions as F

    from tillstar.operators.joins import keep_existing

    fact = spark.range(1000).selectExpr("id % 10 AS k", "id AS v")
    dim = spark.range(5).selectExpr("id AS k")
    stats = fact.groupBy("k").agg(F.sum("v").alias("s"))

    def order(df, join_kind):
        lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        join = next(i for i, line in enumerate(lines) if f"Join {join_kind}" in line)
        agg = next(i for i, line in enumerate(lines) if "Aggregate" in line and "sum(v" in line)
        return join, agg

    # keep_existing: the join sits above (printed before) the fact aggregate
    join, agg = order(keep_existing(stats, dim, "k"), "Inner")
    assert join < agg
    # a plain semi join is pushed below the aggregate -- the plan keep_existing avoids
    join, agg = order(stats.join(dim, "k", "left_semi"), "LeftSemi")
    assert agg < join


def test_no_python_in_plans(stored):
    for q in (A.kpi_overview(stored), A.category_performance(stored), A.channel_performance(stored),
              A.region_performance(stored), A.top_customers(stored, 10), A.monthly_revenue_trends(stored)):
        p = plan(q)
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "FlatMapGroupsInPandas" not in p


def test_no_hints_and_no_single_task_sort_of_all_keys(stored, spark):
    """Top-N of any size: no broadcast hint of N rows; the SQL functions rank within buckets first."""
    from tillstar.functions import sql as S

    S.install(stored)
    for text in ("SELECT * FROM get_top_selling_products(2000)", "SELECT * FROM get_top_customers(2000)"):
        analyzed = spark.sql(text)._jdf.queryExecution().analyzed().toString()
        assert "UnresolvedHint" not in analyzed and "ResolvedHint" not in analyzed
        p = plan(spark.sql(text))
        single = [block for block in p.split("Exchange SinglePartition")[1:]]
        assert single and all("place" in block.split("Exchange", 1)[0] for block in single)
    for df in (A.top_selling_products(stored, 2000), A.top_customers(stored, 2000)):
        assert "ResolvedHint" not in df._jdf.queryExecution().analyzed().toString()


def test_region_query_does_not_expand_rows(stored):
    assert "Expand" not in plan(A.region_performance(stored))


def test_quality_report_plan(stored, monkeypatch):
    """One scan of each table and one exchange for all rules; a clean star needs no second pass."""
    from tillstar.plans import quality

    seen = []
    monkeypatch.setattr(quality, "pin_small", lambda df: seen.append(plan(df)) or df.checkpoint(eager=True))
    report = quality.quality_report(stored)
    assert len(seen) == 1
    scans = [line for line in seen[0].splitlines() if "FileScan parquet" in line]
    assert len(scans) == 5 and seen[0].count("Exchange ") == 1 and "Join" not in seen[0] and "Expand" not in seen[0]
    assert "FileScan" not in plan(report)


def test_products_are_ranked_on_their_revenue_alone(stored, monkeypatch):
    """A task that merges the products keeps the ranked measure of each; the other measures are the n best's."""
    ranked, plain = [], A.top_n
    monkeypatch.setattr(A, "top_n", lambda df, n, order: ranked.append(df) or plain(df, n, order))
    got = A.top_selling_products(stored, 5).collect()
    assert ranked[0].columns == ["product_sk", "total_revenue"] and "sum(profit" not in plan(ranked[0])
    lines = [r for r in stored.fact.collect() if not r["return_flag"]]
    for r in got:
        mine = [x for x in lines if x["product_sk"] == r["product_sk"]]
        assert r["total_orders"] == len({x["order_id"] for x in mine}) and r["total_quantity"] == sum(x["quantity"] for x in mine)
        assert (r["total_revenue"], r["total_cost"], r["total_profit"]) == tuple(sum(x[c] for x in mine) for c in ("net_revenue", "total_cost", "profit"))


def test_sums_by_product_hold_a_task_s_own_products(stored, spark, monkeypatch):
    """Lines are shuffled by product below the partial sums, which are merged above (a hot product may be split)."""
    from tillstar.functions import sql as S

    ranked, plain = [], A.top_n
    monkeypatch.setattr(A, "top_n", lambda df, n, order: ranked.append(df) or plain(df, n, order))
    A.top_selling_products(stored, 5)
    S.install(stored)
    for df in (ranked[0], A.category_performance(stored), spark.sql("SELECT * FROM get_top_selling_products(5)")):
        p = plan(df)
        (at,) = [i for i, line in enumerate(p.splitlines()) if "REBALANCE_PARTITIONS_BY_COL" in line]
        above = "\n".join(p.splitlines()[:at])
        assert "partial_sum(net_revenue" in above and "Exchange hashpartitioning(product_sk" in above


def test_lines_are_not_sorted_to_join_their_orders(spark):
    """The orders of a task make a hash table; a sort would hold the task's lines, however wide, in memory."""
    from pyspark.sql import functions as F

    star = star_from_dir(spark, SF)
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")
    try:
        p = plan(star.fact)
        assert "ShuffledHashJoin [l_orderkey" in p and "Sort [l_orderkey" not in p
        assert "Sort [l_orderkey" not in plan(A.region_performance(star))
    finally:
        spark.conf.unset(key)
    assert star.fact.agg(F.count("customer_sk")).first()[0] == spark.read.parquet(f"{SF}/lineitem.parquet").count()


@pytest.mark.parametrize("query", ["kpi_overview", "channel_performance", "top_customers"])
def test_hot_order_is_split(spark, query, tmp_path):
    """A third of all lines in one order: AQE splits that partition of the conform join."""
    import shutil

    from pyspark.sql import functions as F

    for name in os.listdir(SF):
        if not name.startswith("lineitem"):
            shutil.copy(os.path.join(SF, name), tmp_path / name)
    li = spark.read.parquet(f"{SF}/lineitem.parquet").repartition(8)
    hot = li.withColumn("l_orderkey", F.when(F.col("l_linenumber") <= 2, F.lit(1).cast("long")).otherwise(F.col("l_orderkey")))
    hot.write.parquet(str(tmp_path / "lineitem.parquet"))
    low = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
           "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
           "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in low.items():
        spark.conf.set(k, v)
    try:
        seen = []
        star = star_from_dir(spark, str(tmp_path))
        df = star.fact.groupBy("customer_sk").agg(F.sum("net_revenue")) if query == "top_customers" else getattr(A, query)(star)
        df.collect()
        seen.append(plan(df))
        assert any("skew=true" in p for p in seen)
    finally:
        for k in low:
            spark.conf.unset(k)
