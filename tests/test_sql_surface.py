"""The SQL surface returns what the DataFrame functions return."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from conftest import make_star, sale

from tillstar.functions import sql as S
from tillstar.plans import analytics as A
from tillstar.plans.conform import star_from_dir


def same(a, b):
    ra = sorted((tuple(r) for r in a.collect()), key=repr)
    rb = sorted((tuple(r) for r in b.collect()), key=repr)
    assert a.columns == b.columns
    assert ra == rb


@pytest.fixture(scope="module")
def star(spark):
    sales = [sale(i, product_sk=(i % 5) + 1, customer_sk=(i % 4) + 1, net=10 * i + (i % 3),
                  profit=i - 6, order_id=f"o{i // 2}", when=dt.datetime(2018 + i % 2, (i % 12) + 1, 3),
                  channel=["Web", "Phone", None][i % 3], returned=(i % 5 == 0))
             for i in range(1, 40)]
    s = make_star(spark, sales)
    S.install(s)
    return s


def test_views(spark, star):
    same(spark.table("vw_category_performance"), A.category_performance(star))
    same(spark.table("vw_channel_performance"), A.channel_performance(star))
    same(spark.table("vw_region_performance"), A.region_performance(star))


def test_table_functions_match_dataframe_functions(spark, star):
    same(S.query(spark, "SELECT * FROM get_top_selling_products(:n)", {"n": 3}), A.top_selling_products(star, 3))
    same(S.query(spark, "SELECT * FROM get_top_selling_products()"), A.top_selling_products(star))
    same(S.query(spark, "SELECT * FROM get_monthly_revenue_trends(:yr)", {"yr": None}),
         A.monthly_revenue_trends(star))
    same(S.query(spark, "SELECT * FROM get_monthly_revenue_trends(:yr)", {"yr": 2019}),
         A.monthly_revenue_trends(star, 2019))
    same(S.query(spark, "SELECT * FROM get_top_customers(:n)", {"n": 3}), A.top_customers(star, 3))
    assert S.status(spark).first()[0] == "Functions and views created successfully"


def test_table_functions_are_ordered(spark, star):
    """As consumed: in the order of the result, nothing sorted here."""
    for n in (1, 3, 2000):
        got = [r["product_sk"] for r in S.query(spark, "SELECT * FROM get_top_selling_products(:n)", {"n": n}).collect()]
        assert got == [r["product_sk"] for r in A.top_selling_products(star, n).collect()]
        got = [r["customer_sk"] for r in S.query(spark, "SELECT * FROM get_top_customers(:n)", {"n": n}).collect()]
        assert got == [r["customer_sk"] for r in A.top_customers(star, n).collect()]
    months = [(r["year"], r["month"]) for r in S.query(spark, "SELECT * FROM get_monthly_revenue_trends()").collect()]
    assert months == sorted(months) and len(months) > 5


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver data not present")
def test_table_functions_on_driver_star(spark):
    s = star_from_dir(spark, "/root/testdata/sf0.001")
    S.install(s)
    same(S.query(spark, "SELECT * FROM get_top_customers(:n)", {"n": 10}), A.top_customers(s, 10))
    same(S.query(spark, "SELECT * FROM get_monthly_revenue_trends(:yr)", {"yr": 1998}),
         A.monthly_revenue_trends(s, 1998))


def test_function_descriptions(spark, star):
    text = " ".join(r[0] for r in spark.sql("DESCRIBE FUNCTION EXTENDED get_top_selling_products").collect())
    assert "Best-selling products by net revenue" in text
    text = " ".join(r[0] for r in spark.sql("DESCRIBE FUNCTION EXTENDED get_monthly_revenue_trends").collect())
    assert "NULL keeps every year" in text


def test_persisted_star_gives_same_results(spark, star):
    kept = star.persist()
    try:
        same(A.top_customers(kept, 3), A.top_customers(star, 3))
        assert kept.fact.storageLevel.useMemory
    finally:
        kept.unpersist()
