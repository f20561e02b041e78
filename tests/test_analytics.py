"""Warehouse query semantics on tiny hand-made stars (one quirk per test)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from conftest import D, make_star, sale
from pyspark.sql import functions as F

from tillstar.plans import analytics as A


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_empty_fact_kpi_row_and_empty_groups(spark):
    star = make_star(spark, [])
    (k,) = rows(A.kpi_overview(star))
    assert k["total_revenue"] is None and k["total_profit"] is None
    assert k["total_orders"] == 0
    assert k["avg_order_value"] is None and k["total_returns"] is None
    assert A.category_performance(star).count() == 0
    assert A.channel_performance(star).count() == 0
    assert A.monthly_revenue_trends(star).count() == 0
    assert A.top_selling_products(star, 5).count() == 0
    assert A.top_customers(star, 5).count() == 0


def test_zero_revenue_product_has_zero_margin(spark):
    star = make_star(spark, [sale(1, product_sk=1, net=0, profit=-5)])
    (p,) = rows(A.top_selling_products(star, 10))
    assert p["profit_margin"] == Decimal("0.00")
    assert p["total_profit"] == Decimal("-5.00")
    (c,) = rows(A.category_performance(star))
    assert c["profit_margin_pct"] == Decimal("0.00")


def test_returns_excluded_from_products_and_categories_only(spark):
    star = make_star(spark, [
        sale(1, product_sk=1, net=100, profit=10, returned=True),
        sale(2, product_sk=1, net=50, profit=5),
    ])
    (p,) = rows(A.top_selling_products(star, 10))
    assert p["total_revenue"] == D("50.00") and p["total_orders"] == 1
    (c,) = rows(A.category_performance(star))
    assert c["total_revenue"] == D("50.00")
    (k,) = rows(A.kpi_overview(star))
    assert k["total_revenue"] == D("150.00") and k["total_returns"] == 1
    (ch,) = rows(A.channel_performance(star))
    assert ch["total_revenue"] == D("150.00") and ch["total_returns"] == 1
    (t,) = rows(A.monthly_revenue_trends(star))
    assert t["total_revenue"] == D("150.00") and t["total_returns"] == 1
    (cu,) = rows(A.top_customers(star, 10))
    assert cu["total_revenue"] == D("150.00") and cu["total_returns"] == 1


def test_multi_line_order(spark):
    star = make_star(spark, [
        sale(1, order_id="A", net=10, returned=True),
        sale(2, order_id="A", net=20, returned=True),
        sale(3, order_id="A", net=31),
    ])
    (k,) = rows(A.kpi_overview(star))
    assert k["total_orders"] == 1
    assert k["avg_order_value"] == D("20.33")  # per line, not per order
    (t,) = rows(A.monthly_revenue_trends(star))
    assert t["return_rate"] == D("200.00")  # returned lines / distinct orders


def test_month_over_month_uses_previous_present_month(spark):
    star = make_star(spark, [
        sale(1, when=dt.datetime(2018, 1, 10), net=100),
        sale(2, when=dt.datetime(2018, 3, 10), net=150),
    ])
    t = rows(A.monthly_revenue_trends(star))
    assert [(r["year"], r["month"]) for r in t] == [(2018, 1), (2018, 3)]
    assert t[0]["mom_revenue_chg"] is None
    assert t[1]["mom_revenue_chg"] == D("50.00")


def test_previous_month_zero_revenue_gives_null_change(spark):
    star = make_star(spark, [
        sale(1, when=dt.datetime(2018, 1, 10), net=100),
        sale(2, when=dt.datetime(2018, 2, 10), net=0, profit=0),
        sale(3, when=dt.datetime(2018, 3, 10), net=80),
    ])
    t = rows(A.monthly_revenue_trends(star))
    assert t[1]["mom_revenue_chg"] == D("-100.00")
    assert t[2]["mom_revenue_chg"] is None


def test_year_filter_applies_before_lag(spark):
    star = make_star(spark, [
        sale(1, when=dt.datetime(2018, 12, 10), net=100),
        sale(2, when=dt.datetime(2019, 1, 10), net=110),
        sale(3, when=dt.datetime(2019, 2, 10), net=121),
    ])
    full = rows(A.monthly_revenue_trends(star))
    assert full[1]["mom_revenue_chg"] == D("10.00")
    y = rows(A.monthly_revenue_trends(star, 2019))
    assert [r["month"] for r in y] == [1, 2]
    assert y[0]["mom_revenue_chg"] is None and y[1]["mom_revenue_chg"] == D("10.00")
    assert [r["year"] for r in rows(A.year_options(star))] == [2018, 2019, 2020]


def test_ties_smaller_key_and_earlier_name_win(spark):
    star = make_star(spark, [
        sale(1, product_sk=2, customer_sk=2, net=100, channel="Web"),
        sale(2, product_sk=1, customer_sk=1, net=100, channel="Web"),
        sale(3, product_sk=3, customer_sk=3, net=50, channel="Phone"),
        # customer 1: one line per channel (tie) -> 'Mobile' < 'Web'
        sale(4, product_sk=3, customer_sk=1, net=0, profit=0, channel="Mobile"),
    ])
    assert [r["product_sk"] for r in rows(A.top_selling_products(star, 2))] == [1, 2]
    top = rows(A.top_customers(star, 2))
    assert [r["customer_sk"] for r in top] == [1, 2]
    assert top[0]["favourite_channel"] == "Mobile"
    # categories: Cat0 (product 1) 100 vs Cat2 (product 3) 0 -> Cat0
    assert top[0]["favourite_category"] == "Cat0"


def test_null_channel_and_country_are_groups(spark):
    stores = [dict(store_sk=1, store_id="s1", store_name="S1", country=None, region="North"),
              dict(store_sk=2, store_id="s2", store_name="S2", country="US", region="North")]
    star = make_star(spark, [sale(1, channel=None, store_sk=1), sale(2, channel="Web", store_sk=2)],
                     stores=stores)
    ch = {r["sales_channel"]: r for r in rows(A.channel_performance(star))}
    assert set(ch) == {None, "Web"}
    reg = rows(A.region_performance(star))
    assert {(r["region"], r["country"]) for r in reg} == {("North", None), ("North", "US")}
    roll = rows(A.region_country_rollup(star))
    assert {(r["region"], r["country"], r["level"]) for r in roll} == {
        ("North", None, "country"), ("North", "US", "country"), ("North", None, "region")}


def test_half_way_rounding_is_away_from_zero(spark):
    # averages 0.125 and -0.125 -> 0.13 and -0.13
    star = make_star(spark, [
        sale(1, product_sk=1, net="0.12", profit="-0.12", order_id="a"),
        sale(2, product_sk=1, net="0.13", profit="-0.13", order_id="b"),
    ])
    (k,) = rows(A.kpi_overview(star))
    assert k["avg_order_value"] == D("0.13")
    from tillstar.functions.metrics import exact_avg

    (r,) = star.fact.agg(exact_avg("profit").alias("a")).collect()
    assert r["a"] == D("-0.13")


def test_loyalty_tiers_rank_order_and_avg_age(spark):
    customers = [
        dict(customer_sk=1, customer_id="1", first_name="a", last_name="b", email="1", age=20, loyalty_tier="Bronze"),
        dict(customer_sk=2, customer_id="2", first_name="a", last_name="b", email="2", age=31, loyalty_tier="Platinum"),
        dict(customer_sk=3, customer_id="3", first_name="a", last_name="b", email="3", age=30, loyalty_tier="Platinum"),
        dict(customer_sk=4, customer_id="4", first_name="a", last_name="b", email="4", age=40, loyalty_tier="Silver"),
        dict(customer_sk=5, customer_id="5", first_name="a", last_name="b", email="5", age=50, loyalty_tier=None),
    ]
    star = make_star(spark, [], customers=customers)
    out = rows(A.customers_by_loyalty_tier(star))
    assert [r["loyalty_tier"] for r in out] == ["Platinum", "Silver", "Bronze", None]
    assert out[0]["customer_count"] == 2 and out[0]["avg_age"] == D("30.5")


def test_result_rollups(spark):
    sales = [sale(i, product_sk=(i % 5) + 1, customer_sk=(i % 4) + 1, net=10 * i,
                  when=dt.datetime(2018, (i % 3) + 1, 5), channel=["Web", "Phone"][i % 2]) for i in range(1, 13)]
    star = make_star(spark, sales)
    (k,) = rows(A.kpi_overview(star))
    (tk,) = rows(A.trend_kpis(star))
    assert tk["total_revenue"] == k["total_revenue"]
    shares = rows(A.channel_share(star))
    assert abs(sum(r["share_pct"] for r in shares) - 100) <= D("0.02")
    cat = rows(A.top_products_category_share(star, 10))
    assert abs(sum(r["share_pct"] for r in cat) - 100) <= D("0.02")
    heat = A.revenue_heatmap(star)
    assert heat.columns == ["year", "January", "February", "March"]
    mom = rows(A.mom_series(star))
    assert [r["period"] for r in mom] == ["2018-02", "2018-03"]
    assert all(r["direction"] in ("up", "down") for r in mom)
    series = rows(A.monthly_series(star))
    assert [r["period"] for r in series] == ["2018-01", "2018-02", "2018-03"]
    assert A.customer_table(star, 3).columns[0] == "full_name"
    (pk,) = rows(A.top_products_kpis(star, 5))
    top5 = rows(A.top_selling_products(star, 5))
    assert pk["total_revenue"] == sum(r["total_revenue"] for r in top5)
    fav = rows(A.top_customers_favourite_categories(star, 4))
    assert sum(r["count"] for r in fav) == 4
    opts = rows(A.year_filter_options(star))
    assert opts[0] == {"label": "All Years", "year": None}


def test_category_totals_equal_non_returned_fact_total(spark):
    sales = [sale(i, product_sk=(i % 5) + 1, net=7 * i, returned=(i % 4 == 0)) for i in range(1, 30)]
    star = make_star(spark, sales)
    cats = rows(A.category_performance(star))
    kept = sum(D(7 * i) for i in range(1, 30) if i % 4 != 0)
    assert sum(r["total_revenue"] for r in cats) == kept
    assert sum(r["unique_products"] for r in cats) == 5


def test_hot_customer_holding_a_third_of_rows(spark):
    # one customer, one product and one order hold a third of all lines
    hot = [sale(i, customer_sk=1, product_sk=1, order_id="hot", net=1, profit=0, channel="Web") for i in range(1, 41)]
    rest = [sale(100 + i, customer_sk=2 + i % 3, product_sk=2 + i % 4, net=2, profit=1,
                 channel=["Web", "Phone"][i % 2]) for i in range(80)]
    star = make_star(spark, hot + rest)
    top = rows(A.top_customers(star, 4))
    by_sk = {r["customer_sk"]: r for r in top}
    assert by_sk[1]["total_orders"] == 1 and by_sk[1]["total_quantity"] == 40
    assert by_sk[1]["favourite_channel"] == "Web" and by_sk[1]["favourite_category"] == "Cat0"
    (k,) = rows(A.kpi_overview(star))
    assert k["total_orders"] == 81 and k["total_revenue"] == D("200.00")
    cats = rows(A.category_performance(star))
    assert sum(r["total_revenue"] for r in cats) == D("200.00")


def test_best_products_are_found_without_their_orders(spark, monkeypatch):
    star = make_star(spark, [sale(1, product_sk=1, order_id="a"), sale(2, product_sk=1, order_id="a"), sale(3, product_sk=1, order_id=None), sale(4, product_sk=2, net=5)])
    ranked = []
    plain = A.top_n
    monkeypatch.setattr(A, "top_n", lambda df, n, order: ranked.append(df) or plain(df, n, order))
    got = A.top_selling_products(star, 2).collect()
    assert "total_orders" not in ranked[0].columns
    want = {r.k: r.n for r in star.fact.groupBy(F.col("product_sk").alias("k")).agg(F.count_distinct("order_id").alias("n")).collect()}
    assert {r.product_sk: r.total_orders for r in got} == {k: want[k] for k in (1, 2)}


def test_region_orders_of_many_countries(spark):
    """Over several words of 64 places; an order with lines in two places, a place without a name."""
    stores = [dict(store_sk=i, store_id=f"s{i}", store_name="S", country=f"c{i}" if i < 150 else None, region="N") for i in range(1, 151)]
    lines = [sale(i, store_sk=(i - 1) % 150 + 1, order_id=f"o{i % 77}") for i in range(1, 400)] + [sale(400, store_sk=1, order_id="many") for _ in range(3)]
    star = make_star(spark, lines, stores=stores)
    df = A.region_performance(star)
    joined = star.fact.join(star.stores, "store_sk").groupBy("country").agg(F.count_distinct("order_id").alias("n"))
    assert {r.country: r.total_orders for r in df.collect()} == {r.country: r.n for r in joined.collect()}
    assert "bit_or" in df._jdf.queryExecution().optimizedPlan().toString()
