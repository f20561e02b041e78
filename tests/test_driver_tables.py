"""The conformed star over the driver tables, checked against DuckDB twins
(brute force over the same parquet files) at sf0.001, plus the entry."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as E
from tillstar_oracle.duckdb_oracle import all_sql

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6)
    return v


def as_rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query_matches_duckdb(spark, duck, name):
    sdf = E.queries()[name](spark, SF)
    s_rows = as_rows(sdf.columns, [tuple(r) for r in sdf.collect()])
    cur = duck.execute(E.oracle_sql()[name])
    d_cols = [c[0] for c in cur.description]
    d_rows = as_rows(d_cols, cur.fetchall())
    assert sorted(sdf.columns) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert s_rows == d_rows


def test_every_query_has_an_oracle():
    assert set(E.warehouse_queries()) == set(all_sql())
    assert set(E.warehouse_queries()) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 10
    assert df.columns[:2] == ["product_sk", "product_name"]


@pytest.mark.parametrize("which", ["products", "customers"])
def test_every_key_of_the_top_n_queries(spark, duck, which):
    """N above the key count: every product's / customer's figures, favourites included."""
    from tillstar_oracle import duckdb_oracle as O
    from tillstar.functions.metrics import report_types
    from tillstar.plans import analytics as A
    from tillstar.plans.conform import star_from_dir

    n = 10**6
    star = star_from_dir(spark, SF)
    if which == "products":
        sdf, sql = A.top_selling_products(star, n), O.with_star(f"SELECT {O.Q6_COLS} FROM top_products", O.q6_cte(n))
    else:
        sdf, sql = A.top_customers(star, n), O.with_star(f"SELECT {O.Q8_COLS} FROM top_customers", O.q8_cte(n))
    sdf = report_types(sdf)
    cur = duck.execute(sql)
    d_rows = as_rows([c[0] for c in cur.description], cur.fetchall())
    s_rows = as_rows(sdf.columns, [tuple(r) for r in sdf.collect()])
    assert len(s_rows) > 100 and s_rows == d_rows


def test_totals_reconcile_on_driver_data(spark):
    from pyspark.sql import functions as F

    from tillstar.plans import analytics as A
    from tillstar.plans.conform import star_from_dir

    star = star_from_dir(spark, SF)
    kpi = A.kpi_overview(star).first()
    total = kpi["total_revenue"]
    assert sum(r["total_revenue"] for r in A.channel_performance(star).collect()) == total
    assert sum(r["total_revenue"] for r in A.region_performance(star).collect()) == total
    assert sum(r["total_revenue"] for r in A.monthly_revenue_trends(star).collect()) == total
    kept = star.fact.where(~F.col("return_flag")).agg(F.sum("net_revenue")).first()[0]
    assert sum(r["total_revenue"] for r in A.category_performance(star).collect()) == kept
    full = {(r["year"], r["month"]): r.asDict() for r in A.monthly_revenue_trends(star).collect()}
    year = A.monthly_revenue_trends(star, 1998).collect()
    assert year and all(r["year"] == 1998 for r in year)
    for i, r in enumerate(year):
        expect = dict(full[(r["year"], r["month"])])
        if i == 0:
            expect["mom_revenue_chg"] = None  # the filtered run starts without a previous month
        assert r.asDict() == expect
