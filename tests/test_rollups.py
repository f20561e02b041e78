"""Stored roll-ups: after any loads each view equals a recomputation over their lines."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import make_star, sale
from pyspark.sql import functions as F

from tillstar.operators import order_sets as O
from tillstar.plans import analytics as A
from tillstar.plans.rollups import RollupStore
from tillstar.star import Star

VIEWS = {
    "kpi": (lambda r, s: r.kpi_overview(), A.kpi_overview),
    "category": (lambda r, s: r.category_performance(s), A.category_performance),
    "channel": (lambda r, s: r.channel_performance(), A.channel_performance),
    "region": (lambda r, s: r.region_performance(s), A.region_performance),
    "trends": (lambda r, s: r.monthly_revenue_trends(), A.monthly_revenue_trends),
    "trends_2019": (lambda r, s: r.monthly_revenue_trends(2019), lambda s: A.monthly_revenue_trends(s, 2019)),
    "products": (lambda r, s: r.top_selling_products(s, 3), lambda s: A.top_selling_products(s, 3)),
    "customers": (lambda r, s: r.top_customers(s, 3), lambda s: A.top_customers(s, 3)),
}


def rows(df):
    return [tuple(r) for r in df.collect()]


def sales(n, seed=1):
    """Lines of shared orders, over two years; some without order, customer, channel or measure."""
    rnd = random.Random(seed)
    out = []
    for i in range(1, n + 1):
        out.append(sale(i, customer_sk=rnd.choice([1, 1, 2, 3, 4, None, 99]), product_sk=rnd.choice([1, 2, 3, 4, 5, 77]), store_sk=rnd.randrange(1, 5),
                        when=dt.datetime(2018, 1, 1) + dt.timedelta(hours=rnd.randrange(24 * 700)), order_id=rnd.choice([None] + [f"o{rnd.randrange(n // 2)}"] * 9),
                        quantity=rnd.randrange(1, 9), net=rnd.randrange(-50, 900), profit=rnd.randrange(-90, 90), discount_pct=rnd.randrange(30),
                        channel=rnd.choice(["Web", "Store", "App", None]), returned=rnd.random() < 0.2))
    return out


@pytest.fixture(scope="module")
def star(spark):
    return make_star(spark, sales(240))


@pytest.fixture(scope="module")
def store(spark, star, tmp_path_factory):
    """Loads by key, so that orders have lines in several of them."""
    base = str(tmp_path_factory.mktemp("rollups") / "r")
    old, O.FEW = O.FEW, 3   # lists and bitmaps both occur
    r = RollupStore(spark, base)
    assert r.loads() == []
    for k in range(3):
        assert r.add(f"day{k}", star.fact.where(F.col("sale_sk") % 3 == k), star.time)
    assert r.add("empty", star.fact.limit(0), star.time)
    O.FEW = old
    return r


@pytest.mark.parametrize("view", VIEWS)
def test_views_equal_a_recomputation(star, store, view):
    stored, computed = VIEWS[view]
    assert rows(stored(store, star)) == rows(computed(star))


@pytest.mark.parametrize("view", ["kpi", "channel", "trends", "products"])
def test_views_as_of_an_earlier_load(spark, star, store, view):
    stored, computed = VIEWS[view]
    then = Star(star.fact.where("sale_sk % 3 < 2"), star.customers, star.products, star.stores, star.time)
    got, want = stored(RollupStore(spark, store.base, "day1"), then), computed(then)
    assert got.columns == want.columns and rows(got) == rows(want)


def test_a_load_counts_once_and_a_failed_one_not_at_all(spark, star, store):
    before = rows(store.kpi_overview())
    assert not store.add("day1", star.fact, star.time)
    broken = star.fact.withColumn("net_revenue", F.raise_error(F.lit("bad line")).cast("decimal(12,2)"))
    with pytest.raises(Exception, match="bad line"):
        store.add("broken", broken, star.time)
    assert rows(store.kpi_overview()) == before and [n for n, _ in store.loads()] == ["day0", "day1", "day2", "empty"]


def test_empty_store(spark, star, tmp_path):
    r = RollupStore(spark, str(tmp_path / "r"))
    with pytest.raises(ValueError, match="no load"):
        r.kpi_overview()
    r.add("none", star.fact.limit(0), star.time)
    assert rows(r.kpi_overview()) == rows(A.kpi_overview(Star(star.fact.limit(0), star.customers, star.products, star.stores, star.time)))


def test_order_numbers_are_dense_and_continue(spark, star, store):
    numbers = store._read(store.loads(), "order_numbers")
    orders = star.fact.where("order_id is not null").select("order_id").distinct().count()
    assert rows(numbers.agg(F.count("order_no"), F.count_distinct("order_no"), F.min("order_no"), F.max("order_no"))) == [(orders, orders, 1, orders)]


def test_views_read_no_fact_and_move_no_row_per_order(spark, star, store):
    for view in ("kpi", "category", "channel", "region", "trends"):
        df = VIEWS[view][0](store, star)
        files = " ".join(df.inputFiles())
        assert "measures_" in files and "order_numbers" not in files
        plan = df._jdf.queryExecution().executedPlan().toString()
        for line in plan.splitlines():
            assert not ("Exchange" in line and ("position" in line or "order_id" in line or "order_no" in line)), line


def test_buckets_of_many_orders(spark):
    """Over several buckets of 32,768 numbers, with a key that has a third of all."""
    lines = spark.range(1, 100_001).select(F.col("id").alias("order_no"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000).alias("k"))
    twice = lines.unionByName(lines.where("order_no % 7 = 0"))
    want = {r.k: r.n for r in lines.groupBy("k").agg(F.count_distinct("order_no").alias("n")).collect()}
    sets = O.order_sets(twice, ["k"])
    assert {r.k: r.total_orders for r in O.count_orders_by_key(sets, ["k"]).collect()} == want
    assert {r.k: r.total_orders for r in O.count_orders(sets.unionByName(O.order_sets(lines, ["k"], few_keys=True)), ["k"]).collect()} == want
    assert rows(O.count_orders(sets, [])) == [(100_000,)]
    assert sets.where("size(few) > 256").isEmpty() and not sets.where("bits is not null").isEmpty()


def test_a_load_stores_its_lines_by_bucket_and_keeps_no_copy(spark, star, tmp_path, monkeypatch):
    kept, plain = [], type(star.fact).checkpoint
    monkeypatch.setattr(type(star.fact), "checkpoint", lambda self, *a, **k: kept.append(self.columns) or plain(self, *a, **k))
    r = RollupStore(spark, str(tmp_path / "r"))
    assert r.add("all", star.fact, star.time)
    assert not any("net_revenue" in c or "few" in c for c in kept)
    assert not list((tmp_path / "r").glob("load-*/numbered"))
    assert rows(r.kpi_overview()) == rows(A.kpi_overview(star))
