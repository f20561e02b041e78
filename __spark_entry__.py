"""


Every query builds the star from the driver tables in ``sf_dir`` (lazily,
over whole tables) and returns the library's result with DECIMAL columns
shown as DOUBLE (``report_types``); the DuckDB twins live in
``tillstar_oracle/duckdb_oracle.py``.
"""

from __future__ import annotations

import importlib
import importlib.util
import os
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from tillstar_oracle import duckdb_oracle  # noqa: E402
from tillstar.functions import formatting as T  # noqa: E402
from tillstar.functions import sql as S  # noqa: E402
from tillstar.functions.metrics import report_types  # noqa: E402
from tillstar.operators.joins import spread_join, stored  # noqa: E402
from tillstar.operators.ranking import sorted_by  # noqa: E402
from tillstar.plans import keys as K  # noqa: E402
from tillstar.plans.append import AppendWarehouse  # noqa: E402
from tillstar.plans.calendar import easter_sunday, holiday_name, hour_keys_of_year, with_computed_holidays, with_holidays  # noqa: E402
from tillstar.plans.load import key_high_water_marks  # noqa: E402
from tillstar.plans.rollups import FACT_COLUMNS, RollupStore  # noqa: E402
from tillstar.schema import STAR_TABLES  # noqa: E402
from tillstar.session import scratch_path, shuffles_freed  # noqa: E402
from tillstar.sources.csv_files import read_star_csv, read_table_csv, with_defaults, write_star_csv, write_table_csv  # noqa: E402
from tillstar.star import Star  # noqa: E402
from tillstar.plans import analytics as A  # noqa: E402
from tillstar.plans import quality as Q  # noqa: E402
from tillstar.plans.conform import star_from_dir  # noqa: E402

FLAGSHIP_SF_DIR = "/root/testdata/sf0.001"
TOP_N = 10
TREND_YEAR = 1998


def _star_query(fn: Callable, **params) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report_types(fn(star_from_dir(spark, sf_dir), **params))

    run.__name__ = fn.__name__
    return run


def _calendar(star):
    # dates as ISO text, as in the calendar load file
    t = star.time.drop("created_at")
    return t.withColumn("full_date", F.date_format("full_date", "yyyy-MM-dd"))


def _year_filter_options(star):
    # the NULL year ("All Years") is shown as DOUBLE, like the decimals: an
    # integer column with NULLs converts differently per engine (float / Int32)
    return A.year_filter_options(star).withColumn("year", F.col("year").cast("double"))


def _sales_fact(star):
    return star.fact.drop("sale_sk", "created_at")


# conformed dimensions: the columns the driver tables feed (the rest are
# NULL / TRUE defaults with no source)
def _dim_customers(star):
    return star.customers.select("customer_sk", "customer_id", "first_name", "last_name", "email",
                                 "country", "age", "loyalty_tier", "is_active")


def _dim_products(star):
    return star.products.select("product_sk", "product_id", "product_name", "category", "sub_category",
                                "brand", "unit_cost", "unit_price", "is_active")


def _dim_stores(star):
    return star.stores.select("store_sk", "store_id", "store_name", "country", "region", "is_active")


# A star with broken constraints, for the quality report: (column, rows, value).
DAMAGE = {
    "fact": [
        ("sale_sk", "order_id % 47 = 0", "-1L"), ("customer_sk", "order_id % 11 = 0", "NULL"),
        ("customer_sk", "order_id % 13 = 0", "customer_sk + 1000000000"), ("product_sk", "order_id % 17 = 0", "product_sk + 1000000000"),
        ("store_sk", "order_id % 19 = 0", "store_sk + 1000000000"), ("time_sk", "order_id % 23 = 0", "-1"),
        ("quantity", "order_id % 7 = 0", "0"), ("discount_pct", "order_id % 29 = 0", "200"),
        ("payment_method", "order_id % 31 = 0", "repeat('x', 31)"), ("return_flag", "order_id % 37 = 0", "NULL"),
        ("profit", "order_id % 41 = 0", "NULL"), ("net_revenue", "order_id % 43 = 0", "cast(99999999999 as decimal(16,2))")],
    "customers": [
        ("customer_sk", "customer_sk % 97 = 0", "1L"), ("customer_id", "customer_sk % 5 = 0", "'0'"), ("email", "customer_sk % 7 = 0", "'same'"),
        ("first_name", "customer_sk % 11 = 0", "NULL"), ("last_name", "customer_sk % 13 = 0", "repeat('x', 81)"),
        ("age", "customer_sk % 17 = 0", "10"), ("loyalty_tier", "customer_sk % 19 = 0", "'Tin'"), ("gender", "customer_sk % 23 = 0", "'X'")],
    "products": [
        ("product_sk", "product_sk % 97 = 0", "1L"), ("product_id", "product_sk % 17 = 0", "'0'"),
        ("product_name", "product_sk % 5 = 0", "repeat('x', 201)"), ("unit_cost", "product_sk % 7 = 0", "-1"),
        ("unit_price", "product_sk % 11 = 0", "NULL"), ("category", "product_sk % 13 = 0", "NULL"),
        ("weight_kg", "product_sk % 19 = 0", "cast(99999999 as decimal(12,2))")],
    "stores": [
        ("store_sk", "store_sk % 29 = 0", "1L"), ("store_id", "store_sk % 11 = 0", "'0'"), ("store_type", "store_sk % 3 = 0", "'Kiosk'"),
        ("sq_footage", "store_sk % 5 = 0", "0"), ("region", "store_sk % 7 = 0", "repeat('x', 21)"),
        ("manager_name", "store_sk % 13 = 0", "repeat('x', 121)")],
    "time": [
        ("time_sk", "time_sk % 1033 = 0", "-7"), ("month", "time_sk % 1009 = 0", "13"), ("hour", "time_sk % 1013 = 0", "24"),
        ("week", "time_sk % 1019 = 0", "0"), ("month_name", "time_sk % 1021 = 0", "'Abcdefghijklm'"), ("year", "time_sk % 1031 = 0", "NULL")],
}


def _damaged(star: Star) -> Star:
    def broken(df: DataFrame, changes) -> DataFrame:
        case: dict[str, str] = {}
        for column, rows, value in changes:
            case[column] = case.get(column, "") + f" WHEN {rows} THEN {value}"
        return df.withColumns({c: F.expr(f"CASE{w} ELSE {c} END") for c, w in case.items()})

    return Star(**{name: broken(getattr(star, name), changes) for name, changes in DAMAGE.items()})


def _sql_query(text: str, **params) -> Callable[[SparkSession, str], DataFrame]:
    """A query of the SQL surface: the star's views and table functions, bound parameters."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        S.install(star_from_dir(spark, sf_dir))
        return report_types(S.query(spark, text, params))

    return run


def _csv_round_trip(star: Star) -> DataFrame:
    """Products with blanks, line breaks, quotes, empty and NULL text through the CSV sink and source."""
    name, key = F.col("product_name"), F.col("product_sk")
    odd = star.products.withColumn("product_name", F.when(key % 5 == 0, F.concat(F.lit("  "), name, F.lit("  "))).when(
        key % 5 == 1, F.concat(name, F.lit('\n"quoted", line'))).otherwise(name))
    odd = odd.withColumn("sub_category", F.when(key % 3 == 0, F.lit("")).when(key % 3 == 1, F.lit(None)).otherwise(F.col("sub_category")))
    path = scratch_path(odd.sparkSession, "products-csv")
    write_table_csv(odd, path, "dim_products")
    back = read_table_csv(odd.sparkSession, path, STAR_TABLES["dim_products"], multi_line=True)
    return back.select("product_sk", "product_id", "product_name", "category", "sub_category", "brand", "unit_cost", "unit_price", "is_active")


def _holiday_calendar(star: Star) -> DataFrame:
    days = with_computed_holidays(star.time)
    return days.select("time_sk", "is_holiday", holiday_name(F.col("full_date")).alias("holiday"))


def _easter(star: Star) -> DataFrame:
    """Easter of each year in the three centuries around those of the calendar."""
    span = star.time.agg(F.min("year").cast("int").alias("lo"), F.max("year").cast("int").alias("hi"))
    years = span.select(F.explode(F.sequence(F.col("lo") - 150, F.col("hi") + 150)).alias("year"))
    return years.select("year", F.date_format(easter_sunday(F.col("year")), "yyyy-MM-dd").alias("easter"))


def _listed_holidays(star: Star) -> DataFrame:
    """Holidays from a list of dates: the days on which no order at all was placed."""
    open_days = star.fact.select("time_sk").distinct().join(star.time.select("time_sk", "full_date"), "time_sk").select("full_date").distinct()
    closed = star.time.select("full_date").distinct().join(open_days, "full_date", "left_anti")
    return with_holidays(star.time, closed, "full_date").select("time_sk", "is_holiday")


def _key_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count("k").alias("n"), F.min("k").alias("lowest"), F.max("k").alias("highest"),
                  F.count_distinct("k").alias("distinct_keys"))


def _dense_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key_summary(K.dense_keys(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_name"), "k"))


def _continued_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))
    return _key_summary(K.continue_keys(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_name"), known, "k"))


def _formatted_products(star: Star) -> DataFrame:
    return A.top_selling_products(star, A.TOP_N_MAX).select(
        "product_sk", T.money("total_revenue").alias("total_revenue"), T.percent("profit_margin").alias("profit_margin"),
        T.thousands("total_quantity").alias("total_quantity"), T.signed_percent("profit_margin").alias("signed_margin"))


def _formatted_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    seconds = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long") * 86400
    rows = orders.join(customer, F.col("c_custkey") == F.col("o_custkey"))
    return rows.select("o_orderkey", T.epoch_date_text(seconds).alias("day"), T.composed_name("c_name", "c_mktsegment").alias("who"))


def _restricted_deletes(star: Star) -> DataFrame:
    """Every product is to go; those with returned sales have to stay."""
    plan = star.products.select("product_sk")
    blocked, free = Q.restricted_deletes(star.fact.where("return_flag"), plan, "product_sk")
    return blocked.withColumn("blocked", F.lit(True)).unionByName(free.withColumn("blocked", F.lit(False)))


_ROLLUPS: dict = {}
ROLLUP_LOADS = ("history", "recent", "late")


def _load_of() -> Column:
    """Three loads of the fact: lines kept of the years before 1996, the lines from then on, and the
    returned lines of the earlier orders, which come late."""
    early = F.coalesce(F.col("time_sk") < hour_keys_of_year(1996)[0], F.lit(False))
    late = early & F.coalesce(F.col("return_flag"), F.lit(False))
    return F.when(late, F.lit("late")).when(early, F.lit("history")).otherwise(F.lit("recent"))


def _rollups(spark: SparkSession, sf_dir: str, star: Star) -> RollupStore:
    """The roll-ups after the three loads; made once for a session and folder of tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _ROLLUPS and len(_ROLLUPS[key].loads()) == len(ROLLUP_LOADS):
        return _ROLLUPS[key]
    store = RollupStore(spark, scratch_path(spark, "rollups"))
    fact = stored(star.fact.select(*FACT_COLUMNS), "fact")  # joined once for the three loads
    for name in ROLLUP_LOADS:
        store.add(name, fact.where(_load_of() == name), star.time)
    _ROLLUPS[key] = store
    return store


def _rollup_query(view: Callable[[RollupStore, Star], DataFrame], as_of: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        star = star_from_dir(spark, sf_dir)
        store = _rollups(spark, sf_dir, star)
        return report_types(view(RollupStore(spark, store.base, as_of), star))

    return run


_APPENDED: dict = {}


def _appended(spark: SparkSession, sf_dir: str) -> AppendWarehouse:
    """Three loads: the "history" lines, all lines but the late ones (so history again), then all; dimensions
    with each.  Made once for a session and folder of tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _APPENDED and len(_APPENDED[key].versions()) == 3:
        return _APPENDED[key]
    star = star_from_dir(spark, sf_dir)
    warehouse = AppendWarehouse(spark, scratch_path(spark, "appended"))
    with shuffles_freed(spark), warehouse.staged(star.fact.drop("sale_sk"), "fact_sales") as fact:  # numbered by the loads
        for lines in (fact.where(_load_of() == "history"), fact.where(_load_of() != "late"), fact):
            warehouse.append(Star(lines, star.customers, star.products, star.stores, star.time), stored=("fact",))
    _APPENDED[key] = warehouse
    return warehouse


def _append_query(result: Callable[[AppendWarehouse], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: report_types(result(_appended(spark, sf_dir)))


def _dense_sales(star: Star) -> DataFrame:
    return _key_summary(star.fact.select(F.col("sale_sk").alias("k")))


def _csv_split_round_trip(star: Star) -> DataFrame:
    """The round trip with ranges of 64 KB, so that files are cut at many places, inside fields too."""
    spark, key = star.fact.sparkSession, "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "65536")
    try:
        rows, path = _csv_round_trip(star), scratch_path(spark, "split-csv")
        rows.write.parquet(path)
    finally:
        spark.conf.set(key, old)
    return spark.read.parquet(path)


def _csv_star(star: Star) -> Star:
    """All five tables through the CSV sink and the typed load."""
    path = scratch_path(star.fact.sparkSession, "star-csv")
    write_star_csv(star, path)
    return read_star_csv(star.fact.sparkSession, path)


def _csv_sales_fact(star: Star) -> DataFrame:
    # the declared type of an order id is text
    return _sales_fact(_csv_star(star)).withColumn("order_id", F.col("order_id").cast("long"))


def _defaults(star: Star) -> DataFrame:
    """Customers and stores from files without ``is_active``: the declared DEFAULT; ``phone`` has none."""
    people = with_defaults(star.customers.drop("is_active", "created_at", "phone"), STAR_TABLES["dim_customers"])
    shops = with_defaults(star.stores.drop("is_active"), STAR_TABLES["dim_stores"])
    now = F.col("created_at").isNotNull().alias("has_load_time")
    return people.select(F.col("customer_id").alias("id"), "is_active", F.col("phone").isNull().alias("no_phone"), now).unionByName(
        shops.select(F.col("store_id").alias("id"), "is_active", F.col("manager_name").isNull().alias("no_phone"), now))


def _millions(star: Star) -> DataFrame:
    return A.category_performance(star).select("category", T.millions("total_revenue").alias("total_revenue"))


def _spread_sales(star: Star) -> DataFrame:
    """Sales by tier and country of the customer, all lines kept, by a join whose hot keys are spread."""
    lines = star.fact.select("customer_sk", "store_sk", "net_revenue", "quantity")
    people = star.customers.select("customer_sk", "loyalty_tier", F.col("country").alias("customer_country"))
    shops = star.stores.select("store_sk", "region")
    joined = spread_join(spread_join(lines, people, "customer_sk", "left"), shops, "store_sk")
    return joined.groupBy("loyalty_tier", "customer_country", "region").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("net_revenue").alias("revenue"), F.sum("quantity").cast("bigint").alias("units"))


def _violating_rows(star: Star) -> DataFrame:
    """The rows themselves that break each rule on the damaged customers, with the rule."""
    bad, out = _damaged(star), None
    for r in Q.all_rules():
        if r.table == "dim_customers":
            rows = Q.violating_rows(bad, r).select(F.lit(r.rule).alias("rule"), F.lit(r.column).alias("column_name"), "customer_id", "email")
            out = rows if out is None else out.unionByName(rows)
    return out


def _validated_top_products(star: Star) -> DataFrame:
    return A.top_selling_products(star, A.validate_top_n(A.TOP_N_MIN))


def _text_queries() -> tuple[dict, dict]:
    """Queries and oracle SQL of the ``llm`` subpackage and the corpus pipeline; none
    if these are not there."""
    queries, sql = {}, {}
    # (an empty folder counts as a package, so its module is looked for as well)
    if importlib.util.find_spec("tillstar.llm") is not None and importlib.util.find_spec("tillstar.llm.queries") is not None:
        module = importlib.import_module("tillstar.llm.queries")
        queries, sql = dict(module.QUERIES), dict(module.ORACLE_SQL)
        if importlib.util.find_spec("corpus_pipeline") is not None:
            pipeline = importlib.import_module("corpus_pipeline")
            queries["pipeline"] = pipeline.run
            if pipeline.ORACLE_SQL:
                sql["pipeline"] = pipeline.ORACLE_SQL
    return queries, sql


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: top-10 products by net revenue on sf0.001."""
    return report_types(A.top_selling_products(star_from_dir(spark, FLAGSHIP_SF_DIR), TOP_N))


def warehouse_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "kpi_overview": _star_query(A.kpi_overview),
        "category_performance": _star_query(A.category_performance),
        "channel_performance": _star_query(A.channel_performance),
        "region_performance": _star_query(A.region_performance),
        "customers_by_loyalty_tier": _star_query(A.customers_by_loyalty_tier),
        "top_selling_products": _star_query(A.top_selling_products, n=TOP_N),
        "monthly_revenue_trends": _star_query(A.monthly_revenue_trends),
        "monthly_revenue_trends_1998": _star_query(A.monthly_revenue_trends, year=TREND_YEAR),
        "top_customers": _star_query(A.top_customers, n=TOP_N),
        "top_selling_products_25": _star_query(A.top_selling_products, n=A.TOP_N_MAX),
        "top_customers_25": _star_query(A.top_customers, n=A.TOP_N_MAX),
        "year_options": _star_query(A.year_options),
        "year_filter_options": _star_query(_year_filter_options),
        "top_products_kpis": _star_query(A.top_products_kpis, n=TOP_N),
        "top_products_category_share": _star_query(A.top_products_category_share, n=TOP_N),
        "trend_kpis": _star_query(A.trend_kpis),
        "mom_series": _star_query(A.mom_series),
        "revenue_heatmap": _star_query(A.revenue_heatmap),
        "top_customers_kpis": _star_query(A.top_customers_kpis, n=TOP_N),
        "top_customers_tier_share": _star_query(A.top_customers_tier_share, n=TOP_N),
        "top_customers_favourite_categories": _star_query(A.top_customers_favourite_categories, n=TOP_N),
        "top_customers_country_share": _star_query(A.top_customers_country_share, n=TOP_N),
        "region_country_rollup": _star_query(A.region_country_rollup),
        "channel_share": _star_query(A.channel_share),
        "monthly_series": _star_query(A.monthly_series),
        "customer_table": _star_query(A.customer_table, n=TOP_N),
        "calendar": _star_query(_calendar),
        "sales_fact": _star_query(_sales_fact),
        "dim_customers": _star_query(_dim_customers),
        "dim_products": _star_query(_dim_products),
        "dim_stores": _star_query(_dim_stores),
        "load_report": _star_query(Q.load_report),
        "quality_report": _star_query(Q.quality_report),
        "quality_report_damaged": _star_query(lambda star: Q.quality_report(_damaged(star))),
        "top_selling_products_2000": _star_query(A.top_selling_products, n=2000),
        "top_customers_2000": _star_query(A.top_customers, n=2000),
        "sql_top_selling_products": _sql_query("SELECT * FROM get_top_selling_products(:n)", n=TOP_N),
        "sql_monthly_revenue_trends": _sql_query("SELECT * FROM get_monthly_revenue_trends(:year)", year=TREND_YEAR),
        "sql_top_customers": _sql_query("SELECT * FROM get_top_customers(:n)", n=TOP_N),
        "sql_category_performance": _sql_query("SELECT * FROM vw_category_performance"),
        "sql_channel_performance": _sql_query("SELECT * FROM vw_channel_performance"),
        "sql_region_performance": _sql_query("SELECT * FROM vw_region_performance"),
        "csv_round_trip": _star_query(_csv_round_trip),
        "holiday_calendar": _star_query(_holiday_calendar),
        "easter_sundays": _star_query(_easter),
        "listed_holidays": _star_query(_listed_holidays),
        "dense_keys": _dense_keys,
        "continued_keys": _continued_keys,
        "key_high_water_marks": _star_query(key_high_water_marks),
        "formatted_products": _star_query(_formatted_products),
        "formatted_dates": _formatted_dates,
        "restricted_deletes": _star_query(_restricted_deletes),
        "favourite_channels": _star_query(A.favourite_channels),
        "periods_by_revenue": _star_query(lambda star: sorted_by(A.monthly_series(star), "total_revenue", ascending=False)),
        "validated_top_products": _star_query(_validated_top_products),
        "append_history": _append_query(lambda w: w.history()),
        "append_sales_fact": _append_query(lambda w: _sales_fact(w.star())),
        "append_second_version": _append_query(lambda w: A.channel_performance(w.star(2))),
        "append_dense_sales": _append_query(lambda w: _dense_sales(w.star())),
        "dense_sales": _star_query(_dense_sales),
        "csv_split_round_trip": _star_query(_csv_split_round_trip),
        "csv_sales_fact": _star_query(_csv_sales_fact),
        "csv_load_report": _star_query(lambda star: Q.load_report(_csv_star(star))),
        "csv_defaults": _star_query(_defaults),
        "sql_null_year": _sql_query("SELECT * FROM get_monthly_revenue_trends(:year)", year=None),
        "formatted_millions": _star_query(_millions),
        "spread_join_sales": _star_query(_spread_sales),
        "violating_rows_damaged": _star_query(_violating_rows),
        "rollup_kpi_overview": _rollup_query(lambda r, star: r.kpi_overview()),
        "rollup_category_performance": _rollup_query(lambda r, star: r.category_performance(star)),
        "rollup_channel_performance": _rollup_query(lambda r, star: r.channel_performance()),
        "rollup_region_performance": _rollup_query(lambda r, star: r.region_performance(star)),
        "rollup_top_selling_products": _rollup_query(lambda r, star: r.top_selling_products(star, TOP_N)),
        "rollup_monthly_revenue_trends": _rollup_query(lambda r, star: r.monthly_revenue_trends()),
        "rollup_top_customers": _rollup_query(lambda r, star: r.top_customers(star, TOP_N)),
        "rollup_first_load": _rollup_query(lambda r, star: r.channel_performance(), as_of="history"),
        "rollup_two_loads": _rollup_query(lambda r, star: r.monthly_revenue_trends(), as_of="recent"),
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**warehouse_queries(), **_text_queries()[0]}


def oracle_sql() -> dict[str, str]:
    """DuckDB twins of ``queries()`` over the pre-registered driver views."""
    return {**duckdb_oracle.all_sql(), **_text_queries()[1]}
