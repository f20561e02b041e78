"""The conformed fact keeps every line, whatever its order date, part or the session's time zone."""

from __future__ import annotations

import os
import shutil

import pytest
from pyspark.sql import functions as F

from tillstar.plans import analytics as A
from tillstar.plans.conform import star_from_dir
from tillstar.plans.load import ConstraintViolation, load_warehouse
from tillstar.plans.quality import quality_report
from tillstar.schema import STAR_TABLES
from tillstar.sources.csv_files import read_table_csv, write_star_csv, write_table_csv
from tillstar.sources.parquet_store import current_path, read_current

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def changed(spark, folder, **tables):
    """A copy of the driver tables with some replaced."""
    for name in os.listdir(SF):
        if name.split(".")[0] not in tables:
            shutil.copy(os.path.join(SF, name), folder / name)
    for name, change in tables.items():
        change(spark.read.parquet(f"{SF}/{name}.parquet")).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


def violations(star):
    return {(r["rule"], r["column_name"]): r["violations"] for r in quality_report(star).where("table_name = 'fact_sales'").collect()}


def test_off_hour_dates_and_missing_parts_stay(spark, tmp_path):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    sf = changed(spark, tmp_path,
                 orders=lambda t: t.withColumn("o_orderdate", F.expr("o_orderdate + INTERVAL 30 MINUTES")),
                 part=lambda t: t.where("p_partkey % 2 = 0"))
    star = star_from_dir(spark, sf)
    assert star.fact.count() == lines.count()
    assert star.fact.where("time_sk is null").count() == 0
    lost = lines.where("l_partkey % 2 = 1").count()
    found = violations(star)
    assert found["B5_foreign_key", "product_sk"] == lost > 0
    assert found["B1_not_null", "total_cost"] == lost and found["B5_foreign_key", "time_sk"] == 0
    plain = star_from_dir(spark, SF)
    assert A.kpi_overview(star).first()["total_revenue"] == A.kpi_overview(plain).first()["total_revenue"]


def test_lines_without_their_order_stay(spark, tmp_path):
    sf = changed(spark, tmp_path, orders=lambda t: t.where("o_orderkey % 3 <> 0"))
    star = star_from_dir(spark, sf)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    orphans = lines.join(spark.read.parquet(f"{sf}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").count()
    assert star.fact.count() == lines.count()
    assert violations(star)["B1_not_null", "customer_sk"] == orphans > 0


def test_a_fraction_of_a_piece_fails(spark, tmp_path):
    sf = changed(spark, tmp_path, lineitem=lambda t: t.withColumn("l_quantity", F.col("l_quantity") + 0.9))
    with pytest.raises(Exception, match="not a whole number"):
        star_from_dir(spark, sf).fact.agg(F.sum("quantity")).collect()


@pytest.mark.parametrize("zone", ["America/Sao_Paulo", "America/New_York"])
def test_time_zones_change_nothing(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        star = star_from_dir(spark, SF)
        keys = star.time.agg(F.count("time_sk"), F.count_distinct("time_sk")).first()
        assert keys[0] == keys[1]
        total = A.kpi_overview(star).first()["total_revenue"]
        assert A.monthly_revenue_trends(star).agg(F.sum("total_revenue")).first()[0] == total
        assert violations(star)["B5_foreign_key", "time_sk"] == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_csv_keeps_blanks_breaks_quotes_empty_and_null(spark, tmp_path):
    table = STAR_TABLES["dim_products"]
    names = ["  small ring  ", 'a "quoted", one', "two\nlines", "", "\ttab", None]
    rows = [tuple(i + 1 if c.name == "product_sk" else n if c.name == "product_name" else None for c in table.columns)
            for i, n in enumerate(names)]
    path = str(tmp_path / "products")
    write_table_csv(spark.createDataFrame(rows, table.struct()), path, table)
    back = read_table_csv(spark, path, table, multi_line=True).orderBy("product_sk").collect()
    assert [r["product_name"] for r in back] == names


def test_a_load_can_refuse_violations_and_readers_follow_the_current_version(spark, tmp_path):
    base, good, bad = (str(tmp_path / n) for n in ("base", "good", "bad"))
    star = star_from_dir(spark, SF)
    # countries are names in the driver tables: the declared two letters would not hold them
    star.customers, star.stores = (t.withColumn("country", F.substring("country", 1, 2)) for t in (star.customers, star.stores))
    write_star_csv(star, good)
    first = load_warehouse(spark, good, base, refuse_violations=True)
    assert current_path(spark, base) == first.path
    star.products = star.products.where("product_sk % 2 = 0")
    write_star_csv(star, bad)
    with pytest.raises(ConstraintViolation, match="B5_foreign_key fact_sales.product_sk"):
        load_warehouse(spark, bad, base, refuse_violations=True)
    assert current_path(spark, base) == first.path
    second = load_warehouse(spark, bad, base)
    assert current_path(spark, base) == second.path != first.path
    assert read_current(spark, base).products.count() == star.products.count()
