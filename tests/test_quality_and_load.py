"""Constraint checks, CSV load semantics, calendar, keys, parquet store."""

from __future__ import annotations

import datetime as dt
import os
import shutil
import tempfile

import pytest
from conftest import make_star, sale

from tillstar.plans import quality as Q
from tillstar.plans.calendar import hourly_calendar, with_holidays
from tillstar.plans.keys import continue_keys, dense_keys, high_water_mark
from tillstar.sources.csv_files import read_star_csv, read_table_csv, write_star_csv
from tillstar.sources.parquet_store import read_star, write_star


def report(star):
    return {(r["rule"], r["table_name"], r["column_name"]): r["violations"]
            for r in Q.quality_report(star).collect()}


def test_clean_star_has_no_violations(spark):
    star = make_star(spark, [sale(1), sale(2, customer_sk=2, product_sk=3, store_sk=2)])
    rep = report(star)
    assert rep and all(v == 0 for v in rep.values()), {k: v for k, v in rep.items() if v}


def test_one_violation_per_rule(spark):
    customers = [
        dict(customer_sk=1, customer_id="c1", first_name="A", last_name="B", email="a@x", age=30,
             loyalty_tier="Gold", gender="M"),
        # B1: first_name NULL; B2 unique: email duplicates row 1; B3: gender 'X'; B4: age 17
        dict(customer_sk=2, customer_id="c2", first_name=None, last_name="B", email="a@x", age=17,
             loyalty_tier="Gold", gender="X"),
        # NULL in a checked column is no B3/B4 violation; B8: state longer than 10
        dict(customer_sk=3, customer_id="c3", first_name="C", last_name="D", email="c@x", age=None,
             loyalty_tier=None, gender=None, state="x" * 11),
    ]
    sales = [sale(1, customer_sk=1), sale(2, customer_sk=9)]  # B5: customer 9 missing
    star = make_star(spark, sales, customers=customers)
    rep = report(star)
    bad = {k: v for k, v in rep.items() if v}
    assert bad == {
        ("B1_not_null", "dim_customers", "first_name"): 1,
        ("B2_unique", "dim_customers", "email"): 1,
        ("B3_domain", "dim_customers", "gender"): 1,
        ("B4_range", "dim_customers", "age"): 1,
        ("B8_length", "dim_customers", "state"): 1,
        ("B5_foreign_key", "fact_sales", "customer_sk"): 1,
    }
    fk = [r for r in Q.all_rules() if r.rule == "B5_foreign_key" and r.column == "customer_sk"][0]
    assert [r["sale_sk"] for r in Q.violating_rows(star, fk).collect()] == [2]
    dup = [r for r in Q.all_rules() if r.rule == "B2_unique" and r.column == "email"][0]
    assert sorted(r["customer_sk"] for r in Q.violating_rows(star, dup).collect()) == [1, 2]


def test_forged_fingerprints_do_not_change_the_report(spark, monkeypatch):
    """All texts clash in the first pass; the second compares them themselves."""
    customers = [dict(customer_sk=i, customer_id=f"c{i % 5}", first_name="A", last_name="B", email=f"e{i}@x" if i < 7 else None, age=30) for i in range(1, 9)]
    star = make_star(spark, [sale(i, customer_sk=i) for i in range(1, 12)], customers=customers)
    plain = report(star)
    assert plain["B2_unique", "dim_customers", "customer_id"] == 3 and plain["B5_foreign_key", "fact_sales", "customer_sk"] == 3
    monkeypatch.setattr(Q, "fingerprint", lambda column: "0L")
    assert report(star) == plain


def test_a_few_rules_only(spark):
    star = make_star(spark, [sale(1, customer_sk=9), sale(2, customer_sk=9), sale(3, customer_sk=None)])
    some = [r for r in Q.all_rules() if r.table == "fact_sales" and r.column == "customer_sk"]
    got = {(r["rule"], r["violations"]) for r in Q.quality_report(star, some).collect()}
    assert got == {("B1_not_null", 1), ("B5_foreign_key", 2)}
    assert {r["violations"] for r in Q.quality_report(star, [r for r in some if r.rule == "B1_not_null"]).collect()} == {1}


def test_precision_rule(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("12345678.12",), ("123456789.5",), (None,)], "x string")
    rule = Q.Rule("B9_precision", "t", "x", (10, 2))
    assert df.where(Q.violation_condition(rule)).count() == 1
    assert df.agg(F.count_if(Q.violation_condition(rule))).first()[0] == 1


def test_restricted_deletes(spark):
    star = make_star(spark, [sale(1, product_sk=2)])
    blocked, free = Q.restricted_deletes(star.fact, star.products.where("product_sk IN (1, 2)"), "product_sk")
    assert [r["product_sk"] for r in blocked.collect()] == [2]
    assert [r["product_sk"] for r in free.collect()] == [1]


def test_load_report_counts(spark):
    star = make_star(spark, [sale(1), sale(2)], hours=48)
    rep = {r["table_name"]: r["row_count"] for r in Q.load_report(star).collect()}
    assert rep == {"dim_customers": 5, "dim_products": 5, "dim_stores": 3, "dim_time": 48,
                   "fact_sales": 2, "Total": 63}


def test_csv_round_trip_positional_and_defaults(spark):
    star = make_star(spark, [sale(1, returned=True, return_amount=5), sale(2)], hours=24)
    d = tempfile.mkdtemp(prefix="tillstar-csv-")
    write_star_csv(star, d)
    back = read_star_csv(spark, d)
    f = {r["sale_sk"]: r for r in back.fact.collect()}
    assert f[1]["return_amount"] == 5 and f[1]["return_flag"] is True
    assert f[2]["return_amount"] == 0
    assert all(r["created_at"] is not None for r in f.values())  # DEFAULT now()
    assert back.time.count() == 24 and back.customers.count() == 5
    # the fact file lists return_amount last
    header = open([os.path.join(d, "fact_sales.csv", p) for p in os.listdir(os.path.join(d, "fact_sales.csv"))
                   if p.endswith(".csv")][0]).readline().strip().split(",")
    assert header[-1] == "return_amount" and header[-2] == "return_flag"


def test_csv_bad_value_fails_load(spark):
    d = tempfile.mkdtemp(prefix="tillstar-badcsv-")
    p = os.path.join(d, "dim_stores.csv")
    with open(p, "w") as fh:
        fh.write("store_sk,store_id,store_name,store_type,city,state,country,region,sq_footage,open_date,"
                 "is_active,manager_name\n")
        fh.write('1,u1,"Big ""One""",Outlet,,,US,North,100,2020-01-02,True,\n')
        fh.write("2,u2,Two,Outlet,,,US,North,not-a-number,2020-01-02,False,\n")
    df = read_table_csv(spark, p, "dim_stores")
    with pytest.raises(Exception):
        df.collect()
    with open(p, "w") as fh:
        fh.write("h\n")
        fh.write('1,u1,"Big ""One""",Outlet,,,US,North,100,2020-01-02,True,\n')
    (r,) = read_table_csv(spark, p, "dim_stores").collect()
    assert r["store_name"] == 'Big "One"' and r["city"] is None and r["is_active"] is True
    assert r["open_date"] == dt.date(2020, 1, 2)
    # quoted empty text is an empty string, unquoted empty is NULL; "" in a typed column fails
    with open(p, "w") as fh:
        fh.write("h\n")
        fh.write('1,u1,S,Outlet,"",,US,North,100,2020-01-02,True,""\n')
    (r,) = read_table_csv(spark, p, "dim_stores").collect()
    assert r["city"] == "" and r["state"] is None and r["manager_name"] == ""
    with open(p, "w") as fh:
        fh.write("h\n")
        fh.write('1,u1,S,Outlet,,,US,North,"",2020-01-02,True,\n')
    with pytest.raises(Exception):
        read_table_csv(spark, p, "dim_stores").collect()


def test_calendar_iso_week_weekday_fiscal(spark):
    cal = {r["time_sk"]: r for r in hourly_calendar(spark, "2018-01-01 00:00:00", 10_000).collect()}
    assert len(cal) == 10_000
    last = cal[10_000]
    assert (last["full_date"], last["hour"]) == (dt.date(2019, 2, 21), 15)
    r = next(v for v in cal.values() if v["full_date"] == dt.date(2018, 12, 31) and v["hour"] == 15)
    assert (r["week"], r["day_of_week"], r["day_name"], r["is_weekend"]) == (1, 1, "Monday", False)
    r = next(v for v in cal.values() if v["full_date"] == dt.date(2018, 1, 7))
    assert (r["day_of_week"], r["is_weekend"], r["month_name"]) == (7, True, "January")
    r = next(v for v in cal.values() if v["full_date"] == dt.date(2018, 10, 1))
    assert (r["fiscal_year"], r["fiscal_quarter"], r["quarter"]) == (2019, 4, 4)
    hol = spark.createDataFrame([(dt.date(2018, 12, 25),)], "holiday_date date")
    flagged = with_holidays(hourly_calendar(spark, "2018-12-24 00:00:00", 72), hol)
    assert flagged.where("is_holiday").count() == 24


def test_dense_keys_and_high_water_mark(spark):
    df = spark.range(0, 1000, numPartitions=7).withColumnRenamed("id", "v")
    keyed = dense_keys(df, "sk")
    ks = sorted(r["sk"] for r in keyed.collect())
    assert ks == list(range(1, 1001))
    more = continue_keys(spark.range(0, 5, numPartitions=2), keyed, "sk")
    assert sorted(r["sk"] for r in more.collect()) == [1001, 1002, 1003, 1004, 1005]
    assert high_water_mark(spark.range(0).withColumnRenamed("id", "sk"), "sk") == 0


def test_parquet_store_round_trip(spark):
    star = make_star(spark, [sale(1), sale(2, order_id="o1")], hours=24)
    d = tempfile.mkdtemp(prefix="tillstar-store-")
    write_star(star, d, fact_partitions=2)
    back = read_star(spark, d)
    assert back.fact.count() == 2 and back.time.count() == 24
    assert sorted(back.fact.columns) == sorted(star.fact.columns)


def test_load_warehouse_end_to_end(spark):
    from tillstar.plans.load import load_warehouse

    star = make_star(spark, [sale(1), sale(2, customer_sk=3, product_sk=4)], hours=24 * 20)
    src = tempfile.mkdtemp(prefix="tillstar-landing-")
    write_star_csv(star, src)
    base = tempfile.mkdtemp(prefix="tillstar-wh-")
    res = load_warehouse(spark, src, base)
    assert res.path.startswith(base)
    counts = {r["table_name"]: r["row_count"] for r in res.load_report.collect()}
    assert counts["fact_sales"] == 2 and counts["Total"] == 2 + 5 + 5 + 3 + 480
    assert all(r["violations"] == 0 for r in res.quality_report.collect())
    marks = {r["table_name"]: r["max_key"] for r in res.high_water_marks.collect()}
    assert marks == {"fact_sales": 2, "dim_customers": 5, "dim_products": 5, "dim_stores": 3, "dim_time": 480}


def test_failed_load_keeps_previous_version(spark):
    from tillstar.plans.load import load_warehouse

    star = make_star(spark, [sale(1)], hours=24)
    src = tempfile.mkdtemp(prefix="tillstar-landing-")
    write_star_csv(star, src)
    base = tempfile.mkdtemp(prefix="tillstar-wh-")
    good = load_warehouse(spark, src, base)
    # a second landing copy (part files only, no checksum files) with one bad fact value:
    # the next load must fail on parsing and leave the first version readable
    bad = tempfile.mkdtemp(prefix="tillstar-landing-bad-")
    for table in os.listdir(src):
        os.makedirs(os.path.join(bad, table))
        for p in os.listdir(os.path.join(src, table)):
            if p.endswith(".csv"):
                shutil.copyfile(os.path.join(src, table, p), os.path.join(bad, table, p))
    fact_dir = os.path.join(bad, "fact_sales.csv")
    parts = [os.path.join(fact_dir, p) for p in os.listdir(fact_dir)]
    part = next(p for p in parts if len(open(p).read().splitlines()) > 1)
    lines = open(part).read().splitlines()
    cells = lines[1].split(",")
    cells[6] = "many"  # quantity
    lines[1] = ",".join(cells)
    open(part, "w").write("\n".join(lines) + "\n")
    src = bad
    with pytest.raises(Exception, match="(?i)malformed"):
        load_warehouse(spark, src, base)
    assert read_star(spark, good.path).fact.count() == 1


def test_calendar_covering_keys_match_hour_key(spark):
    from pyspark.sql import functions as F

    from tillstar.plans.calendar import calendar_covering, hour_key

    src = spark.createDataFrame([(dt.datetime(1995, 1, 2, 5, 0),), (dt.datetime(1995, 1, 4, 0, 0),)], "t timestamp_ntz")
    cal = calendar_covering(src, "t").collect()
    assert len(cal) == 3 * 24  # whole days: 1995-01-02 .. 1995-01-04
    epoch = dt.datetime(1970, 1, 1)
    assert all(r["time_sk"] == int((r["ts"] - epoch).total_seconds() // 3600) for r in cal)
    keyed = src.select(hour_key(F.col("t")).alias("k")).collect()
    assert {r["k"] for r in keyed} <= {r["time_sk"] for r in cal}
    off = spark.createDataFrame([(dt.datetime(1995, 1, 2, 5, 30),)], "t timestamp_ntz")
    assert off.select(hour_key(F.col("t")).alias("k")).first()["k"] == keyed[0]["k"]  # the hour that holds it


def test_csv_numeric_rounds_and_rejects_overflow(spark):
    d = tempfile.mkdtemp(prefix="tillstar-numcsv-")
    p = os.path.join(d, "dim_products.csv")
    head = ("product_sk,product_id,product_name,category,sub_category,brand,unit_cost,unit_price,"
            "weight_kg,is_active,launch_date,supplier_country\n")
    with open(p, "w") as fh:
        fh.write(head + "1,p1,P,C,,B,1.235,2.234,0.5,True,,\n")
    (r,) = read_table_csv(spark, p, "dim_products").collect()
    assert str(r["unit_cost"]) == "1.24" and str(r["unit_price"]) == "2.23"  # NUMERIC(10,2) rounds
    with open(p, "w") as fh:
        fh.write(head + "1,p1,P,C,,B,123456789.5,2,0.5,True,,\n")  # 9 integer digits > NUMERIC(10,2)
    with pytest.raises(Exception):
        read_table_csv(spark, p, "dim_products").collect()


def test_restricted_deletes_reduces_the_keys_first(spark):
    star = make_star(spark, [sale(1, product_sk=1)])
    for df in Q.restricted_deletes(star.fact, star.products, "product_sk"):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join Left") == 1 and plan.index("Join Left") < plan.index("Aggregate")


def test_row_rules_are_folded(spark):
    """Written out as one expression they are a method that the JVM does not compile."""
    star = make_star(spark, [sale(1, product_sk=1, quantity=0)])
    own = [(Q.ROWS + n, r) for n, r in enumerate(Q.table_rules(Q.STAR_TABLES["fact_sales"])) if r.rule in ("B1_not_null", "B4_range")]
    df = Q._entries(star.fact, [], own)
    assert "aggregate(array(" in df._jdf.queryExecution().optimizedPlan().toString()
    assert [bin(r["value"]).count("1") for r in df.collect()] == [sum(r.rule == "B4_range" and r.column == "quantity" for _, r in own)]
