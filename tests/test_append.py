"""Appending loads, keys from file places, computed holidays."""

from __future__ import annotations

import datetime as dt
import os
import time
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from conftest import make_star, sale
from pyspark.sql import functions as F

from tillstar.plans import append as P
from tillstar.plans import calendar as C
from tillstar.plans import keys as K
from tillstar.star import Star


def counts(w):
    return {(r.version, r.table_name): (r.added, r.row_count, r.max_key) for r in w.history().collect() if r.table_name in ("fact_sales", "dim_stores")}


def with_fact(star, fact):
    return Star(fact, star.customers, star.products, star.stores, star.time)


@pytest.fixture(scope="module")
def star(spark):
    # lines 5 and 6 are the same but for their key
    return make_star(spark, [sale(i, order_id=f"o{i}") for i in range(1, 5)] + [sale(5, order_id="o9"), sale(6, order_id="o9")], hours=48)


def test_loads_versions_and_expiry(spark, star, tmp_path):
    base = str(tmp_path / "w")
    w = P.AppendWarehouse(spark, base)
    with pytest.raises(ValueError, match="no version"):
        w.star()
    first = with_fact(star, star.fact.where("sale_sk IN (1, 2, 5)"))
    assert [w.append(first), w.append(first), w.append(star)] == [1, 2, 3]
    assert counts(w) == {(1, "fact_sales"): (3, 3, 3), (1, "dim_stores"): (3, 3, 3), (2, "fact_sales"): (0, 3, 3), (2, "dim_stores"): (0, 3, 3),
                         (3, "fact_sales"): (3, 6, 6), (3, "dim_stores"): (0, 3, 3)}
    now = w.star()
    assert sorted(r.order_id for r in now.fact.collect()) == ["o1", "o2", "o3", "o4", "o9", "o9"]
    assert sorted(r.sale_sk for r in now.fact.collect()) == [1, 2, 3, 4, 5, 6]
    assert sorted(r.order_id for r in w.star(1).fact.collect()) == ["o1", "o2", "o9"]
    assert P.HASH not in now.fact.columns and now.fact.columns == star.fact.columns

    # a failed load leaves no version and does not change the current one
    broken = with_fact(star, star.fact.withColumn("net_revenue", F.raise_error(F.lit("bad line")).cast("decimal(12,2)")))
    with pytest.raises(Exception, match="bad line"):
        w.append(broken)
    assert w.versions() == [1, 2, 3] and w.damaged_parts() == []

    # parts that a kept version lists stay; those of version 2 (no rows) are listed by 3
    assert w.expire(keep=1) == [] and w.versions() == [3] and w.star().fact.count() == 6
    with pytest.raises(ValueError, match="no version 1"):
        w.star(1)
    assert w.append(with_fact(star, star.fact.limit(0))) == 4 and w.star().fact.count() == 6

    part = [r for r in w._parts()["fact_sales"] if r["row_count"]][0]["part"]
    spark.read.parquet(os.path.join(base, part)).limit(1).write.mode("append").parquet(os.path.join(base, part))
    assert w.damaged_parts() == [part]


def test_checksum_is_independent_of_order_and_of_load_time(spark, star):
    a = star.fact.agg(P.checksum(P.content_hash(star.fact, "fact_sales"))).first()[0]
    other = star.fact.orderBy(F.col("sale_sk").desc()).withColumn("created_at", F.lit("2001-01-01").cast("timestamp")).withColumn("sale_sk", F.lit(7).cast("long"))
    assert other.agg(P.checksum(P.content_hash(other, "fact_sales"))).first()[0] == a
    changed = star.fact.withColumn("payment_method", F.lit(None).cast("string"))
    assert changed.agg(P.checksum(P.content_hash(changed, "fact_sales"))).first()[0] != a


@pytest.mark.parametrize("most", [100_000, 2])
def test_keys_from_file_places(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(K, "MAX_KEYED_FILES", most)
    path = str(tmp_path / "t")
    spark.range(0, 1000).repartition(7).write.parquet(path)
    rows = K.row_keys(spark.read.parquet(path), "k", start=5)
    got = rows.collect()
    assert rows.columns == ["id", "k"] and sorted(r.k for r in got) == list(range(5, 1005))
    assert sorted(got) == sorted(rows.collect())
    filtered = rows.where("id % 10 = 3").collect()  # a filter changes no key
    assert set(filtered) <= set(got) and len(filtered) == 100
    if most > 7:
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_easter_and_holidays_of_known_years(spark):
    known = {1818: "03-22", 1943: "04-25", 1954: "04-18", 1981: "04-19", 2000: "04-23", 2008: "03-23", 2019: "04-21", 2024: "03-31", 2038: "04-25"}
    df = spark.createDataFrame([(y,) for y in known], "y int").select("y", C.easter_sunday(F.col("y")).alias("e"))
    assert {r.y: r.e.strftime("%m-%d") for r in df.collect()} == known
    cal = C.hourly_calendar(spark, dt.datetime(2018, 1, 1), 24 * 365)
    rows = cal.where("hour = 0").select("full_date", C.holiday_name(F.col("full_date")).alias("h")).where("h is not null").collect()
    assert {r.h: r.full_date.strftime("%m-%d") for r in rows} == {
        "New Year's Day": "01-01", "Martin Luther King Day": "01-15", "Presidents' Day": "02-19", "Good Friday": "03-30", "Easter Monday": "04-02",
        "Memorial Day": "05-28", "Independence Day": "07-04", "Labor Day": "09-03", "Columbus Day": "10-08", "Veterans Day": "11-11",
        "Thanksgiving": "11-22", "Christmas Day": "12-25"}
    own = C.with_computed_holidays(cal, {"second last Friday": C.nth_weekday(3, 5, -2)}).where("is_holiday")
    assert {r.full_date for r in own.collect()} == {dt.date(2018, 3, 23)} and own.count() == 24
    assert C.with_computed_holidays(cal, {}).where("is_holiday").count() == 0


def test_a_load_moves_hashes_and_places_not_rows(spark, star, tmp_path, monkeypatch):
    """Over several bitmaps of 32,768 rows and several files; rows twice, and some there already."""
    path, kept = str(tmp_path / "lines"), []
    one = star.fact.where("sale_sk = 1").drop("order_id")
    ids = spark.range(80_000).select(F.concat(F.lit("o"), F.col("id") % 79_000).alias("order_id"))
    ids.crossJoin(one).select(*star.fact.columns).repartition(3).write.parquet(path)
    lines = spark.read.parquet(path)
    plain = type(lines).checkpoint
    monkeypatch.setattr(type(lines), "checkpoint", lambda self, *a, **k: kept.append(self.columns) or plain(self, *a, **k))
    w = P.AppendWarehouse(spark, str(tmp_path / "w"))
    for n, some in enumerate((lines.where("order_id LIKE '%7'"), lines.where("order_id LIKE '%7' OR order_id LIKE '%5'"), lines), 1):
        assert w.append(with_fact(star, some), stored=("fact",)) == n
        s = w.star().fact.agg(F.count("sale_sk"), F.count_distinct("sale_sk"), F.min("sale_sk"), F.max("sale_sk")).first()
        assert tuple(s) == (some.count(),) * 2 + (1, some.count())
    assert lines.select("order_id").exceptAll(w.star().fact.select("order_id")).isEmpty()
    assert not any("net_revenue" in c for c in kept) and not list((tmp_path / "w" / "staged").glob("*/*"))


def test_staged_rows_serve_several_loads(spark, star, tmp_path):
    """Written once, without the key that the loads give, and with their hash; gone after the loads, failed ones too."""
    w = P.AppendWarehouse(spark, str(tmp_path / "w"))
    with w.staged(star.fact.drop("sale_sk"), "fact_sales") as rows:
        assert rows.where(F.col(P.HASH) != P.content_hash(rows, "fact_sales")).isEmpty() and rows.count() == 6
        for version, some in enumerate((rows.where("order_id < 'o3'"), rows.where("order_id <> 'o4'"), rows), 1):
            assert w.append(with_fact(star, some), stored=("fact",)) == version
    assert [counts(w)[v, "fact_sales"] for v in (1, 2, 3)] == [(2, 2, 2), (3, 5, 5), (1, 6, 6)]
    assert w.damaged_parts() == [] and w.star().fact.columns == star.fact.columns
    with pytest.raises(ValueError, match="stop"):
        with w.staged(star.fact, "fact_sales"):
            raise ValueError("stop")
    assert not [f for f in (tmp_path / "w" / "staged").rglob("*") if f.is_file()]
    files = [f for f in (tmp_path / "w" / "fact_sales").rglob("*.parquet") if pq.ParquetFile(f).metadata.num_rows]
    assert files and {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}


def test_rows_are_numbered_in_the_order_of_their_places(spark, star, tmp_path):
    """Marked places at every position of a word, in words and bitmaps that are full, sparse or empty."""
    path = str(tmp_path / "lines")
    one = star.fact.where("sale_sk = 1").drop("order_id")
    spark.range(0, 140_000, 1, 2).select(F.col("id").cast("string").alias("order_id")).crossJoin(one).select(*star.fact.columns).write.parquet(path)
    lines, w = spark.read.parquet(path), P.AppendWarehouse(spark, str(tmp_path / "w"))
    places = {r.order_id: r.place for r in K.row_keys(lines, "place").select("order_id", "place").collect()}
    n, sent = "cast(order_id AS int)", set()
    for some in (f"{n} % 65 = 3 OR {n} BETWEEN 200 AND 400 OR {n} > 139990", f"{n} < 20000 OR {n} % 63 = 0"):
        start = len(sent)
        w.append(with_fact(star, lines.where(some)), stored=("fact",))
        new = {r.order_id for r in lines.where(some).select("order_id").collect()} - sent
        got = {r.order_id: r.sale_sk for r in w.star().fact.where(F.col("sale_sk") > start).select("order_id", "sale_sk").collect()}
        assert got == {o: i for i, o in enumerate(sorted(new, key=places.get), start + 1)}
        sent |= new


def test_a_load_leaves_no_shuffle_files(spark, star, tmp_path):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f for d in disk.localDirsString() for f in Path(d).rglob("shuffle_*.data")}

    before, w, key = files(), P.AppendWarehouse(spark, str(tmp_path / "w")), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key)
    lines = star.fact.repartition(3, "order_id")
    assert [w.append(with_fact(star, lines.where("order_id < 'o3'"))), w.append(with_fact(star, lines))] == [1, 2]
    assert spark.conf.get(key) == old
    for _ in range(50):  # executors delete them a little later
        if not (left := files() - before):
            break
        time.sleep(0.2)
    assert not left and w.star().fact.count() == 6
