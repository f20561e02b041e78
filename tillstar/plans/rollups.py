"""Stored roll-ups of the fact, kept up by each load.

    store = RollupStore(spark, "/warehouse/retail/rollups")
    store.add("2024-01-02", new_fact_rows, star.time)     # that load's own aggregates
    store.top_selling_products(star, 10)                  # merged when read

A load adds, for each kind of key (channel, month, store, product, customer), additive measures and
exact sets of orders (``operators/order_sets``) of its rows alone; nothing stored before is
read again but the order numbers.  The views merge sums and sets of all loads, or of
those up to ``as_of``, so their result equals a recomputation over the whole fact, also
where a later load has further lines of an earlier order.

A load counts from its last step, one row appended to the table of loads.  One that failed before
leaves files that no reader looks at; adding a load that is there already changes nothing.
"""

from __future__ import annotations

import os
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstar.functions.metrics import avg_of_sums, money_sum, pct
from tillstar.operators.order_sets import count_orders, count_orders_by_key, number_orders, order_sets
from tillstar.plans import analytics as A
from tillstar.star import Star

# Kinds of keys.  ``few``: the number of keys does not grow with the lines.
KINDS = {
    "channel": ["sales_channel"],
    "month": ["year", "month", "month_name"],
    "store": ["store_sk"],
    "product": ["product_sk"],     # lines not returned, as its views use
    "customer": ["customer_sk"],
}
FEW_KEYS = ("channel", "month")
MEASURES = ("quantity", "net_revenue", "profit", "total_cost", "discount_pct", "unit_price")
FACT_COLUMNS = ["sales_channel", "store_sk", "product_sk", "customer_sk", "time_sk", "order_id", "return_flag", *MEASURES]


def _of_kind(lines: DataFrame, kind: str) -> DataFrame:
    if kind == "product":
        return lines.where(~F.col("return_flag"))
    return lines.where("year is not null") if kind == "month" else lines


def _measures(lines: DataFrame, keys: list[str]) -> DataFrame:
    sums = [F.sum(m).alias(m) for m in MEASURES] + [F.count(m).alias(f"{m}_n") for m in MEASURES]
    returns = F.sum(F.when(F.col("return_flag"), F.lit(1)).otherwise(F.lit(0))).alias("returns")
    return lines.groupBy(*keys).agg(*sums, returns)


class RollupStore:
    """The roll-ups under ``base``, of the loads up to ``as_of`` (default: all)."""

    def __init__(self, spark: SparkSession, base: str, as_of: str | None = None):
        self.spark, self.base, self.as_of = spark, base, as_of

    # ------------------------------------------------------------------ loads
    def loads(self) -> list[tuple[str, str]]:
        """(name, folder) of each load, in the order of loading (one small row a load)."""
        path = os.path.join(self.base, "loads")
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return []
        rows = self.spark.read.schema("number int, name string, folder string").parquet(path).orderBy("number").collect()
        names = [(r["name"], r["folder"]) for r in rows]
        if self.as_of is None:
            return names
        return names[:[n for n, _ in names].index(self.as_of) + 1]

    def _read(self, loads: list[tuple[str, str]], table: str) -> DataFrame:
        if not loads:
            raise ValueError(f"no load in {self.base}")
        return self.spark.read.parquet(*[os.path.join(self.base, folder, table) for _, folder in loads])

    def add(self, name: str, lines: DataFrame, time: DataFrame) -> bool:
        """Adds the roll-ups of the fact rows ``lines``; False if the load ``name`` is there already."""
        done = RollupStore(self.spark, self.base).loads()
        if name in [n for n, _ in done]:
            return False
        folder = f"load-{len(done) + 1}-{uuid.uuid4().hex[:8]}"
        root = os.path.join(self.base, folder)
        known = self._read(done, "order_numbers") if done else None
        number_orders(lines, known).write.parquet(os.path.join(root, "order_numbers"))
        numbers = self.spark.read.parquet(*([os.path.join(self.base, f, "order_numbers") for _, f in done] + [os.path.join(root, "order_numbers")]))
        # the calendar has one row per hour of its span, however many lines
        months = F.broadcast(time.select("time_sk", "year", "month", "month_name"))
        # by bucket of order numbers, so that each set is built in one place: lines of all buckets in every task
        # would make a bitmap of each key, bucket and task
        rows = lines.select(*FACT_COLUMNS).join(numbers, "order_id", "left").join(months, "time_sk", "left").drop("order_id", "time_sk")
        staged = os.path.join(root, "numbered")
        rows.withColumn("bucket", F.bitmap_bucket_number("order_no")).hint("rebalance", "bucket").sortWithinPartitions("bucket").write.parquet(staged)
        numbered = self.spark.read.parquet(staged).drop("bucket")

        def write(kind: str) -> None:
            rows, keys = _of_kind(numbered, kind), KINDS[kind]
            _measures(rows, keys).write.parquet(os.path.join(root, f"measures_{kind}"))
            order_sets(rows, keys, kind in FEW_KEYS).write.parquet(os.path.join(root, f"orders_{kind}"))

        with ThreadPoolExecutor(max_workers=len(KINDS)) as pool:
            for f in [pool.submit(write, kind) for kind in KINDS]:
                f.result()
        p = self.spark._jvm.org.apache.hadoop.fs.Path(staged)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        row = self.spark.sql("SELECT cast(:number AS int) AS number, :name AS name, :folder AS folder",
                             args={"number": len(done) + 1, "name": name, "folder": folder})
        row.coalesce(1).write.mode("append").parquet(os.path.join(self.base, "loads"))
        return True

    def measures(self, kind: str) -> DataFrame:
        """The measures of each key over all loads: sums and, as ``<measure>_n``, numbers of values."""
        parts = self._read(self.loads(), f"measures_{kind}")
        names = [*MEASURES, *[f"{m}_n" for m in MEASURES], "returns"]
        return parts.groupBy(*KINDS[kind]).agg(*[F.sum(c).alias(c) for c in names])

    def orders(self, kind: str) -> DataFrame:
        """The stored sets of orders, one row per key, bucket and load."""
        return self._read(self.loads(), f"orders_{kind}")

    # ------------------------------------------------------------------ views
    def kpi_overview(self) -> DataFrame:
        sums = self.measures("channel").agg(
            money_sum("net_revenue").alias("total_revenue"), money_sum("profit").alias("total_profit"),
            avg_of_sums(F.sum("net_revenue"), F.sum("net_revenue_n")).alias("avg_order_value"),
            F.sum("quantity").cast("bigint").alias("total_units"), F.sum("returns").cast("bigint").alias("total_returns"))
        orders = count_orders(self.orders("channel"), [])
        return sums.withColumn("one", F.lit(1)).join(orders.withColumn("one", F.lit(1)), "one").select(  # one row each
            "total_revenue", "total_profit", "total_orders", "avg_order_value", "total_units", "total_returns")

    def category_performance(self, star: Star) -> DataFrame:
        per_product = self.measures("product").select(
            "product_sk", F.col("quantity").alias("qty"), F.col("net_revenue").alias("rev"), F.col("profit").alias("prof"),
            F.col("discount_pct").alias("disc_sum"), F.col("discount_pct_n").alias("disc_n"))
        return A.categories_of_products(per_product, star)

    def channel_performance(self) -> DataFrame:
        m = self.measures("channel")
        orders = count_orders(self.orders("channel"), ["sales_channel"]).withColumnRenamed("sales_channel", "c")
        out = m.join(orders, F.col("sales_channel").eqNullSafe(F.col("c")), "left").select(
            "sales_channel", F.coalesce("total_orders", F.lit(0)).alias("total_orders"), F.col("quantity").cast("bigint").alias("total_units"),
            F.col("net_revenue").cast(A.MONEY).alias("total_revenue"), avg_of_sums("net_revenue", "net_revenue_n").alias("avg_order_value"),
            avg_of_sums("discount_pct", "discount_pct_n").alias("avg_discount_pct"), F.col("returns").cast("bigint").alias("total_returns"))
        return out.orderBy(F.col("total_revenue").desc_nulls_first(), F.col("sales_channel").asc_nulls_last())

    def region_performance(self, star: Star) -> DataFrame:
        per_store = self.measures("store").select(
            "store_sk", F.col("net_revenue").alias("rev"), F.col("profit").alias("prof"), F.col("net_revenue_n").alias("n"))
        stores = star.stores.select("store_sk", "region", "country")
        orders = count_orders(self.orders("store").join(stores, "store_sk"), ["region", "country"])
        return A.regions_of_stores(per_store, orders, star)

    def monthly_revenue_trends(self, year: int | None = None) -> DataFrame:
        m, sets = self.measures("month"), self.orders("month")
        if year is not None:
            m, sets = m.where(F.col("year") == int(year)), sets.where(F.col("year") == int(year))
        keys = KINDS["month"]
        monthly = m.join(count_orders(sets, keys), keys, "left").select(
            *keys, F.col("net_revenue").cast(A.MONEY).alias("total_revenue"), F.col("profit").cast(A.MONEY).alias("total_profit"),
            F.col("total_cost").cast(A.MONEY).alias("total_cost"), F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
            F.col("quantity").cast("bigint").alias("total_quantity"), avg_of_sums("net_revenue", "net_revenue_n").alias("avg_order_value"),
            F.col("returns").cast("bigint").alias("total_returns"))
        return A.trends_of_months(monthly)

    def top_selling_products(self, star: Star, n: int = A.TOP_N_DEFAULT) -> DataFrame:
        m = self.measures("product")
        stats = m.select(
            "product_sk", F.col("quantity").cast("bigint").alias("total_quantity"), F.col("net_revenue").cast(A.MONEY).alias("total_revenue"),
            F.col("total_cost").cast(A.MONEY).alias("total_cost"), F.col("profit").cast(A.MONEY).alias("total_profit"),
            pct("profit", "net_revenue").alias("profit_margin"), avg_of_sums("unit_price", "unit_price_n").alias("avg_unit_price"),
            avg_of_sums("discount_pct", "discount_pct_n").alias("avg_discount_pct"))
        return A.top_products_of(stats, star, n, self._orders_of("product"))

    def top_customers(self, star: Star, n: int = A.TOP_N_DEFAULT) -> DataFrame:
        """``star.fact`` gives the favourites of the n customers; the rest comes from the roll-ups."""
        stats = self.measures("customer").select(
            "customer_sk", F.col("net_revenue").cast(A.MONEY).alias("total_revenue"), F.col("profit").cast(A.MONEY).alias("total_profit"),
            F.col("quantity").cast("bigint").alias("total_quantity"), avg_of_sums("net_revenue", "net_revenue_n").alias("avg_order_value"),
            F.col("returns").cast("bigint").alias("total_returns"))
        return A.top_customers_of(stats, star, n, self._orders_of("customer"))

    def _orders_of(self, kind: str):
        """Counts the orders of the given rows' keys only (the n winners')."""
        key = KINDS[kind][0]

        def add(top: DataFrame) -> DataFrame:
            sets = self.orders(kind).join(top.select(key), key, "left_semi")
            return top.join(count_orders_by_key(sets, [key]), key, "left").withColumn("total_orders", F.coalesce("total_orders", F.lit(0)))

        return add
