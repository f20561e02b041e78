"""Conform the driver's TPC-H-shaped tables to the retail star.

    fact_sales    = lineitem LEFT JOIN part (partkey) LEFT JOIN orders (orderkey)
    dim_products  = part
    dim_stores    = supplier LEFT JOIN nation LEFT JOIN region
    dim_customers = customer LEFT JOIN nation
    dim_time      = hourly calendar covering the order dates

Every line becomes one fact row.  A line without its part has NULL cost and profit, one
without its order has NULL customer and time: the quality report counts them, and the
analytics' own dimension joins decide about them.

Plan shape: the fact joins part first and orders second, so at scale it comes out hash-partitioned by the order key and
distinct-order counts need no extra exchange.  Orders are joined by a shuffled
hash join: a task keeps its share of the (narrower) orders in a hash table instead of sorting
its lines, which took most of a task's memory; AQE splits a hot order's lines here too.  The other
join strategies are left to Catalyst/AQE: nation and region broadcast from their file-size
statistics, part sort-merges at scale (AQE splits skewed join
partitions) and is broadcast at runtime when small.  The fact's ``time_sk``
is hour arithmetic on the order date (``calendar.hour_key``) instead of a
join with the calendar.  Every measure is a built-in decimal expression.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tillstar.plans.calendar import CALENDAR_COLUMNS, calendar_covering, hour_key
from tillstar.plans.keys import row_keys
from tillstar.sources.tables import DriverTables
from tillstar.star import Star

# --- fixed values: mapping of the driver tables onto the star --------------
COST_SHARE_PER_LIST_PRICE = Decimal("0.001")   # unit cost = price x (retail price / 1000)
AGE_BASE, AGE_SPAN = 18, 62                    # age = 18 + custkey % 62
EMAIL_DOMAIN = "@example.com"
TIER_THRESHOLDS = ((9000, "Platinum"), (7000, "Gold"), (4000, "Silver"))  # else Bronze
RETURNED_FLAG = "R"
# --- end of fixed values ------------------------------------------------------


def D(p: int, s: int) -> DecimalType:
    return DecimalType(p, s)


def loyalty_tier(acctbal: Column) -> Column:
    tier = F.lit("Bronze")
    for threshold, name in reversed(TIER_THRESHOLDS):
        tier = F.when(acctbal >= threshold, F.lit(name)).otherwise(tier)
    return tier


def cost_share(list_price: Column) -> Column:
    """Cost as a share of revenue: list price x 0.001 (exact; one value per part)."""
    return list_price * F.lit(COST_SHARE_PER_LIST_PRICE)


def sales_measures(gross: Column, disc_rate: Column, tax_rate: Column, share: Column,
                   quantity: Column, returned: Column) -> dict[str, Column]:
    """Line measures, each rounded to 2 places (HALF_UP, exact decimal):
    gross, discount = gross x rate, net = gross - discount,
    cost = gross x cost share, profit = net - cost, tax = net x rate,
    unit price / cost = amount / quantity, return amount = net if returned."""
    discount_amount = F.round(gross * disc_rate, 2).cast(D(10, 2))
    net = (gross - discount_amount).cast(D(12, 2))
    total_cost = F.round(gross * share, 2).cast(D(12, 2))
    return {
        "quantity": quantity.cast("smallint"),
        "unit_price": F.when(quantity > 0, F.round(gross / quantity, 2)).cast(D(10, 2)),
        "unit_cost": F.when(quantity > 0, F.round(total_cost / quantity, 2)).cast(D(10, 2)),
        "discount_pct": (disc_rate * 100).cast(D(5, 2)),
        "discount_amount": discount_amount,
        "gross_revenue": gross,
        "net_revenue": net,
        "total_cost": total_cost,
        "profit": (net - total_cost).cast(D(12, 2)),
        "tax_amount": F.round(net * tax_rate, 2).cast(D(10, 2)),
        "shipping_cost": F.lit(0).cast(D(8, 2)),
        "return_amount": F.when(returned, net).otherwise(F.lit(0)).cast(D(10, 2)),
    }


def whole_number(col: str) -> Column:
    """The column as INT; a value with a fraction fails the load instead of being cut."""
    c = F.col(col)
    return F.when(c != F.floor(c), F.raise_error(F.concat(F.lit(f"{col} is not a whole number: "), c.cast("string"))).cast("int")
                  ).otherwise(c.cast("int"))


def conform_fact(tables: DriverTables) -> DataFrame:
    # 1..N in the order of the files, the same on recompute (assigned before any shuffle)
    li = row_keys(tables.lineitem, "sale_sk").select(
        "sale_sk", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag",
    )
    # the cost share is computed on the part side, once per part instead of once per line
    part = tables.part.select("p_partkey", cost_share(F.col("p_retailprice").cast(D(6, 2))).alias("cost_share"))
    orders = tables.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")

    lines = li.join(part, li.l_partkey == part.p_partkey, "left")
    lines = lines.join(orders.hint("shuffle_hash"), lines.l_orderkey == orders.o_orderkey, "left")
    # the calendar key is arithmetic on the order date: no lookup join, no subquery
    lines = lines.withColumn("time_sk", hour_key(F.col("o_orderdate")))

    returned = F.col("l_returnflag") == RETURNED_FLAG
    m = sales_measures(
        gross=F.col("l_extendedprice").cast(D(12, 2)),
        disc_rate=F.col("l_discount").cast(D(5, 2)),
        tax_rate=F.col("l_tax").cast(D(5, 2)),
        share=F.col("cost_share"),
        quantity=whole_number("l_quantity"),
        returned=returned,
    )
    return lines.select(
        "sale_sk",
        F.col("o_custkey").alias("customer_sk"),
        F.col("l_partkey").alias("product_sk"),
        F.col("l_suppkey").alias("store_sk"),
        "time_sk",
        F.col("l_orderkey").alias("order_id"),
        *[c.alias(n) for n, c in m.items()],
        F.col("o_orderstatus").alias("payment_method"),
        F.col("o_orderpriority").alias("sales_channel"),
        returned.alias("return_flag"),
        F.current_timestamp().alias("created_at"),
    )


def conform_products(tables: DriverTables) -> DataFrame:
    price = F.col("p_retailprice").cast(D(10, 2))
    return tables.part.select(
        F.col("p_partkey").alias("product_sk"),
        F.col("p_partkey").cast("string").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)).alias("sub_category"),
        F.col("p_brand").alias("brand"),
        F.round(price * price * F.lit(COST_SHARE_PER_LIST_PRICE), 2).cast(D(10, 2)).alias("unit_cost"),
        price.alias("unit_price"),
        F.lit(None).cast(D(8, 2)).alias("weight_kg"),
        F.lit(True).alias("is_active"),
        F.lit(None).cast("date").alias("launch_date"),
        F.lit(None).cast("string").alias("supplier_country"),
        F.current_timestamp().alias("created_at"),
    )


def conform_stores(tables: DriverTables) -> DataFrame:
    # nation and region are a few KB on disk: Catalyst broadcasts them from
    # the file-size statistics, no hint or extra job needed
    nation = tables.nation.select("n_nationkey", "n_name", "n_regionkey")
    region = tables.region.select("r_regionkey", "r_name")
    s = tables.supplier.select("s_suppkey", "s_name", "s_nationkey")
    s = s.join(nation, s.s_nationkey == nation.n_nationkey, "left")
    s = s.join(region, s.n_regionkey == region.r_regionkey, "left")
    null_s = F.lit(None).cast("string")
    return s.select(
        F.col("s_suppkey").alias("store_sk"),
        F.col("s_suppkey").cast("string").alias("store_id"),
        F.col("s_name").alias("store_name"),
        null_s.alias("store_type"),
        null_s.alias("city"),
        null_s.alias("state"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("region"),
        F.lit(None).cast("int").alias("sq_footage"),
        F.lit(None).cast("date").alias("open_date"),
        F.lit(True).alias("is_active"),
        null_s.alias("manager_name"),
        F.current_timestamp().alias("created_at"),
    )


def conform_customers(tables: DriverTables) -> DataFrame:
    nation = tables.nation.select("n_nationkey", "n_name")
    c = tables.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    c = c.join(nation, c.c_nationkey == nation.n_nationkey, "left")
    null_s = F.lit(None).cast("string")
    return c.select(
        F.col("c_custkey").alias("customer_sk"),
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.split_part(F.col("c_name"), F.lit("#"), F.lit(1)).alias("first_name"),
        F.split_part(F.col("c_name"), F.lit("#"), F.lit(2)).alias("last_name"),
        F.concat(F.lower(F.col("c_name")), F.lit(EMAIL_DOMAIN)).alias("email"),
        null_s.alias("phone"),
        null_s.alias("city"),
        null_s.alias("state"),
        F.col("n_name").alias("country"),
        null_s.alias("gender"),
        (F.lit(AGE_BASE) + F.col("c_custkey") % AGE_SPAN).cast("smallint").alias("age"),
        loyalty_tier(F.col("c_acctbal")).alias("loyalty_tier"),
        F.lit(None).cast("date").alias("registration_date"),
        F.lit(True).alias("is_active"),
        F.current_timestamp().alias("created_at"),
    )


def conform(tables: DriverTables) -> Star:
    """Lazy star over the driver tables: nothing runs until a query does."""
    calendar = calendar_covering(tables.orders, "o_orderdate")
    return Star(
        fact=conform_fact(tables),
        customers=conform_customers(tables),
        products=conform_products(tables),
        stores=conform_stores(tables),
        time=calendar.select(*CALENDAR_COLUMNS, F.current_timestamp().alias("created_at")),
        hour_epoch_keys=True,
    )


def star_from_dir(spark, sf_dir: str) -> Star:
    return conform(DriverTables(spark, sf_dir))
