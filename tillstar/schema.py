"""Declared schema of the retail star: five tables, their column types,
file column order, defaults, and the declared constraints (used by the
quality report).

Fixed values below mirror the warehouse DDL and must stay as they are for
results to match: table and column names, types, lengths, CHECK domains and
ranges, and the column order of the load files.  One deliberate widening:
surrogate keys are BIGINT (the DDL's SERIAL/INTEGER tops out at 2^31 rows,
far below a 100 TB fact); ``time_sk`` stays INT, bounded by the calendar.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import (
    BooleanType, DataType, DateType, DecimalType, IntegerType, LongType, ShortType, StringType,
    StructField, StructType, TimestampType,
)


def D(p: int, s: int) -> DecimalType:
    return DecimalType(p, s)


@dataclass(frozen=True)
class Column_:
    name: str
    dtype: DataType
    nullable: bool = True
    max_len: int | None = None       # VARCHAR(n) / CHAR(n)
    default: object = None           # DEFAULT for columns absent from a load
    in_file: bool = True             # present in the load file


@dataclass(frozen=True)
class TableDef:
    name: str
    columns: tuple[Column_, ...]
    primary_key: str
    unique: tuple[str, ...] = ()
    file_order: tuple[str, ...] = ()  # column order of the CSV file, if not table order
    domains: dict = field(default_factory=dict)     # column -> allowed values
    ranges: dict = field(default_factory=dict)      # column -> (low, high, strict_low)
    foreign_keys: dict = field(default_factory=dict)  # column -> (table, column)

    def struct(self) -> StructType:
        return StructType([StructField(c.name, c.dtype, True) for c in self.columns])

    def file_struct(self) -> StructType:
        by_name = {c.name: c for c in self.columns}
        order = self.file_order or tuple(c.name for c in self.columns if c.in_file)
        return StructType([StructField(n, by_name[n].dtype, True) for n in order])

    def column(self, name: str) -> Column_:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(name)


NOW = "now()"  # marker default: current timestamp at load

# --- fixed values: warehouse DDL -------------------------------------------
DIM_CUSTOMERS = TableDef(
    name="dim_customers",
    columns=(
        Column_("customer_sk", LongType(), False),
        Column_("customer_id", StringType(), False),
        Column_("first_name", StringType(), False, 80),
        Column_("last_name", StringType(), False, 80),
        Column_("email", StringType(), False, 200),
        Column_("phone", StringType(), True, 50),
        Column_("city", StringType(), True, 100),
        Column_("state", StringType(), True, 10),
        Column_("country", StringType(), True, 2),
        Column_("gender", StringType(), True, 10),
        Column_("age", ShortType(), True),
        Column_("loyalty_tier", StringType(), True, 20),
        Column_("registration_date", DateType(), True),
        Column_("is_active", BooleanType(), False, default=True),
        Column_("created_at", TimestampType(), False, default=NOW, in_file=False),
    ),
    primary_key="customer_sk",
    unique=("customer_id", "email"),
    domains={"gender": ("M", "F", "Other"), "loyalty_tier": ("Bronze", "Silver", "Gold", "Platinum")},
    ranges={"age": (18, 120, False)},
)

DIM_PRODUCTS = TableDef(
    name="dim_products",
    columns=(
        Column_("product_sk", LongType(), False),
        Column_("product_id", StringType(), False),
        Column_("product_name", StringType(), False, 200),
        Column_("category", StringType(), False, 80),
        Column_("sub_category", StringType(), True, 80),
        Column_("brand", StringType(), True, 80),
        Column_("unit_cost", D(10, 2), False),
        Column_("unit_price", D(10, 2), False),
        Column_("weight_kg", D(8, 2), True),
        Column_("is_active", BooleanType(), False, default=True),
        Column_("launch_date", DateType(), True),
        Column_("supplier_country", StringType(), True, 2),
        Column_("created_at", TimestampType(), False, default=NOW, in_file=False),
    ),
    primary_key="product_sk",
    unique=("product_id",),
    ranges={"unit_cost": (0, None, False), "unit_price": (0, None, False)},
)

DIM_STORES = TableDef(
    name="dim_stores",
    columns=(
        Column_("store_sk", LongType(), False),
        Column_("store_id", StringType(), False),
        Column_("store_name", StringType(), False, 200),
        Column_("store_type", StringType(), True, 30),
        Column_("city", StringType(), True, 100),
        Column_("state", StringType(), True, 10),
        Column_("country", StringType(), True, 2),
        Column_("region", StringType(), True, 20),
        Column_("sq_footage", IntegerType(), True),
        Column_("open_date", DateType(), True),
        Column_("is_active", BooleanType(), False, default=True),
        Column_("manager_name", StringType(), True, 120),
        Column_("created_at", TimestampType(), False, default=NOW, in_file=False),
    ),
    primary_key="store_sk",
    unique=("store_id",),
    domains={"store_type": ("Flagship", "Express", "Online", "Outlet", "Pop-Up")},
    ranges={"sq_footage": (0, None, True)},
)

DIM_TIME = TableDef(
    name="dim_time",
    columns=(
        Column_("time_sk", IntegerType(), False),
        Column_("full_date", DateType(), False),
        Column_("year", ShortType(), False),
        Column_("quarter", ShortType(), False),
        Column_("month", ShortType(), False),
        Column_("month_name", StringType(), False, 12),
        Column_("week", ShortType(), False),
        Column_("day_of_month", ShortType(), False),
        Column_("day_of_week", ShortType(), False),
        Column_("day_name", StringType(), False, 12),
        Column_("hour", ShortType(), False),
        Column_("is_weekend", BooleanType(), False, default=False),
        Column_("is_holiday", BooleanType(), False, default=False),
        Column_("fiscal_year", ShortType(), False),
        Column_("fiscal_quarter", ShortType(), False),
        Column_("created_at", TimestampType(), False, default=NOW, in_file=False),
    ),
    primary_key="time_sk",
    ranges={
        "quarter": (1, 4, False), "month": (1, 12, False), "week": (1, 53, False),
        "day_of_month": (1, 31, False), "day_of_week": (1, 7, False), "hour": (0, 23, False),
        "fiscal_quarter": (1, 4, False),
    },
)

FACT_SALES = TableDef(
    name="fact_sales",
    columns=(
        Column_("sale_sk", LongType(), False),
        Column_("customer_sk", LongType(), False),
        Column_("product_sk", LongType(), False),
        Column_("store_sk", LongType(), False),
        Column_("time_sk", IntegerType(), False),
        Column_("order_id", StringType(), False),
        Column_("quantity", ShortType(), False),
        Column_("unit_price", D(10, 2), False),
        Column_("unit_cost", D(10, 2), False),
        Column_("discount_pct", D(5, 2), False, default=0),
        Column_("discount_amount", D(10, 2), False, default=0),
        Column_("gross_revenue", D(12, 2), False),
        Column_("net_revenue", D(12, 2), False),
        Column_("total_cost", D(12, 2), False),
        Column_("profit", D(12, 2), False),
        Column_("tax_amount", D(10, 2), False, default=0),
        Column_("shipping_cost", D(8, 2), False, default=0),
        Column_("return_amount", D(10, 2), False, default=0),
        Column_("payment_method", StringType(), True, 30),
        Column_("sales_channel", StringType(), True, 30),
        Column_("return_flag", BooleanType(), False, default=False),
        Column_("created_at", TimestampType(), False, default=NOW, in_file=False),
    ),
    primary_key="sale_sk",
    # the load file lists return_amount last, after return_flag
    file_order=(
        "sale_sk", "customer_sk", "product_sk", "store_sk", "time_sk", "order_id", "quantity",
        "unit_price", "unit_cost", "discount_pct", "discount_amount", "gross_revenue",
        "net_revenue", "total_cost", "profit", "tax_amount", "shipping_cost", "payment_method",
        "sales_channel", "return_flag", "return_amount",
    ),
    ranges={"quantity": (0, None, True), "discount_pct": (0, 100, False)},
    foreign_keys={
        "customer_sk": ("dim_customers", "customer_sk"),
        "product_sk": ("dim_products", "product_sk"),
        "store_sk": ("dim_stores", "store_sk"),
        "time_sk": ("dim_time", "time_sk"),
    },
)
# --- end of fixed values ------------------------------------------------------

STAR_TABLES: dict[str, TableDef] = {
    t.name: t for t in (DIM_CUSTOMERS, DIM_PRODUCTS, DIM_STORES, DIM_TIME, FACT_SALES)
}
