from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from tillstar.plans.calendar import hourly_calendar  # noqa: E402
from tillstar.schema import DIM_CUSTOMERS, DIM_PRODUCTS, DIM_STORES, FACT_SALES, TableDef  # noqa: E402
from tillstar.session import local_session  # noqa: E402
from tillstar.star import Star  # noqa: E402

CAL_START = dt.datetime(2018, 1, 1)


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=2, shuffle_partitions=4, app="tillstar-tests")
    yield s
    s.stop()


def D(x) -> Decimal:
    return Decimal(str(x))


def time_sk(ts: dt.datetime) -> int:
    return int((ts - CAL_START).total_seconds() // 3600) + 1


def frame(spark, table: TableDef, rows: list[dict]):
    """DataFrame with the table's full schema; missing columns get DEFAULT or NULL."""
    struct = table.struct()
    defaults = {c.name: (dt.datetime.now() if c.default == "now()" else c.default) for c in table.columns}
    data = []
    for r in rows:
        rec = []
        for c in table.columns:
            v = r.get(c.name, defaults[c.name])
            if v is not None and type(c.dtype).__name__ == "DecimalType":
                v = D(v)
            rec.append(v)
        data.append(tuple(rec))
    return spark.createDataFrame(data, struct)


def sale(sale_sk, customer_sk=1, product_sk=1, store_sk=1, when=dt.datetime(2018, 1, 15),
         order_id=None, quantity=1, net=100, profit=10, discount_pct=0, channel="Web",
         returned=False, unit_price=None, cost=None, **extra) -> dict:
    net, profit = D(net), D(profit)
    cost = D(cost) if cost is not None else net - profit
    row = dict(
        sale_sk=sale_sk, customer_sk=customer_sk, product_sk=product_sk, store_sk=store_sk,
        time_sk=time_sk(when), order_id=order_id or f"o{sale_sk}", quantity=quantity,
        unit_price=D(unit_price) if unit_price is not None else net / quantity if quantity else net,
        unit_cost=cost / quantity if quantity else cost, discount_pct=D(discount_pct),
        discount_amount=D(0), gross_revenue=net, net_revenue=net, total_cost=cost, profit=profit,
        tax_amount=D(0), shipping_cost=D(0), return_amount=D(0), payment_method="Card",
        sales_channel=channel, return_flag=returned,
    )
    row["unit_price"] = D(row["unit_price"]).quantize(Decimal("0.01"))
    row["unit_cost"] = D(row["unit_cost"]).quantize(Decimal("0.01"))
    row.update(extra)
    return row


def make_star(spark, sales: list[dict], products=None, customers=None, stores=None, hours=24 * 800) -> Star:
    products = products if products is not None else [
        dict(product_sk=i, product_id=f"p{i}", product_name=f"Product {i}", category=f"Cat{(i - 1) % 3}",
             brand="B", unit_cost=1, unit_price=2) for i in range(1, 6)]
    customers = customers if customers is not None else [
        dict(customer_sk=i, customer_id=f"c{i}", first_name=f"First{i}", last_name=f"Last{i}",
             email=f"c{i}@x.org", country="US", age=20 + i, loyalty_tier="Gold") for i in range(1, 6)]
    stores = stores if stores is not None else [
        dict(store_sk=i, store_id=f"s{i}", store_name=f"Store {i}", country="US", region="North")
        for i in range(1, 4)]
    cal = hourly_calendar(spark, CAL_START, hours)
    from pyspark.sql import functions as F

    return Star(
        fact=frame(spark, FACT_SALES, sales),
        customers=frame(spark, DIM_CUSTOMERS, customers),
        products=frame(spark, DIM_PRODUCTS, products),
        stores=frame(spark, DIM_STORES, stores),
        time=cal.drop("ts").withColumn("created_at", F.current_timestamp()),
    )
