"""Exact decimal metrics against Python's Decimal (HALF_UP), on random data."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillstar.functions.metrics import exact_avg, money_sum, pct

cents = st.integers(min_value=-10**9, max_value=10**9)


def q2(x: Decimal) -> Decimal:
    return x.quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)


@settings(max_examples=15, deadline=None)
@given(st.lists(cents, min_size=1, max_size=30), st.lists(cents, min_size=1, max_size=30))
def test_avg_and_pct_are_exact(spark, xs, ys):
    n = min(len(xs), len(ys))
    rows = [(Decimal(a) / 100, Decimal(b) / 100) for a, b in zip(xs[:n], ys[:n])]
    df = spark.createDataFrame(rows, "x decimal(12,2), y decimal(12,2)")
    r = df.agg(money_sum("x").alias("s"), exact_avg("x").alias("a"),
               pct(F.sum("y"), F.sum("x")).alias("p")).first()
    sx = sum(x for x, _ in rows)
    sy = sum(y for _, y in rows)
    assert r["s"] == sx
    assert r["a"] == q2(sx / n)
    assert r["p"] == (Decimal("0.00") if sx == 0 else q2(sy * 100 / sx))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 10_000_000), st.integers(0, 10), st.integers(0, 8),
                          st.integers(90_000, 100_000), st.integers(1, 50)), min_size=1, max_size=20))
def test_line_measures_match_decimal_arithmetic(spark, lines):
    from pyspark.sql.types import DecimalType

    from tillstar.plans.conform import cost_share, sales_measures

    rows = [(c / 100, d / 100, t / 100, p / 100, q) for c, d, t, p, q in lines]
    df = spark.createDataFrame(rows, "price double, disc double, tax double, retail double, qty int")
    m = sales_measures(
        gross=F.col("price").cast(DecimalType(12, 2)), disc_rate=F.col("disc").cast(DecimalType(5, 2)),
        tax_rate=F.col("tax").cast(DecimalType(5, 2)), share=cost_share(F.col("retail").cast(DecimalType(6, 2))),
        quantity=F.col("qty"), returned=F.lit(False))
    got = df.select(*[c.alias(n) for n, c in m.items()]).collect()
    for (c, d, t, p, q), r in zip(lines, got):
        gross = Decimal(c) / 100
        disc = q2(gross * Decimal(d) / 100)
        net = gross - disc
        cost = q2(gross * (Decimal(p) / 100) * Decimal("0.001"))
        assert r["discount_amount"] == disc and r["net_revenue"] == net
        assert r["total_cost"] == cost and r["profit"] == net - cost
        assert r["tax_amount"] == q2(net * Decimal(t) / 100)
        assert r["unit_price"] == q2(gross / q) and r["unit_cost"] == q2(cost / q)
        assert r["discount_pct"] == Decimal(d) and r["quantity"] == q
