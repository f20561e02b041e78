from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from tillstar.functions import formatting as fmt


def test_formats(spark):
    df = spark.createDataFrame(
        [(Decimal("1234.5"), Decimal("12.345"), Decimal("1.2"), 12_345_678.0, 1234, 86400 * 365, "big red", None)],
        "m decimal(12,2), p decimal(12,3), s decimal(12,2), big double, n int, e long, a string, b string",
    )
    r = df.select(
        fmt.money("m").alias("m"), fmt.percent("p").alias("p"), fmt.signed_percent("s").alias("s"),
        fmt.signed_percent(F.lit(-3.4)).alias("neg"), fmt.millions("big").alias("big"),
        fmt.thousands("n").alias("n"), fmt.epoch_date_text("e").alias("e"),
        fmt.composed_name("a", "b", F.lit("store"), title_case=True).alias("name"),
    ).first()
    assert r["m"] == "$1,234.50"
    assert r["p"] == "12.35%"          # HALF_UP on the exact decimal
    assert r["s"] == "+1.20%" and r["neg"] == "-3.40%"
    assert r["big"] == "$12.3M"
    assert r["n"] == "1,234"
    assert r["e"] == "1971-01-01"
    assert r["name"] == "Big Red Store"


def test_formatted_keeps_nulls_and_order(spark):
    df = spark.createDataFrame([(1, Decimal("5.00"), None)], "k int, total_revenue decimal(12,2), mom_revenue_chg decimal(12,2)")
    out = fmt.formatted(df, fmt.TREND_TABLE_FORMATS)
    assert out.columns == ["k", "total_revenue", "mom_revenue_chg"]
    assert tuple(out.first()) == (1, "$5.00", None)
