"""Display formatting of report columns, as built-in string expressions.

``$1,234.50`` (money), ``12.34%`` (percent), ``+1.20%`` (signed percent),
``$12.3M`` (millions), ``1,234`` (thousands), and ISO dates / composed
names for load files.  Values are rounded HALF_UP before formatting.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _fixed(x: Column, places: int) -> Column:
    """Exact HALF_UP rounding to ``places``, as text with exactly that many places."""
    return F.round(x, places).cast(DecimalType(38, places)).cast("string")


def money(col: str | Column, places: int = 2) -> Column:
    """``$1,234.50`` (rounded HALF_UP first, so the grouping formatter has
    nothing left to round)."""
    return F.concat(F.lit("$"), F.format_number(F.round(_c(col), places), places))


def percent(col: str | Column, places: int = 2) -> Column:
    """``12.34%``."""
    return F.concat(_fixed(_c(col), places), F.lit("%"))


def signed_percent(col: str | Column, places: int = 2) -> Column:
    """``+1.20%`` / ``-3.40%``."""
    x = _c(col)
    return F.concat(F.when(x >= 0, F.lit("+")).otherwise(F.lit("")), _fixed(x, places), F.lit("%"))


def millions(col: str | Column, places: int = 1) -> Column:
    """``$12.3M``."""
    return F.format_string(f"$%.{places}fM", _c(col).cast("double") / 1e6)


def thousands(col: str | Column) -> Column:
    """``1,234``."""
    return F.format_number(_c(col), 0)


def epoch_date_text(col: str | Column) -> Column:
    """Epoch seconds -> ``yyyy-MM-dd`` (UTC session zone)."""
    return F.date_format(F.to_date(F.timestamp_seconds(_c(col))), "yyyy-MM-dd")


def composed_name(*parts: str | Column, title_case: bool = False) -> Column:
    """Space-joined name parts (NULL parts skipped), optionally Title Cased."""
    name = F.concat_ws(" ", *[_c(p) for p in parts])
    return F.initcap(name) if title_case else name


# How the dashboard's raw-data tables format each column.
PRODUCT_TABLE_FORMATS: dict[str, Callable[[str], Column]] = {
    "total_revenue": money, "total_profit": money, "total_cost": money, "avg_unit_price": money,
    "profit_margin": percent, "avg_discount_pct": percent,
}
TREND_TABLE_FORMATS: dict[str, Callable[[str], Column]] = {
    "total_revenue": money, "total_profit": money, "total_cost": money, "avg_order_value": money,
    "return_rate": percent, "mom_revenue_chg": signed_percent,
}
CUSTOMER_TABLE_FORMATS: dict[str, Callable[[str], Column]] = {
    "total_revenue": money, "total_profit": money, "avg_order_value": money,
}


def formatted(df: DataFrame, formats: Mapping[str, Callable[[str], Column]]) -> DataFrame:
    """``df`` with the listed columns replaced by their display text
    (NULL stays NULL); other columns unchanged, order kept."""
    return df.select(*[
        F.when(F.col(c).isNotNull(), formats[c](c)).alias(c) if c in formats else F.col(c)
        for c in df.columns
    ])
