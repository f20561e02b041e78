"""Column builders for the star's measures and report figures.

All money stays DECIMAL from the fact to the result; every average and
percentage is an exact decimal division followed by one HALF_UP rounding
(what PostgreSQL NUMERIC does).  Spark's built-in ``avg`` on decimals rounds
to ``scale + 4`` first, so ``exact_avg`` divides ``sum`` by ``count`` itself.

Operand types are chosen so Spark keeps at least 12 fractional digits in the
quotient before the final rounding (decimal results are capped at 38 digits,
and a wide operand eats the scale).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

# Output types of the report columns.
MONEY = DecimalType(22, 2)       # sums, averages and percentages with 2 places
ONE_PLACE = DecimalType(22, 1)   # ROUND(..., 1) outputs (average age)
_OPERAND = DecimalType(22, 2)    # money operand of a post-aggregate ratio
_COUNT_OPERAND = DecimalType(20, 0)


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def money_sum(col: str | Column) -> Column:
    """``ROUND(SUM(x), 2)`` on a 2-place decimal: exact, NULL on no rows."""
    return F.sum(_c(col)).cast(MONEY)


def int_sum(col: str | Column) -> Column:
    """``SUM(int)::BIGINT``."""
    return F.sum(_c(col)).cast("bigint")


def flag_count(col: str | Column) -> Column:
    """``SUM(CASE WHEN flag THEN 1 ELSE 0 END)``: counts TRUE rows, NULL on no rows."""
    return F.sum(F.when(_c(col), F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def exact_avg(col: str | Column, scale: int = 2) -> Column:
    """``ROUND(AVG(x), scale)`` without intermediate rounding; NULLs ignored.

    ``x`` is an integer or a decimal with at most 2 places.  The aggregate is
    the plain ``sum(x)``, so it is shared with a ``money_sum(x)`` in the same
    ``agg``; the quotient keeps 18 fractional digits before the rounding.
    """
    x = _c(col)
    n = F.count(x)
    total = F.sum(x).cast(_OPERAND)
    return F.when(n > 0, F.round(total / n, scale)).cast(DecimalType(22, scale))


def avg_of_sums(total: str | Column, n: str | Column, scale: int = 2) -> Column:
    """Average rebuilt from pre-aggregated ``sum`` and ``count`` columns."""
    t, k = _c(total), _c(n)
    return F.when(k > 0, F.round(t.cast(_OPERAND) / k.cast(_COUNT_OPERAND), scale)).cast(
        DecimalType(22, scale)
    )


def pct(num: str | Column, den: str | Column, zero_is_null: bool = False) -> Column:
    """``ROUND(CASE WHEN den = 0 THEN <zero> ELSE num / den * 100 END, 2)``.

    A zero denominator yields 0 (margins, rates) or, with ``zero_is_null``,
    NULL (month-over-month change, shares).  Money operands are narrowed to
    DECIMAL(22,2) so the quotient keeps 12 fractional digits.
    """
    n, d = _c(num).cast(_OPERAND), _c(den).cast(_OPERAND)
    zero_value = F.lit(None) if zero_is_null else F.lit(0)
    return F.round(F.when(d == 0, zero_value.cast(MONEY)).otherwise(n * 100 / d), 2).cast(MONEY)


def count_pct(num: str | Column, den: str | Column) -> Column:
    """``ROUND(CASE WHEN den = 0 THEN 0 ELSE num::NUMERIC / den * 100 END, 2)`` for counts."""
    n, d = _c(num).cast(_COUNT_OPERAND), _c(den).cast(_COUNT_OPERAND)
    return F.round(F.when(d == 0, F.lit(0).cast(MONEY)).otherwise(n * 100 / d), 2).cast(MONEY)


def share_pct(col: str | Column) -> Column:
    """Share of the column total, in percent, over a small result frame.

    Uses an un-partitioned window, so call it only on bounded results
    (top-N frames, a handful of categories or channels).
    """
    from pyspark.sql import Window

    x = _c(col)
    return pct(x, F.sum(x).over(Window.partitionBy()), zero_is_null=True)


def weighted_mean(value: str | Column, weight: str | Column) -> Column:
    """``ROUND(SUM(value * weight) / SUM(weight), 2)``; NULL when weights sum to 0.

    The rounding is done on whole numbers, so no quotient is cut before it: with
    value x weight sums in units of 0.0001 and weights in 0.01, the result in cents is
    (2 n + d) div 2 d for n, d > 0, away from zero.
    """
    v, w = _c(value).cast(_OPERAND), _c(weight).cast(_OPERAND)
    whole = DecimalType(38, 0)
    n = (F.sum(v * w) * 10000).cast(whole)   # 1/10000
    d = (F.sum(w) * 100).cast(whole)         # cents
    sign = F.when((n < 0) != (d < 0), F.lit(-1)).otherwise(F.lit(1))
    cents = F.floor((F.abs(n) - F.abs(n) % F.abs(d)) / F.abs(d)) + F.when(2 * (F.abs(n) % F.abs(d)) >= F.abs(d), 1).otherwise(0)
    return F.when(d != 0, (cents * sign).cast(DecimalType(24, 0)) / 100).cast(MONEY)


def report_types(df: DataFrame) -> DataFrame:
    """Cast DECIMAL result columns to DOUBLE for display / comparison.

    The values were already rounded exactly in decimal, so the double is the
    nearest binary value to the exact 2-place result.
    """
    cols = [
        F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType)
        else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)
