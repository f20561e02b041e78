"""Top-N, first-row-per-group and previous-row change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillstar.functions.metrics import pct


def top_n(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """``ORDER BY <order> LIMIT n``.

    Catalyst plans it as ``TakeOrderedAndProject``: every partition keeps its
    own best ``n`` and only those reach the final merge, so no full sort.
    Pass a unique key as the last sort column to make ties deterministic.
    """
    if n < 0:
        raise ValueError(f"top-N size must be >= 0, got {n}")
    return df.orderBy(*order).limit(n)


def first_per_group(
    df: DataFrame, keys: Sequence[str], value: str, rank: Sequence[Column], alias: str | None = None
) -> DataFrame:
    """``DISTINCT ON (keys) value ORDER BY keys, <rank>``.

    ``rank`` columns order rows best-first in ascending order (negate a metric
    to prefer large values).  Implemented as one aggregate,
    ``min_by(value, struct(rank))``: it keeps a single best row per group
    and is partially aggregated before the shuffle (Spark runs a struct
    ordering as a sort-based aggregate, which spills), so no per-group row
    list is ever built and a hot key is reduced map-side.
    """
    return df.groupBy(*keys).agg(F.min_by(F.col(value), F.struct(*rank)).alias(alias or value))


def change_pct_vs_previous(value: str, order: Sequence[str]) -> Column:
    """``(v - LAG(v)) / LAG(v) * 100`` rounded to 2, NULL if the previous row
    is missing or zero.  The window has no partition, so use it only on small
    frames (one row per month)."""
    prev = F.lag(F.col(value)).over(Window.orderBy(*order))
    return F.when(prev.isNull() | (prev == 0), F.lit(None)).otherwise(
        pct(F.col(value) - prev, prev, zero_is_null=True)
    )


def sorted_by(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Re-sort a (small) result frame by one column, NULLs last either way,
    ties by the frame's first column -- how the dashboard re-orders its
    top-N frames for each chart."""
    c = F.col(column)
    key = c.asc_nulls_last() if ascending else c.desc_nulls_last()
    return df.orderBy(key, F.col(df.columns[0]).asc_nulls_last())
