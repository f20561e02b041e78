"""Hour-grain calendar dimension.

One row per hour with calendar attributes, an October fiscal year (fiscal
quarter stays the calendar quarter), weekend and holiday flags.
``hourly_calendar(start, periods)`` numbers its hours 1..N, as the
warehouse's load file does; ``calendar_covering`` (built from data) keys
each hour by its offset from a fixed epoch, so keys are stable across loads
and a fact computes its key without a lookup.  Everything is built-in:
``range`` or ``sequence``/``explode`` for the hours, ``date_format``,
``weekofyear`` (ISO week) and ``weekday`` for the attributes.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the fiscal year starts in this month (year + 1 from then on).
FISCAL_YEAR_START_MONTH = 10

CALENDAR_COLUMNS = (
    "time_sk", "full_date", "year", "quarter", "month", "month_name", "week", "day_of_month",
    "day_of_week", "day_name", "hour", "is_weekend", "is_holiday", "fiscal_year",
    "fiscal_quarter",
)


def _attributes(ts: Column) -> list[Column]:
    small = "smallint"
    year, month, quarter = F.year(ts), F.month(ts), F.quarter(ts)
    weekday0 = F.weekday(ts)  # 0 = Monday .. 6 = Sunday
    return [
        F.to_date(ts).alias("full_date"),
        year.cast(small).alias("year"),
        quarter.cast(small).alias("quarter"),
        month.cast(small).alias("month"),
        F.date_format(ts, "MMMM").alias("month_name"),
        F.weekofyear(ts).cast(small).alias("week"),
        F.dayofmonth(ts).cast(small).alias("day_of_month"),
        (weekday0 + 1).cast(small).alias("day_of_week"),
        F.date_format(ts, "EEEE").alias("day_name"),
        F.hour(ts).cast(small).alias("hour"),
        (weekday0 >= 5).alias("is_weekend"),
        F.lit(False).alias("is_holiday"),
        F.when(month >= FISCAL_YEAR_START_MONTH, year + 1).otherwise(year).cast(small).alias("fiscal_year"),
        quarter.cast(small).alias("fiscal_quarter"),
    ]


def hourly_calendar(spark: SparkSession, start: _dt.datetime | str, periods: int) -> DataFrame:
    """``periods`` consecutive hours from ``start`` (``pd.date_range(start,
    periods=n, freq='h')``).  Rows come from ``spark.range``, so the
    calendar is generated in parallel."""
    start_ts = F.lit(str(start)).cast("timestamp_ntz")
    hours = spark.range(0, periods).select(
        (F.col("id") + 1).cast("int").alias("time_sk"),
        (start_ts + F.make_dt_interval(hours=F.col("id"))).alias("ts"),
    )
    return _finish(hours)


# Fixed value: origin of the hour keys of data-derived calendars.
HOUR_KEY_EPOCH = "1970-01-01"


def hour_key(ts: Column) -> Column:
    """``time_sk`` of a TIMESTAMP_NTZ: hours from ``HOUR_KEY_EPOCH`` to the hour that
    holds ``ts``.  Built from the date and the hour as written, so the session time
    zone plays no part: a fact gets its calendar key without a join, and keys
    never change when later loads widen the calendar."""
    days = F.datediff(F.to_date(ts), F.lit(HOUR_KEY_EPOCH).cast("date"))
    return (days * 24 + F.hour(ts)).cast("int")


def hour_keys_of_year(year: int) -> tuple[int, int]:
    """First and last ``hour_key`` of a year."""
    epoch = _dt.date.fromisoformat(HOUR_KEY_EPOCH)
    first = (_dt.date(year, 1, 1) - epoch).days * 24
    return first, (_dt.date(year, 12, 31) - epoch).days * 24 + 23


def calendar_covering(df: DataFrame, ts_col: str) -> DataFrame:
    """Hourly calendar from midnight of the earliest day to 23:00 of the latest
    day found in ``df[ts_col]``, keyed by ``hour_key``.

    The range comes from one partial/final ``min``/``max`` aggregate; the rows
    from ``explode(sequence(...))`` of that single row, so its size is the
    number of hours in the span (not the size of ``df``).
    """
    ts = F.col(ts_col)
    span = df.agg(
        F.to_date(F.min(ts)).cast("timestamp_ntz").alias("lo"),
        (F.to_date(F.max(ts)).cast("timestamp_ntz") + F.expr("INTERVAL 23 HOURS")).alias("hi"),
    )
    hours = span.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("ts"))
    hours = hours.select(hour_key(F.col("ts")).alias("time_sk"), "ts")
    return _finish(hours)


def _finish(hours: DataFrame) -> DataFrame:
    return hours.select("time_sk", "ts", *_attributes(F.col("ts")))


# --- computed holidays ----------------------------------------------------------
def fixed_day(month: int, day: int) -> Callable[[Column], Column]:
    """The same day each year."""
    return lambda d: (F.month(d) == month) & (F.dayofmonth(d) == day)


def nth_weekday(month: int, weekday: int, n: int) -> Callable[[Column], Column]:
    """The n-th ``weekday`` (1 = Monday .. 7 = Sunday) of a month; the last one for n = -1, and so on."""
    def rule(d: Column) -> Column:
        day = F.dayofmonth(d)
        from_end = F.dayofmonth(F.last_day(d)) - day
        week = F.ceil(day / 7) if n > 0 else F.floor(from_end / 7) + 1
        return (F.month(d) == month) & (F.weekday(d) + 1 == weekday) & (week == abs(n))

    return rule


def easter_sunday(year: Column) -> Column:
    """Easter Sunday of a Gregorian year, by the computus (golden number, century corrections, full
    moon, following Sunday) in whole numbers."""
    y = year.cast("int")

    def div(a: Column, b: int) -> Column:
        return F.floor(a / b)

    golden, century, rest = y % 19, div(y, 100), y % 100
    skipped_leap, moon = div(century, 4), div(century - div(century + 8, 25) + 1, 3)
    epact = (golden * 19 + century - skipped_leap - moon + 15) % 30
    sunday = (F.lit(32) + century % 4 * 2 + div(rest, 4) * 2 - epact - rest % 4) % 7
    late = div(golden + epact * 11 + sunday * 22, 451)
    days = epact + sunday - late * 7 + 114
    return F.make_date(y, div(days, 31).cast("int"), (days % 31 + 1).cast("int"))


def easter_offset(days: int) -> Callable[[Column], Column]:
    """So many days after Easter Sunday (before, if negative)."""
    return lambda d: F.datediff(d, easter_sunday(F.year(d))) == days


# The default list, most of it the federal holidays of the United States.
HOLIDAYS: dict[str, Callable[[Column], Column]] = {
    "New Year's Day": fixed_day(1, 1),
    "Martin Luther King Day": nth_weekday(1, 1, 3),
    "Presidents' Day": nth_weekday(2, 1, 3),
    "Good Friday": easter_offset(-2),
    "Easter Monday": easter_offset(1),
    "Memorial Day": nth_weekday(5, 1, -1),
    "Independence Day": fixed_day(7, 4),
    "Labor Day": nth_weekday(9, 1, 1),
    "Columbus Day": nth_weekday(10, 1, 2),
    "Veterans Day": fixed_day(11, 11),
    "Thanksgiving": nth_weekday(11, 4, 4),
    "Christmas Day": fixed_day(12, 25),
}


def holiday_name(date: Column, rules: dict[str, Callable[[Column], Column]] | None = None) -> Column:
    """Name of the first rule that holds on the day, NULL on other days: plain column arithmetic, for any years."""
    rules = HOLIDAYS if rules is None else rules
    return F.coalesce(F.lit(None).cast("string"), *[F.when(rule(date), F.lit(name)) for name, rule in rules.items()])


def with_computed_holidays(calendar: DataFrame, rules: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Set ``is_holiday`` from rules."""
    return calendar.withColumn("is_holiday", holiday_name(F.col("full_date"), rules).isNotNull())


def with_holidays(calendar: DataFrame, holidays: DataFrame, date_col: str = "holiday_date") -> DataFrame:
    """Set ``is_holiday`` from a caller-supplied list of dates (left join on
    the date; dates not listed stay FALSE)."""
    days = holidays.select(F.col(date_col).cast("date").alias("full_date")).distinct()
    days = days.withColumn("_holiday", F.lit(True))
    out = calendar.drop("is_holiday").join(days, "full_date", "left")
    out = out.withColumn("is_holiday", F.coalesce(F.col("_holiday"), F.lit(False))).drop("_holiday")
    return out.select(*calendar.columns)
