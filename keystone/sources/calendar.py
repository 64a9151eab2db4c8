"""Calendar dimension with weekend and US-holiday flags.

Built from ``spark.range`` (one row per day, spread over tasks) and column
expressions only; no Python date loop.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _nth_weekday(d: Column, month: int, weekday: int, n: int) -> Column:
    """d is the n-th given weekday (0=Mon) of ``month``: day-of-month in [7n-6, 7n]."""
    dom = F.dayofmonth(d)
    return ((F.month(d) == month) & (F.weekday(d) == weekday)
            & dom.between(7 * (n - 1) + 1, 7 * n))


def _last_weekday(d: Column, month: int, weekday: int) -> Column:
    """d is the last given weekday of ``month``: no same weekday 7 days later in it."""
    return ((F.month(d) == month) & (F.weekday(d) == weekday)
            & (F.month(F.date_add(d, 7)) != month))


def us_holiday(d: Column) -> Column:
    """The eight fixed and floating US federal holidays used by the model."""
    m, dom = F.month(d), F.dayofmonth(d)
    return ((m == 1) & (dom == 1)                 # New Year's Day
            | _nth_weekday(d, 1, 0, 3)            # 3rd Monday of January
            | _nth_weekday(d, 2, 0, 3)            # 3rd Monday of February
            | _last_weekday(d, 5, 0)              # last Monday of May
            | (m == 7) & (dom == 4)               # Independence Day
            | _nth_weekday(d, 9, 0, 1)            # 1st Monday of September
            | _nth_weekday(d, 11, 3, 4)           # 4th Thursday of November
            | (m == 12) & (dom == 25))            # Christmas Day


def holiday_name(d: Column) -> Column:
    """Name of the holiday on ``d`` (NULL on other days)."""
    m, dom = F.month(d), F.dayofmonth(d)
    return (F.when((m == 1) & (dom == 1), "New Year's Day")
            .when(_nth_weekday(d, 1, 0, 3), "Martin Luther King Jr. Day")
            .when(_nth_weekday(d, 2, 0, 3), "Presidents' Day")
            .when(_last_weekday(d, 5, 0), "Memorial Day")
            .when((m == 7) & (dom == 4), "Independence Day")
            .when(_nth_weekday(d, 9, 0, 1), "Labor Day")
            .when(_nth_weekday(d, 11, 3, 4), "Thanksgiving Day")
            .when((m == 12) & (dom == 25), "Christmas Day"))


def calendar_columns(d: Column) -> list[Column]:
    """Year, quarter, month, month name, ISO week, weekday (0=Mon), flags."""
    return [
        d.alias("date"),
        F.year(d).alias("year"),
        F.quarter(d).alias("quarter"),
        F.month(d).alias("month"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.weekofyear(d).alias("week"),
        F.weekday(d).alias("day_of_week"),
        (F.weekday(d) >= 5).alias("is_weekend"),
        us_holiday(d).alias("is_holiday"),
    ]


def calendar_dates(spark: SparkSession, start: _dt.date, end: _dt.date) -> DataFrame:
    """One row per day in [start, end] (empty when end < start)."""
    n = max((end - start).days + 1, 0)
    d = F.date_add(F.lit(start), F.col("id").cast("int"))
    return spark.range(n).select(*calendar_columns(d))


def calendar_for_span(df: DataFrame, date_col: str) -> DataFrame:
    """N1 over data: every day from the first to the last ``date_col`` of ``df``.

    The span comes from one partial aggregate; the day rows are one exploded
    sequence, bounded by the calendar span rather than by the data volume.
    """
    span = df.agg(F.min(F.col(date_col).cast("date")).alias("lo"),
                  F.max(F.col(date_col).cast("date")).alias("hi"))
    days = span.where(F.col("lo").isNotNull()).select(
        F.explode(F.sequence("lo", "hi")).alias("d"))
    return days.select(*calendar_columns(F.col("d")))
