"""Date helpers: day differences, day windows, month cohorts."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampType

from churnlab.config import DayWindow


def day_diff(later: Column, earlier: Column) -> Column:
    """Whole days from ``earlier`` to ``later`` (null if either is null)."""
    return F.datediff(later, earlier)


def in_window(later: Column, earlier: Column, window: DayWindow) -> Column:
    """``later`` falls inside ``window`` days after ``earlier``.

    Both are dates, so "strictly later" is a difference of at least one day;
    a null on either side is never inside.
    """
    days = day_diff(later, earlier)
    if window.max_days is None:
        return days >= window.min_days
    return days.between(window.min_days, window.max_days)


def in_year(date: Column, year: int) -> Column:
    """The date is in the year, as a range: unlike ``year(date) = y`` it reaches the
    scan, so files and row groups outside are skipped."""
    return (date >= F.lit(datetime.date(year, 1, 1))) & (date < F.lit(datetime.date(year + 1, 1, 1)))


def utc_day(ts: Column) -> Column:
    """Calendar day of a zoned timestamp in UTC, whatever the session zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(ts) / F.lit(86400)).cast("int"))


def to_day(col: Column, dtype: DataType) -> Column:
    """``DATE(x)``: wall-clock day for dates and zone-less timestamps, UTC day
    for zoned timestamps."""
    if isinstance(dtype, TimestampType):
        return utc_day(col)
    return F.to_date(col)


def cohort(date: Column, kind: str = "month") -> Column:
    """Group key of an event date, as bigint.

    ``month`` is the month number alone (years merge, as in the scripts);
    ``year_month`` is ``yyyymm``.
    """
    if kind == "month":
        return F.month(date).cast("bigint")
    if kind == "year_month":
        return (F.year(date) * 100 + F.month(date)).cast("bigint")
    raise ValueError(f"unknown cohort {kind!r}")
