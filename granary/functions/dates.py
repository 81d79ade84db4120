"""Buckets and bounds of time; "now" is always given, never read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def week(ts: Column) -> Column:
    """Year and week as one number: weeks start on Sunday, days before a year's first Sunday belong to the last week before it."""
    d = F.to_date(ts)
    sunday = F.date_sub(d, F.dayofweek(d) - 1)
    return (F.year(sunday) * 100 + F.floor((F.dayofyear(sunday) - 1) / 7) + 1).cast("string")


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


PERIODS = {"day": day, "week": week, "month": month}


def within_days(ts: Column, start: str | None, end: str | None) -> Column:
    """Closed range of dates; the last second of the end date is in it, fractions after that are not."""
    keep = F.lit(True)
    if start:
        keep = keep & (ts >= F.lit(start).cast("timestamp_ntz"))
    if end:
        keep = keep & (ts <= F.lit(f"{end} 23:59:59").cast("timestamp_ntz"))
    return keep


def expires(now: Column, minutes: int) -> Column:
    return now + F.make_interval(mins=F.lit(minutes))
