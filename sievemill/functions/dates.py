"""Dates of feeds as native expressions; what is no date gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_instant(c: Column) -> Column:
    """ISO text (without zone: UTC), or a count of seconds or, by its size, milliseconds since 1970."""
    s = F.trim(c)
    n = F.when(s.rlike(r"^\d{1,18}$"), s.try_cast("bigint"))
    n = F.when(n <= 9_000_000_000_000_000, n)  # more milliseconds are no timestamp
    return F.when(n.isNotNull(), F.when(n < 100_000_000_000, F.timestamp_seconds(n)).otherwise(F.timestamp_millis(n))).when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), s.try_cast("timestamp"))


def relative_instant(c: Column, now: Column) -> Column:
    """today, yesterday and 'N days ago' counted back from ``now``."""
    low = F.lower(F.coalesce(c, F.lit("")))
    n = F.regexp_extract(low, r"(\d+)\+?\s*days?", 1).try_cast("int")
    days = F.when(F.contains(low, F.lit("today")), 0).when(F.contains(low, F.lit("yesterday")), 1).otherwise(n)
    return now - F.make_dt_interval(days)


def day_first(c: Column) -> Column:
    """D/M/Y and D-Mon-Y."""
    s = F.trim(c)
    return F.coalesce(F.try_to_timestamp(F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), s), F.lit("d/M/yyyy")), F.try_to_timestamp(F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), s), F.lit("d/M/yy")), F.try_to_timestamp(F.when(s.rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"), s), F.lit("d-MMM-yyyy")))


def freshness(published: Column, now: Column, week: int = 7, *, half_up: bool = False) -> Column:
    """struct<tenths, within_24h, within_7d>, the age in tenths of a day rounded half to even, or half up; an
    instant in the future is not fresh."""
    age = (F.unix_micros(now) - F.unix_micros(published)) / F.lit(1e6)
    inside = lambda days: F.coalesce(age.between(0, days * 86400), F.lit(False))
    tenths = F.floor(age / 86400 * 10 + 0.5).cast("double") if half_up else F.bround(age / 86400 * 10, 0)
    return F.struct(tenths.alias("tenths"), inside(1).alias("within_24h"), inside(week).alias("within_7d"))


def sweep_label(at: Column) -> Column:
    """struct<day, minute> of a sweep: its UTC date and HH:MM."""
    return F.struct(F.date_format(at, "yyyy-MM-dd").alias("day"), F.date_format(at, "HH:mm").alias("minute"))


def sweep_number(at: Column) -> Column:
    """The number of a sweep in its UTC day, two an hour."""
    return F.hour(at) * 2 + F.when(F.minute(at) >= 30, 2).otherwise(1)
