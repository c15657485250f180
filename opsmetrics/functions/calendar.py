"""Calendar columns that differ from Spark's ISO built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_number(day: Column | str) -> Column:
    """Seven-day blocks counted from 1 January (1..53), not the ISO week."""
    return (F.floor((F.dayofyear(day) - 1) / 7) + 1).cast("int")


def week_end_saturday(day: Column | str) -> Column:
    """Saturday on or after the day: the end of its Sunday-to-Saturday week."""
    return F.date_sub(F.next_day(day, "SUN"), 1)


def year_month(day: Column | str) -> Column:
    """Month key such as 201706."""
    return (F.year(day) * 100 + F.month(day)).cast("int")


def month_name(day: Column | str) -> Column:
    """Full English month name."""
    return F.date_format(day, "MMMM")
