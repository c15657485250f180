"""Percent texts with as many digits as the values of a column need to differ."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics.functions.text import percent_text
from opsmetrics.storage import materialize

# Gaps below the first count as noise, and no text has more decimals.
LEAST_GAP = 2.0 ** -26
MOST_DIGITS = 15


def smallest_gap(df: DataFrame, value: Column) -> tuple[DataFrame, float | None]:
    """The distinct finite values in a column ``value``, stored, and the smallest difference
    between two of them, None with fewer than two.

    Values are cut into ranges; a gap is inside a range, or between the largest value of a
    range and the smallest of the next, of which there is one row per range.
    """
    distinct = materialize(
        df.select(value.cast("double").alias("value"))
        .filter("abs(value) < double('Infinity')").distinct())
    ranged = materialize(
        distinct.repartitionByRange("value").withColumn("_range", F.spark_partition_id()))
    before = F.lag("value").over(Window.partitionBy("_range").orderBy("value"))
    ends = ranged.groupBy("_range").agg(F.min("value").alias("first"), F.max("value").alias("last"))
    between = F.col("first") - F.lag("last").over(Window.orderBy("_range"))
    gaps = (ranged.select((F.col("value") - before).alias("gap"))
            .union(ends.select(between.alias("gap"))))
    return ranged.select("value"), gaps.agg(F.min("gap")).first()[0]


def percent_digits(df: DataFrame, ratio: Column | str) -> int:
    """Decimals that percent texts of the whole column need.

    The smallest gap between two different finite percentages, cut to a power of ten, is
    resolved to a tenth of it; if at that unit every percentage ends in zero, the last digit
    goes. Never fewer than none: whole percentages, also with fewer than two different values
    or a gap that is noise. Missing and non-finite values take no part. This runs jobs.
    """
    percent = (F.col(ratio) if isinstance(ratio, str) else ratio) * 100
    values, gap = smallest_gap(df, percent)
    if gap is None or gap < LEAST_GAP:
        return 0
    digits = 1 - math.floor(math.log10(gap))
    scale = float(f"1e{digits}")
    in_use = values.filter(F.bround(F.col("value") * scale, 0) % 10 != 0).limit(1).count()
    return min(max(digits if in_use else digits - 1, 0), MOST_DIGITS)


def with_percent_text(df: DataFrame, ratio: str, name: str) -> DataFrame:
    """``df`` with the percentages of ``ratio`` as texts in ``name``, all of the digits that
    :func:`percent_digits` finds for the column. ``df`` is read again for them."""
    return df.withColumn(name, percent_text(ratio, percent_digits(df, ratio)))
