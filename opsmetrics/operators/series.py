"""Daily, weekly and monthly totals and the time-based columns over them.

Totals accept raw call rows or the agent-day fact: sums of sums are the same, and raw
rows spare a shuffle. Windows without a partition run only over tables bounded by the
calendar (53 week numbers).
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics.functions.calendar import month_name, week_end_saturday, week_number
from opsmetrics.functions.numbers import safe_ratio
from opsmetrics.functions.text import label, percent_text


def calls_per_day(df: DataFrame) -> DataFrame:
    """Calls per date with a display label."""
    days = df.groupBy("call_date").agg(F.sum("calls").alias("calls"))
    return days.withColumn("label_text", label("Date: {call_date}\nCalls: {calls}"))


def calls_weekly(df: DataFrame, by_year: bool = False) -> DataFrame:
    """Calls per week number; by default the same week of all years is pooled."""
    keys = [F.year("call_date").alias("year")] if by_year else []
    return (df.groupBy(*keys, week_number("call_date").alias("week_num"))
              .agg(F.sum("calls").alias("calls")))


def pct_change(order_by: str, value: str = "calls",
               zero: str = "null") -> Callable[[DataFrame], DataFrame]:
    """For ``DataFrame.transform``: change from the row before in ``order_by``.

    The first row is compared with itself. One window over the whole input: give it
    an aggregated series.
    """
    def apply(df: DataFrame) -> DataFrame:
        before = F.lag(value, 1).over(Window.orderBy(order_by))
        return (
            df.withColumn(f"{value}_lag_1", F.coalesce(before, F.col(value)))
            .withColumn("diff_1", F.col(value) - F.col(f"{value}_lag_1"))
            .withColumn("pct_diff_1", safe_ratio("diff_1", f"{value}_lag_1", zero))
            .withColumn("pct_diff_1_chr", percent_text("pct_diff_1")))
    return apply


def trailing_mean(value: str, k: int, window, head: float | None = None) -> Column:
    """Mean of the last ``k`` rows; NULL where one of them is missing. Rows before
    the ``k``-th get ``head``. Rows are counted, not calendar steps.

    A sum of lags: a missing row or value makes it NULL without counting.
    """
    rows = [F.col(value), *[F.lag(value, back).over(window) for back in range(1, k)]]
    complete = reduce(operator.add, rows) / F.lit(float(k))
    if head is None:
        return complete
    return F.when(F.row_number().over(window) < k, F.lit(head)).otherwise(complete)


def calls_weekly_rolling(weekly: DataFrame) -> DataFrame:
    """Two- and four-week trailing means, zero until enough weeks are seen. With a
    ``year`` the weeks of one year follow those of the year before."""
    window = Window.orderBy(*[c for c in ("year", "week_num") if c in weekly.columns])
    return weekly.withColumns({
        "roll_mean_2": trailing_mean("calls", 2, window, head=0.0),
        "roll_mean_4": trailing_mean("calls", 4, window, head=0.0)})


def calls_monthly(df: DataFrame) -> DataFrame:
    """Calls per year and month."""
    return (
        df.groupBy(F.year("call_date").alias("year"),
                   F.month("call_date").alias("month_num"),
                   month_name("call_date").alias("month"))
        .agg(F.sum("calls").alias("calls")))


def calls_monthly_vs_first(monthly: DataFrame, zero: str = "null") -> DataFrame:
    """Change from the first month of the same year."""
    whole_year = (Window.partitionBy("year").orderBy("month_num")
                  .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (
        monthly.withColumn("calls_first", F.first("calls").over(whole_year))
        .withColumn("diff_first", F.col("calls") - F.col("calls_first"))
        .withColumn("pct_diff_first", safe_ratio("diff_first", "calls_first", zero))
        .withColumn("pct_diff_first_chr", percent_text("pct_diff_first")))


def calls_monthly_cumulative(monthly: DataFrame) -> DataFrame:
    """Running calls within each year."""
    return monthly.withColumn("cumulative_calls", _running("calls", "year", "month_num"))


def calls_cumulative_by_month(monthly: DataFrame) -> DataFrame:
    """Running calls of the same month across years."""
    return monthly.withColumn("cumulative_calls", _running("calls", "month_num", "year"))


def _running(value: str, within: str, order_by: str) -> Column:
    return F.sum(value).over(Window.partitionBy(within).orderBy(order_by)
                             .rowsBetween(Window.unboundedPreceding, Window.currentRow))


def weekly_offers_rolling3(df: DataFrame) -> DataFrame:
    """Offers applied per lead, agent and week, with a three-week trailing mean.

    Weeks are summed before the window, so a window partition holds one row per
    calendar week however many calls the agent has.
    """
    weeks = (
        df.groupBy("team_lead_name", "agent_name",
                   week_end_saturday("call_date").alias("week_end"))
        .agg(F.sum("calls_offer_applied").alias("total_offers_applied")))
    window = Window.partitionBy("team_lead_name", "agent_name").orderBy("week_end")
    return weeks.withColumn("rolling_avg_3", trailing_mean("total_offers_applied", 3, window))
