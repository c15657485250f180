"""Period summaries from running totals by month.

For each agent and month a stored table holds the sums and counts of all its days up to the
end of that month. A date range then needs two of those rows an agent, and days only of the
months it cuts. The tables are partitioned by month, so a report reads four months at most,
however long its range.

Totals are differences of sums: rates must be finite (the fact's ``zero="null"``; NaN or
infinity fails the job), missing values are skipped, and means agree with a pass over the
days but for rounding.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsmetrics.operators.summary import SUMMARY_COUNTS, SUMMARY_RATES
from opsmetrics.storage import read_fact

# Measure of the summary -> column of the fact; means first, then totals.
_MEANS = {"calls_avg": "calls", "handle_time_avg": "handle_time_avg",
          "call_regen": "call_regen_rate"} | {rate: rate for rate in SUMMARY_RATES}
_TOTALS = {"calls_total": "calls"} | {count: count for count in SUMMARY_COUNTS}
_MEASURES = list(dict.fromkeys([*_MEANS.values(), *_TOTALS.values()]))
_SUMS = ["days", *[f"{m}_sum" for m in _MEASURES], *[f"{m}_n" for m in _MEASURES]]


def _days(df: DataFrame, *keys: str) -> DataFrame:
    """Days, sums and counts of every measure by agent and ``keys``."""
    def finite(name: str) -> Column:
        if df.schema[name].dataType.typeName() != "double":
            return F.col(name)
        bad = F.raise_error(F.lit(f"{name} is not finite")).cast("double")
        value = F.col(name)
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), bad).otherwise(value)

    return df.groupBy("agent_name", *keys).agg(
        F.count(F.lit(1)).alias("days"),
        *[F.coalesce(F.sum(finite(m)), F.lit(0)).alias(f"{m}_sum") for m in _MEASURES],
        *[F.count(m).alias(f"{m}_n") for m in _MEASURES])


def _number(year_month: Column) -> Column:
    """Months since year 0."""
    return F.floor(year_month / 100) * 12 + year_month % 100 - 1


def running_totals(fact: DataFrame) -> DataFrame:
    """Totals of each agent up to the end of each month, from its first month to the last
    month of all, months without days included. An agent's window sees one row a month. This
    reads the last month of a stored fact ahead."""
    months = _days(fact, "yr_mo").withColumn("_m", _number(F.col("yr_mo")))
    newest = fact.agg(F.max("yr_mo")).first()[0]
    last = F.lit(None if newest is None else _of(newest)).cast("bigint")
    grid = (
        months.groupBy("agent_name").agg(F.min("_m").alias("_first"))
        .select("agent_name", F.explode(F.sequence("_first", last)).alias("_m")))
    so_far = Window.partitionBy("agent_name").orderBy("_m").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (
        grid.join(months.drop("yr_mo"), ["agent_name", "_m"], "left")
        .select("agent_name",
                (F.floor(F.col("_m") / 12) * 100 + F.col("_m") % 12 + 1).cast("int")
                .alias("yr_mo"),
                *[F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(c) for c in _SUMS]))


def write_running_totals(fact: DataFrame, path: str) -> None:
    """Store the running totals by month."""
    (running_totals(fact).hint("rebalance", "yr_mo")
        .write.mode("errorifexists").partitionBy("yr_mo").parquet(path))


def summary_of_period(spark: SparkSession, fact_path: str, totals_path: str,
                      start: dt.date, end: dt.date) -> DataFrame:
    """``agent_period_summary`` of the stored fact's days from ``start`` to ``end``, with the
    totals stored of the same fact. Agents without a day in the range are left out; a range
    that ends before it starts has none."""
    totals = spark.read.parquet(totals_path)
    bounds = totals.agg(F.max("yr_mo")).first()[0]
    stored = 0 if bounds is None else _of(bounds)
    first, last = _whole_months(start, end)
    if first > last:
        signed = _days(read_fact(spark, fact_path, start, end))
    else:
        def at(month: int, sign: int) -> DataFrame:
            chosen = totals.filter(F.col("yr_mo") == _name(min(month, stored)))
            return chosen.select("agent_name", *[(F.col(c) * sign).alias(c) for c in _SUMS])

        signed = at(last, 1).unionByName(at(first - 1, -1))
        for edge in _edges(start, end, first, last):
            signed = signed.unionByName(_days(read_fact(spark, fact_path, *edge)))
    sums = (signed.groupBy("agent_name").agg(*[F.sum(c).alias(c) for c in _SUMS])
            .filter("days > 0"))

    def total(m: str) -> Column:
        return F.when(F.col(f"{m}_n") > 0, F.col(f"{m}_sum"))

    def mean(name: str, m: str) -> Column:
        value = F.try_divide(F.col(f"{m}_sum").cast("double"), F.col(f"{m}_n").cast("double"))
        return (value / F.lit(60.0) if name == "handle_time_avg" else value).alias(name)

    means = {name: mean(name, m) for name, m in _MEANS.items()}
    return sums.select(
        "agent_name", means.pop("calls_avg"), total("calls").alias("calls_total"),
        *means.values(), *[total(c).alias(c) for c in SUMMARY_COUNTS])


def _of(year_month: int) -> int:
    return year_month // 100 * 12 + year_month % 100 - 1


def _name(month: int) -> int:
    return month // 12 * 100 + month % 12 + 1


def _day_one(month: int) -> dt.date:
    return dt.date(month // 12, month % 12 + 1, 1)


def _whole_months(start: dt.date, end: dt.date) -> tuple[int, int]:
    """The first and last month, since year 0, that lie in the range as a whole."""
    first = start.year * 12 + start.month - (start.day == 1)
    after = end + dt.timedelta(days=1)
    return first, after.year * 12 + after.month - 2


def _edges(start: dt.date, end: dt.date, first: int, last: int):
    """The days before the first whole month and those after the last one."""
    if start < _day_one(first):
        yield start, _day_one(first) - dt.timedelta(days=1)
    if end >= _day_one(last + 1):
        yield _day_one(last + 1), end
