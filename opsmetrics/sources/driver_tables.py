"""Call rows and targets derived from the TPC-H style test tables.

The test tables hold no call log, so line items stand in for call rows: the
supplier is the agent, the supplier's nation the team lead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmetrics.functions.calendar import year_month

# target = (base + step * month) / divisor.
TARGET_RULES = [
    ("AHT", 760, 2, 1.0),
    ("CALL_REGEN", 150, 1, 1000.0),
    ("TRANSFERS", 70, 1, 1000.0),
    ("APPLIED_PER_CALL", 500, 1, 1000.0),
    ("BREAKAGE", 190, 1, 1000.0),
]


# The columns read, with their stored types: no footers are read to infer a schema.
TABLES = {
    "lineitem": "l_suppkey bigint, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "nation": "n_nationkey int, n_name string",
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def _percent_points(ratio: str) -> Column:
    """A non-negative ratio in whole percent; ``round`` would go through decimals."""
    return F.floor(F.col(ratio) * 100 + 0.5).cast("bigint")


def call_log(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as raw call rows.

    The dimensions join one after another without hints: each is a plain scan whose
    file size the planner knows, so it broadcasts small ones and otherwise uses a
    sort-merge join that AQE splits where an agent is hot.
    """
    lines = _table(spark, folder, "lineitem")
    agents = _table(spark, folder, "supplier")
    leads = _table(spark, folder, "nation")
    day = F.col("l_shipdate").cast("date")
    return (
        lines
        .join(agents, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(leads, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            year_month(day).alias("yr_mo"),
            day.alias("call_date"),
            F.col("n_name").alias("team_lead_name"),
            F.col("s_name").alias("agent_name"),
            F.col("l_quantity").cast("bigint").alias("calls"),
            F.floor("l_extendedprice").cast("bigint").alias("handle_time"),
            _percent_points("l_discount").alias("discount"),
            _percent_points("l_tax").alias("tax"),
            (F.col("l_returnflag") == "R").alias("returned"),
            (F.col("l_linestatus") == "O").alias("open"))
        .withColumn("calls_with_offer", F.expr("calls * (100 - discount) div 100"))
        .withColumn("calls_with_accept", F.expr("calls_with_offer * (100 - 4 * tax) div 100"))
        .withColumn("calls_offer_applied",
                    F.expr("calls_with_accept * (100 - 5 * discount) div 100"))
        .select(
            "yr_mo", "call_date", "team_lead_name", "agent_name", "calls", "handle_time",
            F.expr("IF(returned, calls * 45 div 100, 0L)").alias("call_regen"),
            "calls_with_offer", "calls_with_accept", "calls_offer_applied",
            F.expr("IF(open, calls * 16 div 100, 0L)").alias("transfers")))


def call_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Targets for every month with line items except Decembers, in long form."""
    months = (
        _table(spark, folder, "lineitem")
        .select(year_month(F.col("l_shipdate").cast("date")).alias("yr_mo"))
        .distinct()
        .filter(F.col("yr_mo") % 100 != 12))
    month = F.col("yr_mo") % 100
    rules = F.array(*[
        F.struct(F.lit(metric).alias("metric"),
                 ((base + step * month).cast("double") / divisor).alias("target"))
        for metric, base, step, divisor in TARGET_RULES])
    return months.select("yr_mo", F.inline(rules))
