"""The agent-day fact and its target join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmetrics.functions.numbers import safe_ratio, total

FACT_KEYS = ["yr_mo", "call_date", "team_lead_name", "agent_name"]

FACT_COLUMNS = FACT_KEYS + [
    "calls", "handle_time", "handle_time_avg",
    "call_regen", "call_regen_rate",
    "calls_with_offer", "calls_with_offer_rate",
    "calls_with_accept", "calls_with_accept_rate",
    "calls_offer_applied", "calls_offer_applied_rate",
    "call_transfers", "call_transfer_rate",
    "call_breakage_count", "call_breakage_rate",
]


def agent_daily_fact(log: DataFrame, zero: str = "null", na: str = "skip") -> DataFrame:
    """Sum call rows to one row per month, day, lead and agent, then take ratios.

    One shuffle on the four keys after map-side sums, so a hot agent reaches it as at
    most one row per day and task. Ratios use the sums, never the raw rows.
    """
    sums = log.groupBy(*FACT_KEYS).agg(
        total("calls", na).alias("calls"),
        total("handle_time", na).alias("handle_time"),
        total("call_regen", na).alias("call_regen"),
        total("calls_with_offer", na).alias("calls_with_offer"),
        total("calls_with_accept", na).alias("calls_with_accept"),
        total("calls_offer_applied", na).alias("calls_offer_applied"),
        total("transfers", na).alias("call_transfers"))
    per_call = {
        "handle_time_avg": "handle_time",
        "call_regen_rate": "call_regen",
        "calls_with_offer_rate": "calls_with_offer",
        "calls_with_accept_rate": "calls_with_accept",
        "calls_offer_applied_rate": "calls_offer_applied",
        "call_transfer_rate": "call_transfers",
    }
    broken = F.col("calls_with_accept") - F.col("calls_offer_applied")
    return (
        sums
        .withColumns({rate: safe_ratio(count, "calls", zero)
                      for rate, count in per_call.items()})
        .withColumns({"call_breakage_count": broken,
                      "call_breakage_rate": safe_ratio(broken, "calls_with_accept", zero)})
        .select(*FACT_COLUMNS))


def with_targets(fact: DataFrame, targets: DataFrame) -> DataFrame:
    """Left join of joinable targets on the month; unmatched months keep NULLs.

    ``targets`` must come from ``targets_wide``, which proves it has at most 3,600
    rows; broadcasting it spares the fact a shuffle on a handful of hot months.
    ``handle_time_avg`` stays in seconds, its target is in minutes, so the minutes
    are added.
    """
    return (
        fact
        .join(F.broadcast(targets), "yr_mo", "left")
        .withColumn("handle_time_avg_min", F.col("handle_time_avg") / F.lit(60.0)))
