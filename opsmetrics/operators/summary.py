"""Per-agent summary of a period and the scorecards above it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsmetrics.functions.numbers import mean, sector, total
from opsmetrics.functions.text import number_text, percent_text

# Gauge sectors in percent, best first.
GAUGE_SECTORS = {
    "calls_with_offer_rate": [("success", 90, 100), ("warning", 75, 90), ("danger", 0, 75)],
    "calls_with_accept_rate": [("success", 75, 100), ("warning", 65, 75), ("danger", 0, 65)],
    "calls_offer_applied_rate": [("success", 50, 100), ("warning", 40, 50), ("danger", 0, 40)],
    "call_breakage_rate": [("success", 0, 20), ("warning", 20, 30), ("danger", 30, 100)],
}

SUMMARY_COUNTS = ["calls_with_offer", "calls_with_accept", "calls_offer_applied",
                  "call_breakage_count"]
SUMMARY_RATES = ["call_transfer_rate", "call_breakage_rate", "calls_offer_applied_rate",
                 "calls_with_offer_rate", "calls_with_accept_rate"]
SCORECARD_SUMS = ["calls_by_day_avg", "calls_total", *SUMMARY_COUNTS]
SCORECARD_MEANS = ["handle_time_avg", "call_regen", *SUMMARY_RATES]


def agent_period_summary(fact: DataFrame, na: str = "skip") -> DataFrame:
    """One row per agent: totals, and unweighted means of the daily rates.

    ``call_regen`` is a mean rate despite its name; ``handle_time_avg`` is in minutes.
    """
    return fact.groupBy("agent_name").agg(
        mean("calls", na).alias("calls_avg"),
        total("calls", na).alias("calls_total"),
        mean(F.col("handle_time_avg") / F.lit(60.0), na).alias("handle_time_avg"),
        mean("call_regen_rate", na).alias("call_regen"),
        *[mean(rate, na).alias(rate) for rate in SUMMARY_RATES],
        *[total(count, na).alias(count) for count in SUMMARY_COUNTS])


def scorecard(summary: DataFrame) -> DataFrame:
    """One row, from one aggregation: sums over agents and means over agents.

    ``calls_by_day_avg`` adds each agent's own daily mean; the rates are means of
    means. An empty selection gives zero sums and NULL means.
    """
    return summary.agg(
        F.coalesce(F.sum("calls_avg"), F.lit(0.0)).alias("calls_by_day_avg"),
        *[F.coalesce(F.sum(count), F.lit(0)).alias(count) for count in SCORECARD_SUMS[1:]],
        *[F.avg(rate).alias(rate) for rate in SCORECARD_MEANS])


def scorecard_totals(summary: DataFrame) -> DataFrame:
    """The sums of the scorecard."""
    return scorecard(summary).select(*SCORECARD_SUMS)


def scorecard_rates(summary: DataFrame, sectors: dict | None = None) -> DataFrame:
    """The means of the scorecard, with gauge percents and sectors."""
    sectors = sectors or GAUGE_SECTORS
    return (
        scorecard(summary).select(*SCORECARD_MEANS)
        .withColumns({f"{rate}_pct": F.round(F.bround(rate, 3) * 100, 1) for rate in sectors})
        .withColumns({f"{rate}_sector": sector(f"{rate}_pct", limits)
                      for rate, limits in sectors.items()}))


def scorecard_text(summary: DataFrame) -> DataFrame:
    """The scorecard as display text."""
    def rounded_percent(rate: str) -> Column:
        return percent_text(F.bround(rate, 3))

    return scorecard(summary).select(
        *[number_text(c, 0).alias(f"{c}_text") for c in SCORECARD_SUMS],
        number_text("handle_time_avg", 2).alias("handle_time_avg_text"),
        *[rounded_percent(c).alias(f"{c}_text")
          for c in ("call_regen", "call_transfer_rate", "call_breakage_rate")],
        F.concat(F.lit("Offer Applied Rate: "), rounded_percent("calls_offer_applied_rate"))
         .alias("calls_offer_applied_rate_text"))
