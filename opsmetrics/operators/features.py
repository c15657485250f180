"""Per-agent mean rates, wide and long."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmetrics.functions.numbers import bin_by_limits, mean
from opsmetrics.functions.text import label, percent_text
from opsmetrics.operators.ordering import with_global_order

FEATURES = ["calls_with_offer_rate", "calls_with_accept_rate", "call_transfer_rate",
            "call_breakage_rate", "call_regen_rate", "calls_offer_applied_rate"]

# Display names of the rates in display order.
METRIC_NAMES = {
    "calls_with_offer_rate": "Offer Rate",
    "calls_with_accept_rate": "Accept Rate",
    "calls_offer_applied_rate": "Applied Rate",
    "call_breakage_rate": "Breakage Rate",
    "call_transfer_rate": "Transfer Rate",
}

# Upper limits of the applied-rate bins.
RATE_LIMITS = [(0.4, "low"), (0.512, "medium")]


def agent_features(fact: DataFrame, na: str = "skip") -> DataFrame:
    """Unweighted mean of each daily rate per agent."""
    return fact.groupBy("agent_name").agg(*[mean(f, na).alias(f) for f in FEATURES])


def agent_lead_rates(fact: DataFrame) -> DataFrame:
    """Sum and number of each daily rate per agent and lead.

    One row per pair: stored once, it gives both the features and the agent-lead pairs
    without another pass over the calls. Missing rates are neither summed nor counted.
    """
    return fact.groupBy("agent_name", "team_lead_name").agg(
        *[F.sum(f).alias(f"{f}_sum") for f in FEATURES],
        *[F.count(f).alias(f"{f}_days") for f in FEATURES])


def features_of_rates(rates: DataFrame) -> DataFrame:
    """The features of ``agent_features`` from ``agent_lead_rates``."""
    return rates.groupBy("agent_name").agg(*[
        F.try_divide(F.sum(f"{f}_sum"), F.sum(f"{f}_days")).alias(f) for f in FEATURES])


def agent_metric_long(fact: DataFrame) -> DataFrame:
    """One row per agent and metric, missing rates included.

    ``metric_order`` follows the display names, ``agent_order`` the names backwards.
    """
    rates = fact.groupBy("agent_name").agg(*[mean(r).alias(r) for r in METRIC_NAMES])
    named = (with_global_order(rates, [F.desc("agent_name")], "agent_order")
             .withColumnsRenamed(METRIC_NAMES))
    names = list(METRIC_NAMES.values())
    return (
        named.unpivot(["agent_name", "agent_order"], names, "metric", "pct")
        .withColumns({
            "metric_order": F.array_position(F.lit(names), F.col("metric")).cast("int"),
            "pct_text": percent_text("pct")})
        .withColumn("label_text", label("Agent: {agent_name}\n{metric}: {pct_text}")))


def with_rate_bin(features: DataFrame, limits: list[tuple[float, str]] | None = None,
                  above: str = "high") -> DataFrame:
    """Add the bin of the applied rate; a missing rate falls in ``above``."""
    return features.withColumn(
        "calls_offer_applied_rate_bin",
        bin_by_limits("calls_offer_applied_rate", limits or RATE_LIMITS, above))
