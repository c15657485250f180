"""Top agents with the rest pooled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmetrics.functions.numbers import safe_ratio
from opsmetrics.functions.text import label, number_text, percent_text
from opsmetrics.operators.ordering import with_global_order
from opsmetrics.storage import materialize

# The pooled name and the label text.
OTHER = "Other"
TOP_AGENT_LABEL = ("Rank: {rank}\nOffers Applied: {offers_applied_text}\n"
                   "CumPct: {cum_pct_text}")


def lump_agents(df: DataFrame, n: int = 10) -> DataFrame:
    """Totals of the ``n`` agents with most calls, all others pooled as "Other".

    Agents tied with the ``n``-th are all kept. The totals, one row per agent, are stored
    because the threshold and the pooling both read them.
    """
    totals = materialize(df.groupBy("agent_name").agg(
        F.sum("calls").alias("total_calls"),
        F.sum("calls_offer_applied").alias("offers_applied")))
    leaders = totals.orderBy(F.desc("total_calls")).limit(n)
    threshold = leaders.agg(F.min("total_calls")).scalar()
    name = F.when(F.col("total_calls") >= threshold, F.col("agent_name")).otherwise(OTHER)
    return (
        totals.groupBy(name.alias("agent_name"))
        .agg(F.sum("total_calls").alias("total_calls"),
             F.sum("offers_applied").alias("offers_applied")))


def top_agents(df: DataFrame, n: int = 10, null_rank: str = "last") -> DataFrame:
    """Kept agents by offers applied, "Other" last, with cumulative share and rank.

    The rank of the last row is NULL; with ``null_rank="other_only"`` only if that row
    is "Other". ``agent_order`` is the output order. Ties at the threshold have no
    bound, so the order goes through :func:`with_global_order`.
    """
    if null_rank not in ("last", "other_only"):
        raise ValueError(f"unknown rank policy: {null_rank}")
    is_other = F.col("agent_name") == OTHER
    ordered = with_global_order(
        lump_agents(df, n), [is_other, F.desc("offers_applied"), F.col("agent_name")],
        "agent_order", running={"cum_offers": "offers_applied"})
    whole = ordered.agg(F.max("agent_order").alias("rows"),
                        F.sum("offers_applied").alias("offers"))
    unranked = is_other
    if null_rank == "last":
        unranked = F.col("agent_order") == whole.select("rows").scalar()
    return (
        ordered
        .withColumn("cum_pct", safe_ratio(F.col("cum_offers"),
                                          whole.select("offers").scalar()))
        .withColumns({
            "offers_applied_text": number_text("offers_applied"),
            "cum_pct_text": percent_text("cum_pct"),
            "rank": F.when(~unranked, F.col("agent_order")).cast("int")})
        .withColumn("label_text", label(TOP_AGENT_LABEL))
        .drop("cum_offers"))
