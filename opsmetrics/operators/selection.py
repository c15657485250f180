"""Report parameters: date range, agents, and the choices offered for them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmetrics.operators.ordering import with_global_order
from opsmetrics.storage import materialize


def in_period(df: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Rows with ``call_date`` in the inclusive range.

    On a fact this sits on a grouping key, so Catalyst moves it below the
    aggregation and into the Parquet scan.
    """
    return df.filter(F.col("call_date").between(F.lit(start), F.lit(end)))


def of_agents(df: DataFrame, agents: list[str] | DataFrame) -> DataFrame:
    """Rows of the chosen agents; an empty choice keeps none.

    A list becomes an ``In`` predicate. Pass a large choice as a DataFrame with an
    ``agent_name`` column: it becomes a semi join, broadcast only if the planner knows
    the choice is small, as it does for a stored table.
    """
    if isinstance(agents, DataFrame):
        return df.join(agents.select("agent_name"), "agent_name", "left_semi")
    return df.filter(F.col("agent_name").isin(agents))


def agents_of_lead(df: DataFrame, lead: str) -> DataFrame:
    """Distinct agents who have rows under one team lead."""
    return df.filter(F.col("team_lead_name") == lead).select("agent_name").distinct()


def filter_choices(df: DataFrame) -> DataFrame:
    """Date bounds and the sorted team leads, one choice per row.

    The log is scanned once into one row per lead; all three choices come from that.
    """
    leads = materialize(df.groupBy("team_lead_name").agg(
        F.min("call_date").alias("first_day"), F.max("call_date").alias("last_day")))
    ordered = with_global_order(leads, ["team_lead_name"], "position", stored=True).select(
        F.lit("team_lead").alias("choice"), "position",
        F.col("team_lead_name").alias("value"))
    bounds = leads.agg(F.min("first_day").alias("date_start"),
                       F.max("last_day").alias("date_end"))
    dates = bounds.unpivot([], ["date_start", "date_end"], "choice", "day").select(
        "choice", F.lit(1).cast("bigint").alias("position"),
        F.col("day").cast("string").alias("value"))
    return dates.unionByName(ordered)
