"""Every operator as a query over the test tables.

Means are rounded here, not in the library, so that both engines print the same
digits; ratios of two whole numbers are left as they are.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmetrics.operators import (
    digits, facts, features, ordering, prefix, ranking, segments, selection, series, smooth, summary,
    targets)
from opsmetrics.sources import driver_tables
from opsmetrics.storage import materialize, shared_folder, write_fact

# Parameters of the registered queries; the SQL reads the same ones.
PERIOD = (dt.date(1996, 3, 1), dt.date(1999, 10, 31))
CUT_PERIOD = (dt.date(1993, 2, 12), dt.date(1997, 8, 19))
LEADS = ["NATION_15", "NATION_16", "NATION_20"]
LEAD = "NATION_15"
TOP_N = 10
RATE_LIMITS = [(0.525, "low"), (0.535, "medium")]
QUANTILES = [0.0, 0.3, 0.6, 1.0]
SPAN = 0.2

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int, columns: list[str] | None = None) -> DataFrame:
    """Round the double columns, or the named ones."""
    names = columns or [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: F.round(n, digits) for n in names})


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return driver_tables.call_log(spark, folder)


def _fact(spark: SparkSession, folder: str) -> DataFrame:
    return facts.agent_daily_fact(_log(spark, folder))


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    return targets.targets_wide(driver_tables.call_targets(spark, folder))


def _summary(spark: SparkSession, folder: str) -> DataFrame:
    return summary.agent_period_summary(_fact(spark, folder))


def _selected_log(spark: SparkSession, folder: str) -> DataFrame:
    """The call rows of a date range and the agents of some leads.

    Both choices are on grouping keys of the fact, so they are made on the log: the
    planner moves a date range below an aggregation by itself, but not a semi join.
    """
    team = materialize(_bridge(spark, folder).filter(F.col("team_lead_name").isin(LEADS))
                       .select("agent_name").distinct())
    return selection.of_agents(selection.in_period(_log(spark, folder), *PERIOD), team)


def _selected_summary(spark: SparkSession, folder: str) -> DataFrame:
    return summary.agent_period_summary(
        facts.agent_daily_fact(_selected_log(spark, folder)))


def _features(spark: SparkSession, folder: str) -> DataFrame:
    return features.agent_features(_fact(spark, folder))


def _monthly(spark: SparkSession, folder: str) -> DataFrame:
    return series.calls_monthly(_log(spark, folder))


def _weekly(spark: SparkSession, folder: str) -> DataFrame:
    return series.calls_weekly(_log(spark, folder))


def _bridge(spark: SparkSession, folder: str) -> DataFrame:
    return segments.agent_lead_bridge(_log(spark, folder))


def _rates(spark: SparkSession, folder: str) -> DataFrame:
    """Daily rates summed per agent and lead, stored: the calls are read once for
    features and bridge."""
    return materialize(features.agent_lead_rates(_fact(spark, folder)))


def _by_lead(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features, an assignment with the lead as the cluster, and the bridge."""
    rates = _rates(spark, folder)
    bridge = segments.agent_lead_bridge(rates)
    assignment = bridge.select("agent_name", F.col("team_lead_name").alias("cluster"))
    return features.features_of_rates(rates), assignment, bridge


def _by_kmeans(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features, stored for their several uses, the K-means assignment and the bridge."""
    rates = _rates(spark, folder)
    agents = materialize(features.features_of_rates(rates))
    return agents, segments.segment_kmeans(agents), segments.agent_lead_bridge(rates)


def call_log(spark, folder):
    return _log(spark, folder)


def targets_wide(spark, folder):
    return _targets(spark, folder)


def targets_joinable(spark, folder):
    return targets.targets_joinable(_targets(spark, folder))


def agent_daily_fact(spark, folder):
    return _fact(spark, folder)


def agent_daily_vs_target(spark, folder):
    return facts.with_targets(_fact(spark, folder), targets_joinable(spark, folder))


def agent_period_summary(spark, folder):
    return rounded(_summary(spark, folder), 6)


def agent_period_summary_selected(spark, folder):
    return rounded(_selected_summary(spark, folder), 6)


def agent_period_summary_from_totals(spark, folder):
    """A range that cuts months, from stored running totals and the two cut months."""
    path = f"{shared_folder(spark).rstrip('/')}/opsmetrics-{uuid.uuid4().hex}"
    write_fact(_fact(spark, folder), f"{path}/fact")
    stored = spark.read.parquet(f"{path}/fact")
    prefix.write_running_totals(stored, f"{path}/totals")
    found = prefix.summary_of_period(spark, f"{path}/fact", f"{path}/totals", *CUT_PERIOD)
    return rounded(found, 6)


def scorecard_totals(spark, folder):
    return rounded(summary.scorecard_totals(_summary(spark, folder)), 6)


def scorecard_rates(spark, folder):
    return rounded(summary.scorecard_rates(_summary(spark, folder)), 6)


def scorecard_rates_selected(spark, folder):
    return rounded(summary.scorecard_rates(_selected_summary(spark, folder)), 6)


def scorecard_text(spark, folder):
    return summary.scorecard_text(_summary(spark, folder))


def scorecard_totals_selected(spark, folder):
    return rounded(summary.scorecard_totals(_selected_summary(spark, folder)), 6)


def scorecard_text_selected(spark, folder):
    return summary.scorecard_text(_selected_summary(spark, folder))


def filter_choices(spark, folder):
    return selection.filter_choices(_log(spark, folder))


def agents_of_lead(spark, folder):
    return selection.agents_of_lead(_log(spark, folder), LEAD)


def calls_per_day(spark, folder):
    return series.calls_per_day(_log(spark, folder))


def calls_per_day_smoothed(spark, folder):
    days = series.calls_per_day(_log(spark, folder))
    return rounded(smooth.loess(days, span=SPAN), 4)


def calls_per_day_selected(spark, folder):
    return series.calls_per_day(_selected_log(spark, folder))


def calls_per_day_smoothed_selected(spark, folder):
    days = series.calls_per_day(_selected_log(spark, folder))
    return rounded(smooth.loess(days, span=SPAN), 4)


def calls_weekly(spark, folder):
    return _weekly(spark, folder)


def calls_weekly_change(spark, folder):
    return _weekly(spark, folder).transform(series.pct_change("week_num"))


def calls_weekly_change_digits(spark, folder):
    changed = materialize(calls_weekly_change(spark, folder).drop("pct_diff_1_chr"))
    return digits.with_percent_text(changed, "pct_diff_1", "pct_text")


def calls_weekly_rolling(spark, folder):
    return series.calls_weekly_rolling(_weekly(spark, folder))


def calls_monthly(spark, folder):
    return _monthly(spark, folder)


def calls_monthly_vs_first(spark, folder):
    return series.calls_monthly_vs_first(_monthly(spark, folder))


def calls_monthly_cumulative(spark, folder):
    return series.calls_monthly_cumulative(_monthly(spark, folder))


def calls_cumulative_by_month(spark, folder):
    return series.calls_cumulative_by_month(_monthly(spark, folder))


def weekly_offers_rolling3(spark, folder):
    return series.weekly_offers_rolling3(_log(spark, folder))


def top_agents(spark, folder):
    return ranking.top_agents(_log(spark, folder), TOP_N)


def agent_metric_long(spark, folder):
    return rounded(features.agent_metric_long(_fact(spark, folder)), 6)


def agent_features(spark, folder):
    return rounded(_features(spark, folder), 6)


def rate_quantiles(spark, folder):
    return rounded(ordering.exact_quantiles(
        _features(spark, folder), "calls_offer_applied_rate", "agent_name", QUANTILES), 6)


def rate_bins(spark, folder):
    binned = features.with_rate_bin(_features(spark, folder), RATE_LIMITS)
    return rounded(binned.select(
        "agent_name", "calls_offer_applied_rate", "calls_offer_applied_rate_bin"), 6)


def agent_lead_bridge(spark, folder):
    return _bridge(spark, folder)


def segment_quality(spark, folder):
    agents, assignment, _ = _by_lead(spark, folder)
    return rounded(segments.segment_quality(agents, assignment), 8)


def segment_totals(spark, folder):
    agents, assignment, _ = _by_lead(spark, folder)
    return rounded(segments.segment_totals(agents, assignment), 8)


def segment_profile_by_lead(spark, folder):
    agents, assignment, bridge = _by_lead(spark, folder)
    return rounded(segments.segment_profile(agents, assignment, bridge, RATE_LIMITS), 6)


def segment_members_by_lead(spark, folder):
    agents, assignment, bridge = _by_lead(spark, folder)
    profile = segments.segment_profile(agents, assignment, bridge, RATE_LIMITS)
    return rounded(segments.segment_members(profile, LEAD), 6)


def segment_kmeans(spark, folder):
    return segments.segment_kmeans(_features(spark, folder))


def kmeans_sweep(spark, folder):
    return rounded(segments.kmeans_sweep(_features(spark, folder)), 8)


def agent_projection(spark, folder):
    return rounded(segments.agent_projection(_features(spark, folder)), 6)


def segment_profile(spark, folder):
    return rounded(segments.segment_profile(*_by_kmeans(spark, folder), RATE_LIMITS), 6)


def segment_quality_kmeans(spark, folder):
    agents, assignment, _ = _by_kmeans(spark, folder)
    return rounded(segments.segment_quality(agents, assignment), 8)


def segment_totals_kmeans(spark, folder):
    agents, assignment, _ = _by_kmeans(spark, folder)
    return rounded(segments.segment_totals(agents, assignment), 8)


def segment_members(spark, folder):
    profile = segments.segment_profile(*_by_kmeans(spark, folder), RATE_LIMITS)
    return rounded(segments.segment_members(profile, 3), 6)


def segment_labels(spark, folder):
    agents, assignment, bridge = _by_kmeans(spark, folder)
    projection = segments.agent_projection(agents)
    return rounded(segments.segment_labels(projection, assignment, bridge), 6)


QUERIES: dict[str, Query] = {query.__name__: query for query in [
    call_log, targets_wide, targets_joinable,
    agent_daily_fact, agent_daily_vs_target,
    agent_period_summary, agent_period_summary_selected, agent_period_summary_from_totals,
    scorecard_totals, scorecard_rates, scorecard_rates_selected, scorecard_text,
    scorecard_totals_selected, scorecard_text_selected,
    filter_choices, agents_of_lead,
    calls_per_day, calls_per_day_smoothed,
    calls_per_day_selected, calls_per_day_smoothed_selected,
    calls_weekly, calls_weekly_change, calls_weekly_change_digits, calls_weekly_rolling,
    calls_monthly, calls_monthly_vs_first, calls_monthly_cumulative,
    calls_cumulative_by_month, weekly_offers_rolling3,
    top_agents, agent_metric_long, agent_features,
    rate_quantiles, rate_bins, agent_lead_bridge,
    segment_quality, segment_totals, segment_profile_by_lead, segment_members_by_lead,
    segment_kmeans, kmeans_sweep, agent_projection,
    segment_profile, segment_members, segment_labels,
    segment_quality_kmeans, segment_totals_kmeans,
]}
