"""Physical plans: pushdown, pruning, exchanges."""

import datetime as dt
import re

import pytest

from opsmetrics.operators import facts, ranking, selection, series, summary
from opsmetrics.operators.targets import targets_joinable, targets_wide
from opsmetrics.plans import registry
from opsmetrics.sources import driver_tables

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def log(spark):
    return driver_tables.call_log(spark, FOLDER)


def test_selection_on_the_fact_reaches_the_scan(log):
    fact = facts.agent_daily_fact(log)
    chosen = selection.of_agents(
        selection.in_period(fact, dt.date(1996, 1, 1), dt.date(1996, 12, 31)), ["x", "y"])
    text = plan(summary.agent_period_summary(chosen))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(l_shipdate,1996-01-01", text)
    assert re.search(r"PushedFilters: \[[^\]]*In\(s_name, \[x,y\]\)", text)


def test_columns_are_pruned(log):
    text = plan(series.calls_per_day(log))
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in text


def test_fact_has_one_exchange_and_targets_add_none_to_it(spark, log):
    fact = facts.agent_daily_fact(log)
    assert plan(fact).count("Exchange hashpartitioning") == 1
    targets = targets_joinable(targets_wide(driver_tables.call_targets(spark, FOLDER)))
    joined = plan(facts.with_targets(fact, targets))
    assert "BroadcastHashJoin [yr_mo" in joined and "SortMergeJoin" not in joined


def test_scorecard_is_one_aggregate_over_the_summary(log):
    text = plan(summary.scorecard_rates(summary.agent_period_summary(facts.agent_daily_fact(log))))
    assert text.count("Exchange hashpartitioning") == 2
    assert text.count("Exchange SinglePartition") == 1


def test_selected_agents_are_joined_before_the_fact(spark):
    text = plan(registry._selected_summary(spark, FOLDER))
    fact_exchange = text.index("Exchange hashpartitioning(yr_mo")
    assert text.index("LeftSemi") > fact_exchange


def test_single_partition_only_above_bounded_tables(log):
    weekly = series.calls_weekly(log).transform(series.pct_change("week_num"))
    text = plan(weekly)
    single = text.index("Exchange SinglePartition")
    assert "HashAggregate(keys=[" in text[single:]
    assert "SinglePartition" not in plan(series.weekly_offers_rolling3(log))


def test_top_n_without_a_global_sort(log):
    text = plan(ranking.lump_agents(log, 3))
    assert "TakeOrderedAndProject" in text and "l_suppkey" not in text


def test_segments_read_the_calls_once(spark, monkeypatch):
    """One scan when the rates are stored, none in what is built on them."""
    stored = []

    def keep(df, write=registry.materialize):
        stored.append(plan(df))
        return write(df)

    monkeypatch.setattr(registry, "materialize", keep)
    for query in (registry.segment_quality, registry.segment_profile_by_lead):
        stored.clear()
        text = plan(query(spark, FOLDER))
        assert "l_suppkey" not in text
        assert [t.count("lineitem.parquet") for t in stored] == [1]
