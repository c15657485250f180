import datetime as dt
import math

import pytest

from opsmetrics.operators.facts import FACT_COLUMNS, agent_daily_fact, with_targets
from opsmetrics.operators.selection import agents_of_lead, filter_choices, in_period, of_agents
from opsmetrics.operators.summary import (
    agent_period_summary, scorecard_rates, scorecard_text, scorecard_totals)
from opsmetrics.operators.targets import targets_joinable, targets_wide

JUNE = (dt.date(2017, 6, 3), dt.date(2017, 6, 4))


def test_fact_golden(log):
    fact = agent_daily_fact(log)
    assert fact.columns == FACT_COLUMNS
    rows = {(str(r.call_date)[5:], r.agent_name): r for r in fact.collect()}
    expected = {
        ("06-03", "A"): (20, 450, 0.15, 0.8, 0.6, 0.45, 0.05, 3, 0.25),
        ("06-04", "A"): (20, 450, 0.20, 1.0, 0.5, 0.25, 0.10, 5, 0.50),
        ("06-04", "B"): (5, 300, 0.0, 0.8, 0.0, 0.0, 0.20, 0, None),
        ("09-01", "B"): (10, 480, 0.10, 1.0, 0.8, 0.60, 0.10, 2, 0.25),
    }
    assert set(rows) == set(expected)
    for key, values in expected.items():
        r = rows[key]
        got = (r.calls, r.handle_time_avg, r.call_regen_rate, r.calls_with_offer_rate,
               r.calls_with_accept_rate, r.calls_offer_applied_rate, r.call_transfer_rate,
               r.call_breakage_count, r.call_breakage_rate)
        assert got == pytest.approx(values)


def test_fact_ieee_and_missing(spark, log):
    row = agent_daily_fact(log, zero="ieee").filter("agent_name = 'B' AND yr_mo = 201706").first()
    assert math.isnan(row.call_breakage_rate)
    holed = log.selectExpr(*[c if c != "calls" else "nullif(calls, 20) AS calls"
                             for c in log.columns])
    by_day = {str(r.call_date): r for r in
              agent_daily_fact(holed, na="propagate").filter("agent_name = 'A'").collect()}
    assert by_day["2017-06-04"].calls is None and by_day["2017-06-04"].call_regen_rate is None
    assert by_day["2017-06-03"].calls == 20


def test_targets(spark, long_targets):
    wide = targets_wide(long_targets)
    assert wide.columns == ["yr_mo", "aht", "call_regen", "transfers", "applied_per_call",
                            "breakage"]
    row = targets_joinable(wide).filter("yr_mo = 201706").first()
    assert row.handle_time_avg_target == 13.0
    assert (row.calls_offer_applied_rate_target, row.call_breakage_rate_target,
            row.call_regen_rate_target, row.transfer_rate_target) == (0.505, 0.201, 0.167, 0.082)


def test_targets_reject_repeats_and_bad_months(spark, long_targets):
    with pytest.raises(Exception, match="repeated target"):
        targets_wide(long_targets.union(long_targets.limit(1))).collect()
    bad = spark.createDataFrame([(201713, "AHT", 1.0)], long_targets.schema)
    with pytest.raises(Exception, match="not a month"):
        targets_wide(bad).collect()


def test_target_join(log, long_targets):
    joined = with_targets(agent_daily_fact(log), targets_joinable(targets_wide(long_targets)))
    rows = joined.collect()
    assert len(rows) == 4
    for r in rows:
        matched = r.yr_mo == 201706
        assert (r.handle_time_avg_target == 13.0) if matched else r.handle_time_avg_target is None
        assert r.handle_time_avg_min == r.handle_time_avg / 60


def test_scorecard_golden(log):
    fact = agent_daily_fact(log)
    summary = agent_period_summary(of_agents(in_period(fact, *JUNE), ["A", "B"]))
    assert len(summary.columns) == 14
    totals = scorecard_totals(summary).first()
    assert totals.asDict() == dict(
        calls_by_day_avg=25.0, calls_total=45, calls_with_offer=40, calls_with_accept=22,
        calls_offer_applied=14, call_breakage_count=8)
    rates = scorecard_rates(summary).first()
    assert rates.handle_time_avg == pytest.approx(6.25)
    assert rates.call_regen == pytest.approx(0.0875)
    assert rates.call_transfer_rate == pytest.approx(0.1375)
    assert rates.call_breakage_rate == pytest.approx(0.375)
    assert rates.calls_offer_applied_rate == pytest.approx(0.175)
    assert (rates.calls_with_offer_rate_pct, rates.calls_with_offer_rate_sector) == (85.0, "warning")
    assert (rates.calls_with_accept_rate_pct, rates.calls_with_accept_rate_sector) == (27.5, "danger")
    assert (rates.calls_offer_applied_rate_pct, rates.calls_offer_applied_rate_sector) == (17.5, "danger")
    assert (rates.call_breakage_rate_pct, rates.call_breakage_rate_sector) == (37.5, "danger")
    text = scorecard_text(summary).first()
    assert text.handle_time_avg_text == "6.25" and text.call_regen_text == "8.8%"
    assert text.calls_offer_applied_rate_text == "Offer Applied Rate: 17.5%"


def test_scorecard_ieee(log):
    fact = agent_daily_fact(log, zero="ieee")
    rates = scorecard_rates(agent_period_summary(in_period(fact, *JUNE))).first()
    assert math.isnan(rates.call_breakage_rate) and rates.call_breakage_rate_sector is None


def test_empty_selection(log):
    summary = agent_period_summary(of_agents(agent_daily_fact(log), []))
    assert set(scorecard_totals(summary).first()) == {0}
    assert set(scorecard_rates(summary).first()) == {None}
    assert scorecard_text(summary).count() == 1


def test_choices(spark, log):
    assert [r[0] for r in agents_of_lead(log, "L2").collect()] == ["B"]
    rows = sorted(tuple(r) for r in filter_choices(log).collect())
    assert rows == [("date_end", 1, "2017-09-01"), ("date_start", 1, "2017-06-03"),
                    ("team_lead", 1, "L1"), ("team_lead", 2, "L2")]
    chosen = spark.createDataFrame([("B",), ("B",), ("Z",)], "agent_name string")
    assert of_agents(log, chosen).count() == 2


def test_row_order_does_not_matter(log):
    again = log.orderBy("calls_offer_applied").repartition(5)
    key = lambda r: (r.call_date, r.agent_name)
    assert sorted(agent_daily_fact(again).collect(), key=key) == sorted(
        agent_daily_fact(log).collect(), key=key)


def test_features_from_sums_by_lead(spark):
    """An agent under two leads and a missing rate: the same means as from the fact."""
    from opsmetrics.operators import features
    rates = ", ".join(f"{f} double" for f in features.FEATURES)
    rows = [("a", "x", *[0.2] * 6), ("a", "y", *[0.5] * 6), ("a", "y", None, *[0.8] * 5),
            ("b", "x", *[None] * 6)]
    fact = spark.createDataFrame(rows, f"agent_name string, team_lead_name string, {rates}")
    whole = {r.agent_name: r for r in features.agent_features(fact).collect()}
    summed = features.features_of_rates(features.agent_lead_rates(fact)).collect()
    assert len(summed) == 2
    for r in summed:
        for f in features.FEATURES:
            expected = whole[r.agent_name][f]
            assert r[f] is None if expected is None else r[f] == pytest.approx(expected)
