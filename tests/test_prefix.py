import datetime as dt
import random
import re

import pytest

from opsmetrics.operators.facts import agent_daily_fact
from opsmetrics.operators.prefix import (
    _edges, _whole_months, running_totals, summary_of_period, write_running_totals)
from opsmetrics.operators.selection import in_period
from opsmetrics.operators.summary import agent_period_summary
from opsmetrics.sources.schema import CALL_LOG
from opsmetrics.storage import write_fact

FIRST = dt.date(2016, 11, 1)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Three agents with gaps of months, one under two leads, days without calls."""
    random.seed(43)
    rows = []
    for agent, skip in (("A", 3), ("B", 40), ("C", 7)):
        day = FIRST
        while day < dt.date(2018, 3, 10):
            if not (agent == "C" and day.year == 2017 and 3 <= day.month <= 6):
                calls = random.choice([0, 5, 10, 37])
                accepted = random.randrange(calls + 1)
                rows.append((day.year * 100 + day.month, day, random.choice(["x", "y"]), agent,
                             calls, calls * 300, calls // 3, calls, accepted, accepted // 2, 1))
            day += dt.timedelta(days=random.randrange(1, skip + 1))
    folder = tmp_path_factory.mktemp("totals")
    write_fact(agent_daily_fact(spark.createDataFrame(rows, CALL_LOG)), str(folder / "fact"))
    fact = spark.read.parquet(str(folder / "fact"))
    write_running_totals(fact, str(folder / "totals"))
    return str(folder / "fact"), str(folder / "totals")


def by_agent(summary):
    return {r.agent_name: r.asDict() for r in summary.collect()}


def test_ranges_equal_a_pass_over_the_days(spark, stored):
    fact = spark.read.parquet(stored[0]).cache()
    random.seed(47)
    ranges = [(FIRST, dt.date(2018, 3, 31)), (dt.date(2017, 1, 1), dt.date(2017, 1, 31)),
              (dt.date(2017, 5, 9), dt.date(2017, 5, 2)), (dt.date(2010, 1, 5), FIRST),
              (dt.date(2018, 3, 1), dt.date(2025, 1, 7)), (dt.date(2019, 1, 1),
                                                           dt.date(2020, 1, 1))]
    for _ in range(6):
        days = sorted(random.randrange(-40, 560) for _ in range(2))
        ranges.append(tuple(FIRST + dt.timedelta(days=d) for d in days))
    for start, end in ranges:
        expected = by_agent(agent_period_summary(in_period(fact, start, end)))
        found = by_agent(summary_of_period(spark, *stored, start, end))
        assert set(found) == set(expected), (start, end)
        for agent, row in expected.items():
            assert list(found[agent]) == list(row)
            for name, value in row.items():
                assert found[agent][name] == pytest.approx(value, abs=1e-9), (start, end, name)


def test_whole_months_and_edges_cover_each_day_once():
    random.seed(53)
    for _ in range(2000):
        start = FIRST + dt.timedelta(days=random.randrange(800))
        end = start + dt.timedelta(days=random.randrange(200))
        first, last = _whole_months(start, end)
        if first > last:
            continue
        days = [d for a, b in _edges(start, end, first, last)
                for d in range(a.toordinal(), b.toordinal() + 1)]
        for m in range(first, last + 1):
            after = dt.date((m + 1) // 12, (m + 1) % 12 + 1, 1).toordinal()
            days += range(dt.date(m // 12, m % 12 + 1, 1).toordinal(), after)
        assert sorted(days) == list(range(start.toordinal(), end.toordinal() + 1))


def test_only_cut_months_are_read(spark, stored):
    found = summary_of_period(spark, *stored, dt.date(2016, 12, 5), dt.date(2018, 2, 3))
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert len(filters) == 4, plan
    bounds = [sorted(re.findall(r"\d{6}\b(?=\))", f)) for f in filters]
    assert sorted(map(set, bounds), key=sorted) == [
        {"201612"}, {"201612"}, {"201801"}, {"201802"}], filters


def test_empty_fact_and_rates_that_are_not_finite(spark, log, tmp_path):
    empty = agent_daily_fact(log.limit(0))
    assert running_totals(empty).count() == 0
    with pytest.raises(Exception, match="call_breakage_rate is not finite"):
        running_totals(agent_daily_fact(log, zero="ieee")).collect()
