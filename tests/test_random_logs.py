"""Random logs with a hot agent, zero calls, shared agents and ties, against plain Python."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from opsmetrics.operators import facts, features, ranking, series, summary
from opsmetrics.sources.schema import CALL_LOG

RATES = {
    "call_regen_rate": "call_regen", "calls_with_offer_rate": "calls_with_offer",
    "calls_with_accept_rate": "calls_with_accept",
    "calls_offer_applied_rate": "calls_offer_applied", "call_transfer_rate": "transfers",
}
MEASURES = CALL_LOG.fieldNames()[4:]


def make_rows(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(900):
        agent = "hot" if rng.random() < 0.35 else f"a{rng.randrange(25):02d}"
        lead = f"L{(hash_of(agent) + (rng.random() < 0.1)) % 3}"
        day = dt.date(2016, 11, 20) + dt.timedelta(rng.randrange(90))
        calls = rng.choice([0, 1, 5, 10])
        offer = rng.randint(0, calls)
        accept = rng.randint(0, offer)
        rows.append((day.year * 100 + day.month, day, lead, agent, calls, calls * 300,
                     rng.randint(0, calls), offer, accept, rng.randint(0, accept),
                     rng.randint(0, calls)))
    return rows


def hash_of(name):
    return sum(map(ord, name))


def ratio(n, d):
    return n / d if d else None


def mean(values):
    known = [v for v in values if v is not None]
    return sum(known) / len(known) if known else None


def plain_fact(rows):
    sums = defaultdict(lambda: [0] * len(MEASURES))
    for r in rows:
        sums[r[:4]] = [a + b for a, b in zip(sums[r[:4]], r[4:])]
    fact = {}
    for key, values in sums.items():
        day = dict(zip(MEASURES, values))
        for rate, count in RATES.items():
            day[rate] = ratio(day[count], day["calls"])
        day["call_breakage_rate"] = ratio(
            day["calls_with_accept"] - day["calls_offer_applied"], day["calls_with_accept"])
        fact[key] = day
    return fact


@pytest.fixture(scope="module", params=[1, 2, 3])
def case(request, spark):
    rows = make_rows(request.param)
    return rows, spark.createDataFrame(rows, CALL_LOG).repartition(7).cache()


def test_fact(case):
    rows, log = case
    expected = plain_fact(rows)
    got = facts.agent_daily_fact(log).collect()
    assert len(got) == len(expected)
    for r in got:
        day = expected[(r.yr_mo, r.call_date, r.team_lead_name, r.agent_name)]
        for name, value in day.items():
            column = "call_transfers" if name == "transfers" else name
            assert r[column] == pytest.approx(value)


def test_summary_and_features(case):
    rows, log = case
    by_agent = defaultdict(list)
    for key, day in plain_fact(rows).items():
        by_agent[key[3]].append(day)
    fact = facts.agent_daily_fact(log)
    for r in summary.agent_period_summary(fact).collect():
        days = by_agent[r.agent_name]
        assert r.calls_total == sum(d["calls"] for d in days)
        assert r.calls_avg == pytest.approx(mean([d["calls"] for d in days]))
        assert r.call_regen == pytest.approx(mean([d["call_regen_rate"] for d in days]))
    for r in features.agent_features(fact).collect():
        for rate in features.FEATURES:
            assert r[rate] == pytest.approx(mean([d[rate] for d in by_agent[r.agent_name]]))


def test_rolling_weeks(case):
    rows, log = case
    weeks = defaultdict(int)
    for r in rows:
        end = r[1] + dt.timedelta((5 - r[1].weekday()) % 7)
        weeks[(r[2], r[3], end)] += r[9]
    expected = {}
    for lead, agent in {k[:2] for k in weeks}:
        ends = sorted(k[2] for k in weeks if k[:2] == (lead, agent))
        for i, end in enumerate(ends):
            last = [weeks[(lead, agent, e)] for e in ends[max(0, i - 2):i + 1]]
            expected[(lead, agent, end)] = (last[-1], sum(last) / 3 if len(last) == 3 else None)
    got = {(r.team_lead_name, r.agent_name, r.week_end):
           (r.total_offers_applied, r.rolling_avg_3)
           for r in series.weekly_offers_rolling3(log).collect()}
    assert got == expected


@pytest.mark.parametrize("n", [1, 5, 100])
def test_top_agents(case, n):
    rows, log = case
    totals = defaultdict(lambda: [0, 0])
    for r in rows:
        totals[r[3]][0] += r[4]
        totals[r[3]][1] += r[9]
    least = sorted((t[0] for t in totals.values()), reverse=True)[:n][-1]
    kept = sorted(((a, t[0], t[1]) for a, t in totals.items() if t[0] >= least),
                  key=lambda t: (-t[2], t[0]))
    rest = [t for t in totals.values() if t[0] < least]
    if rest:
        kept.append(("Other", sum(t[0] for t in rest), sum(t[1] for t in rest)))
    got = ranking.top_agents(log, n).orderBy("agent_order").collect()
    assert [(r.agent_name, r.total_calls, r.offers_applied) for r in got] == kept
    assert [r["rank"] for r in got] == [*range(1, len(kept)), None]
    assert got[-1].cum_pct == 1.0
