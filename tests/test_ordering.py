import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsmetrics.operators.features import METRIC_NAMES, agent_metric_long
from opsmetrics.operators.ordering import exact_quantiles, with_global_order
from opsmetrics.operators.ranking import lump_agents, top_agents
from opsmetrics.operators.facts import agent_daily_fact


def agents(spark, **totals):
    return spark.createDataFrame(
        [(name, calls, applied) for name, (calls, applied) in totals.items()],
        "agent_name string, calls bigint, calls_offer_applied bigint")


@pytest.mark.parametrize("ranges", [None, 1, 70])
def test_global_order_matches_a_sort(spark, ranges):
    rng = random.Random(3)
    rows = [(f"n{i:04d}", 0 if i % 3 == 0 else rng.randrange(20)) for i in range(500)]
    df = spark.createDataFrame(rows, "name string, v bigint").repartition(6)
    got = with_global_order(df, [F.desc("v"), "name"], "at", running={"cum": "v"},
                            ranges=ranges).orderBy("at").collect()
    expected = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [(r.name, r.v) for r in got] == expected
    assert [r["at"] for r in got] == list(range(1, 501))
    assert [r.cum for r in got] == list(np.cumsum([v for _, v in expected]))


def test_quantiles(spark):
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate([0.4, 0.9, None, 0.2, 0.6, 0.3])],
                               "name string, v double")
    rows = exact_quantiles(df, "v", "name", [0, 0.3, 0.6, 1]).collect()
    assert [r.quantile for r in rows] == pytest.approx([0.2, 0.32, 0.48, 0.9])
    assert [r.quantile for r in exact_quantiles(
        df.limit(0), "v", "name", [0.5]).collect()] == [None]


def test_top_agents_golden(spark):
    df = agents(spark, P=(100, 5), Q=(90, 50), R=(80, 20), S=(10, 60))
    rows = top_agents(df, 3).orderBy("agent_order").collect()
    assert [(r.agent_name, r.offers_applied, r["rank"]) for r in rows] == [
        ("Q", 50, 1), ("R", 20, 2), ("P", 5, 3), ("Other", 60, None)]
    assert [r.cum_pct for r in rows] == [50 / 135, 70 / 135, 75 / 135, 1.0]
    assert rows[-1].label_text == "Rank: NA\nOffers Applied: 60\nCumPct: 100.0%"
    assert rows[0].label_text == "Rank: 1\nOffers Applied: 50\nCumPct: 37.0%"


def test_top_agents_keeps_ties(spark):
    df = agents(spark, P=(100, 5), Q=(90, 50), R=(80, 20), S=(80, 60))
    rows = top_agents(df, 3).orderBy("agent_order").collect()
    assert [(r.agent_name, r["rank"]) for r in rows] == [
        ("S", 1), ("Q", 2), ("R", 3), ("P", None)]
    rows = top_agents(df, 3, null_rank="other_only").orderBy("agent_order").collect()
    assert rows[-1]["rank"] == 4
    with pytest.raises(ValueError):
        top_agents(df, 3, null_rank="never")


def test_lump_keeps_totals(spark):
    df = agents(spark, **{f"A{i}": (i % 7, i) for i in range(100)})
    lumped = lump_agents(df.union(df), 10).agg(F.sum("total_calls"), F.sum("offers_applied")).first()
    plain = df.agg(F.sum("calls") * 2, F.sum("calls_offer_applied") * 2).first()
    assert tuple(lumped) == tuple(plain)


def test_metric_long(log):
    rows = agent_metric_long(agent_daily_fact(log).filter("yr_mo = 201706")).collect()
    assert len(rows) == 10
    order = {r.metric: r.metric_order for r in rows}
    assert [m for m, _ in sorted(order.items(), key=lambda i: i[1])] == list(METRIC_NAMES.values())
    assert {r.agent_name: r.agent_order for r in rows} == {"A": 2, "B": 1}
    missing = [r for r in rows if r.pct is None]
    assert [(r.agent_name, r.metric, r.label_text) for r in missing] == [
        ("B", "Breakage Rate", "Agent: B\nBreakage Rate: NA")]
