import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from opsmetrics.operators import series, smooth


def weeks(spark, *calls):
    return spark.createDataFrame(list(enumerate(calls, 1)), "week_num int, calls bigint")


def test_pct_change(spark):
    rows = weeks(spark, 10, 20, 15).transform(series.pct_change("week_num")).orderBy("week_num")
    assert [(r.calls_lag_1, r.diff_1, r.pct_diff_1, r.pct_diff_1_chr) for r in rows.collect()] == [
        (10, 0, 0.0, "0.0%"), (10, 10, 1.0, "100.0%"), (20, -5, -0.25, "-25.0%")]


def test_trailing_means(spark):
    rows = series.calls_weekly_rolling(weeks(spark, 10, 20, 30, 40, 50)).orderBy("week_num").collect()
    assert [r.roll_mean_2 for r in rows] == [0, 15, 25, 35, 45]
    assert [r.roll_mean_4 for r in rows] == [0, 0, 0, 25, 35]
    window = Window.orderBy("week_num")
    df = weeks(spark, 10, 20, 30, 40, 50)
    assert [r[0] for r in df.select(series.trailing_mean("calls", 3, window)).collect()] == [
        None, None, 20, 30, 40]
    holed = weeks(spark, 10, 20, None, 40, 50, 60)
    assert [r[0] for r in holed.select(series.trailing_mean("calls", 2, window)).collect()] == [
        None, 15, None, None, 45, 55]
    assert [r[0] for r in holed.select(series.trailing_mean("calls", 2, window, 0.0)).collect()] == [
        0, 15, None, None, 45, 55]


def test_monthly(spark):
    log = spark.createDataFrame(
        [(dt.date(2016, 11, 3), 4), (dt.date(2016, 11, 9), 6), (dt.date(2016, 12, 1), 20),
         (dt.date(2017, 1, 5), 5), (dt.date(2017, 11, 7), 7), (dt.date(2017, 12, 8), 8)],
        "call_date date, calls bigint")
    monthly = series.calls_monthly(log)

    def column(df, name):
        return [r[name] for r in df.orderBy("year", "month_num").collect()]

    assert column(monthly, "calls") == [10, 20, 5, 7, 8]
    assert column(monthly, "month") == ["November", "December", "January", "November", "December"]
    versus = series.calls_monthly_vs_first(monthly)
    assert column(versus, "calls_first") == [10, 10, 5, 5, 5]
    assert column(versus, "pct_diff_first_chr") == ["0.0%", "100.0%", "0.0%", "40.0%", "60.0%"]
    assert column(series.calls_monthly_cumulative(monthly), "cumulative_calls") == [10, 30, 5, 12, 20]
    assert column(series.calls_cumulative_by_month(monthly), "cumulative_calls") == [10, 20, 5, 17, 28]


def test_weekly_pools_years(spark):
    log = spark.createDataFrame([(dt.date(2016, 1, 3), 1), (dt.date(2017, 1, 1), 2)],
                                "call_date date, calls bigint")
    assert [tuple(r) for r in series.calls_weekly(log).collect()] == [(1, 3)]
    assert series.calls_weekly(log, by_year=True).count() == 2


def test_rolling_three_weeks_per_lead_and_agent(spark):
    def rows(lead, agent, *values):
        return [(lead, agent, dt.date(2017, 6, 4) + dt.timedelta(7 * i), v)
                for i, v in enumerate(values)]
    log = spark.createDataFrame(
        rows("L1", "A", 10, 20, 30, 40) + rows("L2", "A", 1, 2) + rows("L1", "B", 3, 3, 3),
        "team_lead_name string, agent_name string, call_date date, calls_offer_applied bigint")
    got = {}
    for r in series.weekly_offers_rolling3(log).orderBy("week_end").collect():
        got.setdefault((r.team_lead_name, r.agent_name), []).append(r.rolling_avg_3)
    assert got == {("L1", "A"): [None, None, 20, 30], ("L2", "A"): [None, None],
                   ("L1", "B"): [None, None, 3]}


def test_day_label(log):
    row = series.calls_per_day(log).filter("call_date = '2017-06-03'").first()
    assert (row.calls, row.label_text) == (20, "Date: 2017-06-03\nCalls: 20")


def test_local_quadratic_against_least_squares():
    rng = np.random.default_rng(5)
    x = np.sort(rng.choice(900, size=300, replace=False)).astype(float)
    y = 50 + 10 * np.sin(x / 60) + rng.normal(size=300)
    q = 60
    fit, spread, own = smooth.local_quadratic(x, y, q, slice(0, 300))
    for i in range(300):
        distance = np.abs(x - x[i])
        h = np.sort(distance)[q - 1]
        w = np.where(distance < h, (1 - np.minimum(distance / h, 1) ** 3) ** 3, 0)
        design = np.vander((x - x[i]) / h, 3, increasing=True) * np.sqrt(w)[:, None]
        beta = np.linalg.lstsq(design, y * np.sqrt(w), rcond=None)[0]
        assert fit[i] == pytest.approx(beta[0], abs=1e-8)
    assert (spread > 0).all() and (own > 0).all()


def test_loess_per_key(spark):
    start = dt.date(2017, 1, 1)
    rows = [(key, start + dt.timedelta(i), float(scale * (i * i - 3 * i + 2)))
            for key, scale in [("a", 1), ("b", 2)] for i in range(60)]
    rows += [("short", start + dt.timedelta(i), 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "key string, call_date date, calls double")
    got = smooth.loess(df.repartition(4), keys=["key"]).collect()
    assert len(got) == 125
    for r in got:
        if r.key == "short":
            assert r.smooth is None and r.lower is None
        else:
            assert r.smooth == pytest.approx(r.calls, abs=1e-8 * max(1, abs(r.calls)))
    assert smooth.loess(df.filter("key = 'a'").drop("key")).filter(
        F.col("smooth").isNull()).count() == 0


def test_loess_blocks_give_what_one_block_gives(spark):
    rng = np.random.default_rng(6)
    start = dt.date(2017, 1, 1)
    days = rng.choice(900, size=400, replace=False)
    df = spark.createDataFrame(
        [(start + dt.timedelta(int(d)), float(rng.normal())) for d in days],
        "call_date date, calls double")
    whole, cut = (smooth.loess(df, span=0.1, block_days=b).orderBy("call_date").collect()
                  for b in (1000, 30))
    assert len(whole) == len(cut) == 400
    for a, b in zip(whole, cut):
        assert a[:3] == b[:3]
        assert (a.lower, a.upper) == pytest.approx((b.lower, b.upper), abs=1e-9)


def test_one_series_is_fitted_in_several_groups(spark):
    days = spark.sql("SELECT date_add(DATE'2017-01-01', CAST(id AS int)) AS call_date, "
                     "CAST(id AS double) AS calls FROM range(900)")
    plan = smooth.loess(days)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_block" in plan
    assert smooth.loess(days.limit(0)).collect() == []


def test_t_quantiles():
    known = [(1.0, 12.706204736432095), (2.0, 4.302652729911275), (3.0, 3.182446305284263),
             (5.0, 2.570581835636314), (10.0, 2.228138851964939), (30.0, 2.042272456301238),
             (1000.0, 1.962339080837478)]
    for freedom, t in known:
        assert smooth.t_quantile(freedom) == pytest.approx(t, abs=1e-9)
    # At two degrees the quantile is algebraic for every level.
    for level in (0.6, 0.9, 0.999):
        tail = 4 * level * (1 - level)
        assert smooth.t_quantile(2, level) == pytest.approx(
            (2 * level - 1) * (2 / tail) ** 0.5, abs=1e-9)
    assert smooth.t_quantile(1e7) == pytest.approx(1.959963984540054, abs=1e-6)
    assert smooth.t_quantile(0.0) != smooth.t_quantile(0.0)


def test_band_against_a_dense_product(spark, monkeypatch):
    """Both moments of the residual operator, and the whole band, on 300 days; in one block
    and in blocks as long as a fit."""
    rng = np.random.default_rng(7)
    x = np.sort(rng.choice(900, size=300, replace=False)).astype(float)
    y = rng.normal(size=300)
    q = 30
    residual = np.eye(300)
    fit, spread, _ = smooth.local_quadratic(x, y, q, slice(0, 300))
    for j in range(300):
        residual[:, j] -= smooth.local_quadratic(x, np.eye(300)[j], q, slice(0, 300))[0]
    product = residual @ residual.T
    d1, d2 = np.trace(product), (product ** 2).sum()
    monkeypatch.setattr(smooth, "ROWS", 37)
    assert smooth.second_moment(x, q, slice(0, 300)) == pytest.approx(d2, rel=1e-9)
    parts = [smooth.second_moment(x, q, slice(a, min(a + 41, 300))) for a in range(0, 300, 41)]
    assert sum(parts) == pytest.approx(d2, rel=1e-9)
    band = smooth.t_quantile(d1 * d1 / d2) * np.sqrt(((y - fit) ** 2).sum() / d1 * spread)
    df = spark.createDataFrame(
        [(dt.date(1970, 1, 1) + dt.timedelta(int(d)), float(v)) for d, v in zip(x, y)],
        "call_date date, calls double")
    for block in (1000, 30):
        rows = smooth.loess(df, span=0.1, block_days=block).orderBy("call_date").collect()
        assert [r.lower for r in rows] == pytest.approx(list(fit - band), abs=1e-8)
        assert [r.upper for r in rows] == pytest.approx(list(fit + band), abs=1e-8)


def test_band_takes_the_t_quantile_unless_told(spark):
    days = spark.sql("SELECT date_add(DATE'2017-01-01', CAST(id AS int)) AS call_date, "
                     "CAST(id * id % 17 AS double) AS calls FROM range(40)")
    by_t, by_z, wider = (smooth.loess(days, span=0.5, **z).orderBy("call_date").collect()
                         for z in ({}, {"z": 1.96}, {"z": 3.92}))
    for t, one, two in zip(by_t, by_z, wider):
        assert t.smooth == one.smooth and t.upper > one.upper
        assert two.upper - two.smooth == pytest.approx(2 * (one.upper - one.smooth))
