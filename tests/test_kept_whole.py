"""Input that must fail or count in full rather than be lost."""

import pytest
from pyspark.sql import functions as F

from opsmetrics.operators import segments, series, targets
from opsmetrics.sources.schema import CALL_LOG, conform


def test_unknown_metric_fails(spark, long_targets):
    odd = long_targets.union(spark.createDataFrame(
        [(201706, "Aht", 1.0)], "yr_mo int, metric string, target double"))
    with pytest.raises(Exception, match="not a metric: Aht"):
        targets.targets_wide(odd).collect()
    named = targets.targets_wide(odd.filter("metric = 'Aht'"), ["Aht"]).first()
    assert named.aht == 1.0


def test_fraction_in_whole_numbers_fails(log):
    whole = log.withColumn("handle_time", F.col("handle_time").cast("double"))
    assert conform(whole, CALL_LOG).agg(F.sum("handle_time")).first()[0] == 24300
    with pytest.raises(Exception, match="handle_time has a fraction"):
        conform(whole.withColumn("handle_time", F.col("handle_time") + 0.7), CALL_LOG).collect()


def test_weeks_of_years_stay_apart(spark):
    weeks = spark.createDataFrame([(y, w, 10 * y + w) for y in (1, 2) for w in (1, 2)],
                                  "year int, week_num int, calls bigint")
    rows = series.calls_weekly_rolling(weeks).orderBy("year", "week_num").collect()
    assert [r.roll_mean_2 for r in rows] == [0.0, 11.5, 16.5, 21.5]


def test_missing_features_are_not_counted(spark):
    agents = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", None)],
                                   "agent_name string, v double")
    assigned = agents.select("agent_name", F.lit("1").alias("cluster"))
    row = segments.segment_quality(agents, assigned, ["v"]).first()
    assert row.withinss == pytest.approx(2.0)
    assert segments.segment_totals(agents, assigned, ["v"]).first().totss == pytest.approx(2.0)
