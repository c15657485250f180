import datetime as dt

import pytest

from opsmetrics.sources.readers import read_call_log, read_targets
from opsmetrics.sources.schema import CALL_LOG, TARGETS, conform, lower_names
from opsmetrics.storage import materialize, read_fact, shared_folder, write_fact
from opsmetrics.operators.facts import agent_daily_fact


def test_header_case_and_collision(spark):
    assert lower_names(spark.range(1).toDF("YR_MO")).columns == ["yr_mo"]
    with pytest.raises(ValueError, match="calls"):
        lower_names(spark.range(1).selectExpr("id AS Calls", "id AS calls"))


def test_csv_by_name_in_any_order(spark, log, tmp_path):
    path = str(tmp_path / "log")
    shuffled = log.select(*reversed(log.columns)).toDF(
        *[c.upper() for c in reversed(log.columns)])
    shuffled.coalesce(1).write.option("header", True).csv(path)
    read = read_call_log(spark, path, "csv")
    assert [(f.name, f.dataType) for f in read.schema] == [
        (f.name, f.dataType) for f in CALL_LOG]
    assert sorted(read.collect()) == sorted(log.collect())


def test_parquet_and_targets(spark, log, long_targets, tmp_path):
    log.write.parquet(str(tmp_path / "p"))
    assert sorted(read_call_log(spark, str(tmp_path / "p")).collect()) == sorted(log.collect())
    long_targets.write.option("header", True).csv(str(tmp_path / "t"))
    targets = read_targets(spark, str(tmp_path / "t"))
    assert targets.schema.fieldNames() == TARGETS.fieldNames()
    assert targets.count() == 15


def test_missing_column_and_strict(spark):
    with pytest.raises(ValueError, match="target"):
        conform(spark.createDataFrame([(1, "a")], "yr_mo int, metric string"), TARGETS)
    df = spark.createDataFrame([(None, "a", 1.0)], "yr_mo int, metric string, target double")
    assert conform(df, TARGETS).count() == 1
    with pytest.raises(Exception, match="yr_mo is missing"):
        conform(df, TARGETS, strict=True).collect()


def test_timestamp_becomes_date(spark, log):
    stamped = log.withColumn("call_date", log.call_date.cast("timestamp"))
    assert conform(stamped, CALL_LOG).schema["call_date"].dataType == CALL_LOG["call_date"].dataType


def test_materialize_uses_the_shared_folder(spark, log):
    stored = materialize(log)
    assert all(shared_folder(spark).removeprefix("file:") in f for f in stored.inputFiles())
    assert sorted(stored.collect()) == sorted(log.collect())


def test_stored_fact_prunes_months(spark, log, tmp_path):
    path = str(tmp_path / "fact")
    fact = agent_daily_fact(log)
    write_fact(fact, path)
    part = read_fact(spark, path, dt.date(2017, 6, 4), dt.date(2017, 6, 30))
    assert part.count() == 2
    assert "PartitionFilters: [isnotnull(yr_mo" in (
        part._jdf.queryExecution().executedPlan().toString())
    assert sorted(read_fact(spark, path).select(*fact.columns).collect(), key=str) == sorted(
        fact.collect(), key=str)
