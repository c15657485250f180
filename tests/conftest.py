import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from opsmetrics.sources.schema import CALL_LOG  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("opsmetrics-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def no_cache_is_left():
    """A table that one test caches would replace the scans another test looks at."""
    yield
    session = SparkSession.getActiveSession()
    if session is not None:
        session.catalog.clearCache()


def day(text):
    return dt.date.fromisoformat(text)


@pytest.fixture(scope="session")
def log(spark):
    """Two leads, two agents, a repeated agent-day, no accepted calls on one day, and a
    month without a target."""
    rows = [
        (201706, day("2017-06-03"), "L1", "A", 10, 6000, 2, 9, 8, 5, 1),
        (201706, day("2017-06-03"), "L1", "A", 10, 3000, 1, 7, 4, 4, 0),
        (201706, day("2017-06-04"), "L1", "A", 20, 9000, 4, 20, 10, 5, 2),
        (201706, day("2017-06-04"), "L2", "B", 5, 1500, 0, 4, 0, 0, 1),
        (201709, day("2017-09-01"), "L2", "B", 10, 4800, 1, 10, 8, 6, 1),
    ]
    return spark.createDataFrame(rows, CALL_LOG)


@pytest.fixture(scope="session")
def long_targets(spark):
    rows = [(month, metric, float(value)) for month, values in {
        201706: (780, 0.167, 0.082, 0.505, 0.201),
        201707: (783, 0.162, 0.081, 0.509, 0.199),
        201708: (775, 0.159, 0.075, 0.511, 0.198),
    }.items() for metric, value in zip(
        ["AHT", "CALL_REGEN", "TRANSFERS", "APPLIED_PER_CALL", "BREAKAGE"], values)]
    return spark.createDataFrame(rows, "yr_mo int, metric string, target double")
