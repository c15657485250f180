import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from opsmetrics.functions.calendar import month_name, week_end_saturday, week_number, year_month
from opsmetrics.functions.numbers import bin_by_limits, mean, safe_ratio, sector, total
from opsmetrics.functions.text import label, number_text, percent_text
from opsmetrics.operators.summary import GAUGE_SECTORS


def test_safe_ratio_null_and_ieee(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 2.0), (2, 1.0, 0.0), (3, -1.0, 0.0), (4, 0.0, 0.0), (5, None, 0.0),
         (6, 1.0, None)], "id int, n double, d double")
    rows = df.select("id", safe_ratio("n", "d").alias("null"),
                     safe_ratio("n", "d", "ieee").alias("ieee")).orderBy("id").collect()
    assert [r["null"] for r in rows] == [0.5, None, None, None, None, None]
    ieee = [r["ieee"] for r in rows]
    assert ieee[:3] == [0.5, math.inf, -math.inf]
    assert math.isnan(ieee[3]) and ieee[4:] == [None, None]
    with pytest.raises(ValueError):
        safe_ratio("n", "d", "other")


def test_missing_policies(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "k string, v bigint")
    rows = {r["k"]: r for r in df.groupBy("k").agg(
        total("v").alias("skip"), total("v", "propagate").alias("propagate"),
        mean("v", "propagate").alias("mean")).collect()}
    assert (rows["a"]["skip"], rows["a"]["propagate"], rows["a"]["mean"]) == (1, None, None)
    assert (rows["b"]["skip"], rows["b"]["propagate"], rows["b"]["mean"]) == (2, 2, 2.0)


def test_calendar(spark):
    days = {"2017-01-01": (1, "2017-01-07"), "2017-01-07": (1, "2017-01-07"),
            "2017-01-08": (2, "2017-01-14"), "2016-12-31": (53, "2016-12-31"),
            "2017-12-31": (53, "2018-01-06"), "2017-06-04": (23, "2017-06-10")}
    df = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in days], "d date")
    for row in df.select("d", week_number("d").alias("w"), week_end_saturday("d").alias("e"),
                         year_month("d").alias("ym"), month_name("d").alias("m")).collect():
        week, end = days[str(row.d)]
        assert (row.w, str(row.e)) == (week, end)
        assert row.ym == row.d.year * 100 + row.d.month
        assert row.m == row.d.strftime("%B")


def test_text(spark):
    df = spark.createDataFrame([(1234567.891, 0.1235, None), (0.5, -0.25, "x")],
                               "n double, p double, s string")
    rows = df.select(number_text("n", 2).alias("n"), percent_text("p").alias("p"),
                     percent_text("p", 0).alias("p0"),
                     label("s: {s}, {p}", p=percent_text("p")).alias("l")).collect()
    assert [tuple(r) for r in rows] == [
        ("1,234,567.89", "12.4%", "12%", "s: NA, 12.4%"),
        ("0.50", "-25.0%", "-25%", "s: x, -25.0%")]
    odd = spark.createDataFrame([(float("nan"),), (float("-inf"),), (None,), (-0.0001,)], "p double")
    assert [r[0] for r in odd.select(percent_text("p")).collect()] == [
        "NaN%", "-Inf%", None, "0.0%"]


def test_bins_and_sectors(spark):
    df = spark.createDataFrame([(0.4,), (0.4001,), (0.512,), (0.513,), (None,)], "r double")
    limits = [(0.4, "low"), (0.512, "medium")]
    assert [r[0] for r in df.select(bin_by_limits("r", limits, "high")).collect()] == [
        "low", "medium", "medium", "high", "high"]
    offer = GAUGE_SECTORS["calls_with_offer_rate"]
    breakage = GAUGE_SECTORS["call_breakage_rate"]
    df = spark.createDataFrame(
        [(90.0,), (75.0,), (74.9,), (20.0,), (30.0,), (float("nan"),), (None,), (101.0,)],
        "p double")
    rows = df.select(sector("p", offer).alias("o"), sector("p", breakage).alias("b")).collect()
    assert [r.o for r in rows] == ["success", "warning", "danger", "danger", "danger",
                                   None, None, None]
    assert [r.b for r in rows] == ["danger", "danger", "danger", "success", "warning",
                                   None, None, None]


def test_half_even(spark):
    rows = spark.createDataFrame([(0.0125,), (0.0135,), (0.0875,)], "x double").select(
        F.bround("x", 3)).collect()
    assert [r[0] for r in rows] == [0.012, 0.014, 0.088]
