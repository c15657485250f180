"""Digits that a column of percentages needs."""

import math
import random

import pytest

from opsmetrics.operators.digits import percent_digits, smallest_gap, with_percent_text


def column(spark, values):
    return spark.createDataFrame([(v,) for v in values], "r double")


@pytest.mark.parametrize("values, digits, texts", [
    ([0.1, 0.25, 0.5], 0, ["10%", "25%", "50%"]),
    ([0.25, 0.255, 0.75], 1, ["25.0%", "25.5%", "75.0%"]),
    ([0.5, 0.5123, 0.9], 1, ["50.0%", "51.2%", "90.0%"]),
    ([0.1234, 0.1239], 2, ["12.34%", "12.39%"]),
    ([0.5, 0.5, None], 0, ["50%", "50%", None]),
    ([0.123], 0, ["12%"]),
    ([float("nan"), float("inf"), -0.02, 0.0], 0, ["NaN%", "Inf%", "-2%", "0%"]),
    ([1.0, 1.0 + 1e-12], 0, ["100%", "100%"]),
    ([None, None], 0, [None, None]),
    ([], 0, []),
])
def test_golden_texts(spark, values, digits, texts):
    df = column(spark, values)
    assert percent_digits(df, "r") == digits
    found = with_percent_text(df, "r", "t").collect()
    assert sorted(map(str, (r.t for r in found))) == sorted(map(str, texts))


def test_gap_over_many_ranges(spark):
    random.seed(5)
    values = [random.random() for _ in range(4000)] * 2
    distinct = sorted(set(values))
    expected = min(b - a for a, b in zip(distinct, distinct[1:]))
    keeps = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = column(spark, values)
        assert smallest_gap(df, df.r)[1] == expected
        # The smallest gap of two values is the one between two ranges.
        df = column(spark, [1.0, 2.0])
        assert smallest_gap(df, df.r)[1] == 1.0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", keeps)


def test_texts_differ_where_values_do(spark):
    random.seed(6)
    for _ in range(4):
        values = [round(random.random(), random.randrange(2, 6)) for _ in range(8)]
        found = with_percent_text(column(spark, values), "r", "t").collect()
        assert len({r.t for r in found}) == len(set(values))
        assert all(math.isclose(float(r.t[:-1]) / 100, r.r, abs_tol=5e-3) for r in found)
