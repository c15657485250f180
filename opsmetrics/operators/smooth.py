"""Local regression (LOESS) of daily series."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tasks carry these functions with them, so workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The share of a normal or t distribution below the upper end of a band of 95 percent.
LEVEL = 0.975
# Rows of the smoother taken at a time.
ROWS = 512


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    value = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or tiny)
            c = (1 + step / c) or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def t_quantile(freedom: float, level: float = LEVEL) -> float:
    """Student's t quantile above one half, by halving where its tail is searched."""
    if not freedom > 0 or math.isinf(freedom):
        return math.nan
    low, high = 0.0, 1.0

    def tail(t: float) -> float:
        return incomplete_beta(freedom / 2, 0.5, freedom / (freedom + t * t)) / 2

    while tail(high) > 1 - level:
        low, high = high, 2 * high
    while high - low > 1e-13 * high:
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if tail(middle) > 1 - level else (low, middle)
    return (low + high) / 2


@F.pandas_udf(T.DoubleType())
def _t_of(freedom: pd.Series) -> pd.Series:
    """One quantile for each degrees of freedom, which all days of a series share."""
    return freedom.map({x: t_quantile(x) for x in freedom.dropna().unique()}).astype("float64")


def _levers(x: np.ndarray, rows: np.ndarray, q: int):
    """Rows of the smoother: the first of the ``q`` points each weighs, their weights (0 if
    the fit cannot be solved), the row's own weight, and whether it can be solved."""
    offsets = np.arange(q)
    # Start of each run of q points that contains the row and reaches least far.
    starts = np.clip(rows[:, None] - offsets[::-1], 0, len(x) - q)
    reach = np.maximum(x[rows, None] - x[starts], x[starts + q - 1] - x[rows, None])
    best = reach.argmin(axis=1)
    pick = np.arange(len(rows))
    first = starts[pick, best]
    run = first[:, None] + offsets
    bandwidth = reach[pick, best][:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        u = (x[run] - x[rows, None]) / bandwidth
        w = np.where(np.abs(u) < 1, (1 - np.abs(u) ** 3) ** 3, 0.0)
        s0, s1, s2, s3, s4 = ((w * u ** p).sum(axis=1) for p in range(5))
        c0, c1, c2 = s2 * s4 - s3 * s3, s2 * s3 - s1 * s4, s1 * s3 - s2 * s2
        det = s0 * c0 + s1 * c1 + s2 * c2
        lever = (w * (c0[:, None] + c1[:, None] * u + c2[:, None] * u * u)) / det[:, None]
        own = c0 / det
    solvable = ((w > 0).sum(axis=1) >= 3) & (det > 1e-12)
    return first, np.where(solvable[:, None], lever, 0.0), own, solvable


def local_quadratic(x: np.ndarray, y: np.ndarray, q: int,
                    targets: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fit, sum of squared weights and own weight at the ``targets`` among ``x``, sorted
    ascending.

    Each fit weighs the nearest ``q`` points by the tricube of their distance over the
    farthest one's. Those points are a run of the sorted ``x``, so the work is targets
    times the run length, done in blocks to bound memory.
    """
    fit, spread, own = (np.full(targets.stop - targets.start, np.nan) for _ in range(3))
    for first in range(targets.start, targets.stop, ROWS):
        rows = np.arange(first, min(first + ROWS, targets.stop))
        start, lever, of_own, solvable = _levers(x, rows, q)
        out = rows - targets.start
        run = start[:, None] + np.arange(q)
        fit[out] = np.where(solvable, (lever * y[run]).sum(axis=1), np.nan)
        spread[out] = np.where(solvable, (lever ** 2).sum(axis=1), np.nan)
        own[out] = np.where(solvable, of_own, np.nan)
    return fit, spread, own


def _residual_rows(x: np.ndarray, rows: np.ndarray, q: int, low: int, high: int) -> np.ndarray:
    """Rows of one less the smoother, in the columns ``low`` .. ``high`` - 1."""
    start, lever, _, _ = _levers(x, rows, q)
    dense = np.zeros((len(rows), high - low))
    column = start[:, None] + np.arange(q) - low
    row = np.broadcast_to(np.arange(len(rows))[:, None], column.shape)
    inside = (column >= 0) & (column < high - low)
    dense[row[inside], column[inside]] = -lever[inside]
    own = (rows >= low) & (rows < high)
    dense[np.flatnonzero(own), rows[own] - low] += 1
    return dense


def second_moment(x: np.ndarray, q: int, targets: slice) -> float:
    """The part of the targets in the sum of squares of R R', with R one less the smoother.

    R weighs a run of ``q`` days, so R R' is a band 2q wide, taken in blocks: a target with
    itself, and twice with each later day within the band.
    """
    total = 0.0
    for first in range(targets.start, targets.stop, ROWS):
        rows = np.arange(first, min(first + ROWS, targets.stop))
        low, high = max(0, first - q), min(len(x), int(rows[-1]) + q + 1)
        left = _residual_rows(x, rows, q, low, high)
        total += ((left @ left.T) ** 2).sum()
        end = min(int(rows[-1]) + 2 * q, len(x))
        for after in range(int(rows[-1]) + 1, end, ROWS):
            others = np.arange(after, min(after + ROWS, end))
            total += 2 * ((left @ _residual_rows(x, others, q, low, high).T) ** 2).sum()
    return float(total)


def loess(df: DataFrame, day: str = "call_date", value: str = "calls",
          keys: list[str] | None = None, span: float = 0.2, z: float | None = None,
          block_days: int = 256) -> DataFrame:
    """Smooth one daily series per combination of ``keys``.

    ``df`` holds one row per day and key, so a series is bounded by the calendar and not
    by the calls behind it. Adds ``smooth`` and the confidence band ``lower``..``upper``;
    NULL where fewer than three points carry weight. The band is ``z`` standard errors
    wide, by default the 95 percent t quantile. With R one less the smoother, the variance is
    the sum of squared residuals over d1, the sum of squares of R, and the degrees of freedom
    are d1 * d1 / d2, with d2 the sum of squares of R R'.

    Days are numbered and cut into blocks of ``block_days``, or of as many days as a fit
    weighs if that is more. A fit reads no farther than that, so a block is fitted in a
    group of its own, with the days of the blocks beside it; for its part of d2 it needs the
    rows of R for two blocks more. So a day goes to five groups at most, three with a given
    ``z``. The residuals of all blocks then give the band.
    """
    keys = keys or []
    series = Window.partitionBy(*keys)
    numbered = (
        df.select(*keys, day, value, F.unix_date(day).cast("double").alias("_x"))
        .withColumns({"_i": F.row_number().over(series.orderBy("_x")) - 1,
                      "_n": F.count(F.lit(1)).over(series)})
        .withColumn("_q", F.floor(F.lit(span) * F.col("_n") + 1e-5).cast("int"))
        .withColumn("_size", F.greatest(F.lit(block_days), "_q")))
    own_block = F.expr("_i div _size")
    dealt = numbered.withColumn("_block", F.explode(F.sequence(
        F.greatest(own_block - (3 if z is None else 1), F.lit(0).cast("bigint")),
        F.least(own_block + 1, F.expr("(_n - 1) div _size")))))
    schema = T.StructType([dealt.schema[c] for c in [*keys, day, value, "_n"]] + [
        T.StructField(name, T.DoubleType()) for name in ("smooth", "_spread", "_own", "_second")])

    def fit_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i", ignore_index=True)
        q, size, block = (int(pdf[c].iloc[0]) for c in ("_q", "_size", "_block"))
        inside = np.flatnonzero(pdf["_i"].to_numpy() // size == block)
        targets = slice(int(inside[0]), int(inside[-1]) + 1)
        found = pdf.iloc[targets]
        parts = [np.nan] * 3 if q < 3 else local_quadratic(
            pdf["_x"].to_numpy(float), pdf[value].to_numpy(float), q, targets)
        second = np.zeros(len(found))
        if z is None and q >= 3:
            second[0] = second_moment(pdf["_x"].to_numpy(float), q, targets)
        return found.assign(smooth=parts[0], _spread=parts[1], _own=parts[2],
                            _second=second)[schema.fieldNames()]

    # Numbered days lie together and are few bytes: without a given number of partitions
    # neither the planner nor AQE would spread the fits.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fitted = (dealt.repartition(tasks, *keys, "_block")
              .groupBy(*keys, "_block").applyInPandas(fit_block, schema))
    known = fitted.withColumns({
        c: F.when(~F.isnan(c), F.col(c)) for c in ("smooth", "_spread", "_own")})
    first = (F.col("_n") - 2 * F.coalesce(F.sum("_own").over(series), F.lit(0.0))
             + F.coalesce(F.sum("_spread").over(series), F.lit(0.0)))
    squares = F.sum((F.col(value) - F.col("smooth")) ** 2).over(series)
    second = F.sum("_second").over(series)
    found = known.withColumns({"_first": first, "_squares": squares}).withColumn(
        "_freedom", F.when(second > 0, F.col("_first") ** 2 / second))
    width = _t_of("_freedom") if z is None else F.lit(z)
    return (
        found.withColumn("_width", width)
        .withColumn("_band", F.when(F.col("_first") > 0, F.col("_width") * F.sqrt(
            F.col("_squares") / F.col("_first") * F.col("_spread"))))
        .select(*keys, day, value, "smooth", (F.col("smooth") - F.col("_band")).alias("lower"),
                (F.col("smooth") + F.col("_band")).alias("upper")))
