"""Ratios and missing-value policies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def safe_ratio(numerator: Column | str, denominator: Column | str,
               zero: str = "null") -> Column:
    """Division that survives a zero denominator under ANSI mode.

    ``zero="null"`` gives NULL; ``zero="ieee"`` gives NaN or a signed infinity.
    """
    n = _column(numerator).cast("double")
    d = _column(denominator).cast("double")
    if zero == "null":
        return F.try_divide(n, d)
    if zero != "ieee":
        raise ValueError(f"unknown zero policy: {zero}")
    return (F.when(d != 0.0, n / d)
             .when(n.isNull() | d.isNull(), F.lit(None).cast("double"))
             .when(F.isnan(n) | (n == 0.0), F.lit(float("nan")))
             .when(n > 0.0, F.lit(float("inf")))
             .otherwise(F.lit(float("-inf"))))


def total(value: Column | str, na: str = "skip") -> Column:
    """Sum. ``na="propagate"`` makes one missing input blank the whole group."""
    return _missing_policy(F.sum, _column(value), na)


def mean(value: Column | str, na: str = "skip") -> Column:
    """Mean, with the missing-value policies of :func:`total`."""
    return _missing_policy(F.avg, _column(value), na)


def _missing_policy(aggregate, value: Column, na: str) -> Column:
    if na == "skip":
        return aggregate(value)
    if na != "propagate":
        raise ValueError(f"unknown missing-value policy: {na}")
    return F.when(F.count(value) == F.count(F.lit(1)), aggregate(value))


def bin_by_limits(value: Column | str, limits: list[tuple[float, str]],
                  above: str) -> Column:
    """First label whose upper limit is not exceeded; missing falls to ``above``."""
    value = _column(value)
    (limit, name), *rest = limits
    chain = F.when(value <= F.lit(limit), name)
    for limit, name in rest:
        chain = chain.when(value <= F.lit(limit), name)
    return chain.otherwise(above)


def sector(percent: Column | str, sectors: list[tuple[str, float, float]]) -> Column:
    """Name of the first closed interval holding ``percent``; list the best first
    so that a shared boundary goes to the better one. NULL and NaN give NULL."""
    percent = _column(percent)
    (name, low, high), *rest = sectors
    chain = F.when(percent.between(low, high), name)
    for name, low, high in rest:
        chain = chain.when(percent.between(low, high), name)
    return chain
