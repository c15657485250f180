"""Display text built from numeric columns."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_text(value: Column | str, digits: int = 0) -> Column:
    """Thousands separators and a fixed number of decimals."""
    return F.format_number(value, digits)


def percent_text(ratio: Column | str, digits: int = 1) -> Column:
    """Percentage with fixed decimals, rounded half up in magnitude."""
    ratio = F.col(ratio) if isinstance(ratio, str) else ratio
    base = 10 ** digits
    units = F.floor(F.abs(ratio) * (100 * base) + 0.5).cast("bigint")
    whole = F.floor(units / base).cast("string")
    if digits:
        whole = F.concat(whole, F.lit("."),
                         F.lpad((units % base).cast("string"), digits, "0"))
    sign = F.when((ratio < 0) & (units > 0), "-").otherwise("")
    finite = F.concat(sign, whole, F.lit("%"))
    return (F.when(F.isnan(ratio), "NaN%")
             .when(F.abs(ratio) == float("inf"),
                   F.when(ratio > 0, "Inf%").otherwise("-Inf%"))
             .otherwise(finite))


def label(template: str, **columns: Column | str) -> Column:
    """Fill ``{name}`` slots from columns; a missing value prints as NA.

    A slot without an entry in ``columns`` reads the column of its own name.
    """
    parts = []
    for literal, slot, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if slot is not None:
            value = columns.get(slot, slot)
            value = F.col(value) if isinstance(value, str) else value
            parts.append(F.coalesce(value.cast("string"), F.lit("NA")))
    return F.concat(*parts)
