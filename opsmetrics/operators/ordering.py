"""Exact global positions and running sums without one task sorting everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics.storage import materialize


def with_global_order(df: DataFrame, order_by: list[Column | str], position: str,
                      running: dict[str, str] | None = None, stored: bool = False,
                      ranges: int | None = None) -> DataFrame:
    """Add the 1-based ``position`` of each row under ``order_by`` and, for each
    ``{output: column}`` of ``running``, the running sum of the column.

    ``order_by`` should end in a unique column, which also spreads ties. The input is
    stored first unless it is ``stored`` already, as range bounds are sampled from it.
    Rows are range-partitioned (``ranges``, else as many as the session shuffles to, thin
    ones joined by AQE) and stored with their range number, each range is numbered on its
    own, and the totals of the ranges before it, one broadcast row per range, are added.
    """
    running = running or {}
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    df = df if stored else materialize(df)
    cut = df.repartitionByRange(*([ranges] if ranges else []), *order)
    ranged = materialize(cut.withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_rows"),
             *[F.sum(column).alias(f"_sum_{name}") for name, column in running.items()])
        .select("_range",
                F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows"),
                *[F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_sum_{name}")
                  for name in running]))
    numbered = _number(ranged, Window.partitionBy("_range").orderBy(*order), position, running)
    return (
        numbered.join(F.broadcast(offsets), "_range")
        .withColumns({position: F.col(position) + F.col("_rows"),
                      **{name: F.col(name) + F.col(f"_sum_{name}") for name in running}})
        .select(*df.columns, position, *running))


def _number(df: DataFrame, window, position: str, running: dict[str, str]) -> DataFrame:
    frame = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select(
        "*", F.row_number().over(window).cast("bigint").alias(position),
        *[F.sum(column).over(frame).alias(name) for name, column in running.items()])


def exact_quantiles(df: DataFrame, value: str, tie_break: str,
                    probabilities: list[float]) -> DataFrame:
    """Quantiles by linear interpolation between order statistics, one row each.

    Values are ordered across the cluster and only the rows at the needed positions
    are read, where the exact ``percentile`` aggregate would collect every distinct
    value in one task. No value at all gives NULL quantiles.
    """
    known = materialize(df.filter(F.col(value).isNotNull()).select(value, tie_break))
    last = max(known.count() - 1, 0)
    at = {p: int(last * p) for p in probabilities}
    ordered = with_global_order(known, [value, tie_break], "_at", stored=True)

    def value_at(index: int) -> Column:
        return F.max(F.when(F.col("_at") == index + 1, F.col(value)))

    wanted = sorted({i + 1 for low in at.values() for i in (low, min(low + 1, last))})
    rows = [
        F.struct(F.lit(float(p)).alias("probability"),
                 (value_at(low) + F.lit(last * p - low)
                  * (value_at(min(low + 1, last)) - value_at(low))).alias("quantile"))
        for p, low in at.items()]
    return (ordered.filter(F.col("_at").isin(wanted))
            .agg(F.array(*rows).alias("_rows"))
            .select(F.inline("_rows")))
