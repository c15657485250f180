"""Monthly targets: long to wide, units, names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The metrics of the target table.
TARGET_METRICS = ["AHT", "CALL_REGEN", "TRANSFERS", "APPLIED_PER_CALL", "BREAKAGE"]

# The target columns joined to the fact.
TARGET_COLUMNS = {
    "applied_per_call": "calls_offer_applied_rate_target",
    "breakage": "call_breakage_rate_target",
    "call_regen": "call_regen_rate_target",
    "transfers": "transfer_rate_target",
}


def targets_wide(targets: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """One row per month, one column per metric.

    A repeated (month, metric) fails the job, and so does a metric that is not among
    ``metrics`` or a ``yr_mo`` that is not a month of 1900-2199. The result therefore has at most 3,600 rows, which is what
    allows :func:`opsmetrics.operators.facts.with_targets` to broadcast it.
    """
    metrics = metrics or TARGET_METRICS
    month, metric = F.col("yr_mo"), F.col("metric")
    bad_metric = F.raise_error(F.concat(
        F.lit("not a metric: "), F.coalesce(metric, F.lit("NULL"))))
    valid = month.between(190001, 219912) & (month % 100).between(1, 12)
    bad_month = F.raise_error(F.concat(F.lit("not a month: "), month.cast("string")))
    repeated = F.raise_error(F.lit("repeated target for a month and metric"))
    value = (F.when(F.count(F.lit(1)) <= 1, F.first("target"))
              .otherwise(repeated.cast("double")))
    wide = (
        targets
        .withColumn("yr_mo", F.when(valid, month).otherwise(bad_month.cast("int")))
        .withColumn("metric", F.when(metric.isin(metrics), metric)
                    .otherwise(bad_metric.cast("string")))
        .groupBy("yr_mo").pivot("metric", metrics).agg(value))
    return wide.toDF(*[name.lower() for name in wide.columns])


def targets_joinable(wide: DataFrame) -> DataFrame:
    """Handle time in minutes and the names used next to the fact's own rates."""
    return (
        wide
        .withColumn("handle_time_avg_target", F.col("aht") / F.lit(60.0))
        .drop("aht")
        .withColumnsRenamed(TARGET_COLUMNS)
        .select("yr_mo", *TARGET_COLUMNS.values(), "handle_time_avg_target"))
