"""File readers for call logs and targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opsmetrics.sources.schema import CALL_LOG, TARGETS, conform
from opsmetrics.sources.sheet import SheetSource


def read_call_log(spark: SparkSession, path: str, fmt: str = "parquet",
                  strict: bool = False, **options: str) -> DataFrame:
    """Call rows from Parquet, ORC, CSV or the spreadsheet itself (``fmt="sheet"``).

    Columns are matched by name in any case and order, and cast to the declared types.
    Parquet and ORC files state their own types; CSV and sheet columns are read as text.
    ``options`` go to the source, for example the number or name of the ``sheet``.
    """
    return conform(_load(spark, path, fmt, options), CALL_LOG, strict)


def read_targets(spark: SparkSession, path: str, fmt: str = "csv",
                 strict: bool = False, **options: str) -> DataFrame:
    """Monthly targets in long form: one row per month and metric."""
    return conform(_load(spark, path, fmt, options), TARGETS, strict)


def register_sheet(spark: SparkSession) -> None:
    """Make the format ``sheet`` known to the session."""
    spark.dataSource.register(SheetSource)


def _load(spark: SparkSession, path: str, fmt: str, options: dict[str, str]) -> DataFrame:
    if fmt == "sheet":
        register_sheet(spark)
    if fmt == "csv":
        options = {"header": "true"} | options
    return spark.read.format(fmt).options(**options).load(path)
