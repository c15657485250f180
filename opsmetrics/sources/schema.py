"""Declared input schemas and the checks applied on ingest."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CALL_LOG = T.StructType([
    T.StructField("yr_mo", T.IntegerType(), False),
    T.StructField("call_date", T.DateType(), False),
    T.StructField("team_lead_name", T.StringType(), False),
    T.StructField("agent_name", T.StringType(), False),
    T.StructField("calls", T.LongType(), False),
    T.StructField("handle_time", T.LongType(), False),
    T.StructField("call_regen", T.LongType(), False),
    T.StructField("calls_with_offer", T.LongType(), False),
    T.StructField("calls_with_accept", T.LongType(), False),
    T.StructField("calls_offer_applied", T.LongType(), False),
    T.StructField("transfers", T.LongType(), False),
])

TARGETS = T.StructType([
    T.StructField("yr_mo", T.IntegerType(), False),
    T.StructField("metric", T.StringType(), False),
    T.StructField("target", T.DoubleType(), True),
])


def lower_names(df: DataFrame) -> DataFrame:
    """Lower-case every column name; names that then collide are an error."""
    names = [name.lower() for name in df.columns]
    repeated = sorted(name for name, n in Counter(names).items() if n > 1)
    if repeated:
        raise ValueError(f"columns differ only by case: {', '.join(repeated)}")
    return df.toDF(*names)


def conform(df: DataFrame, schema: T.StructType, strict: bool = False) -> DataFrame:
    """Project ``df`` onto ``schema`` by name and type.

    ``strict`` makes a NULL in a required column fail the job. It is off by default
    because such checks keep filters on those columns from reaching the scan. A number
    with a fraction in a column of whole numbers always fails the job.
    """
    df = lower_names(df)
    absent = [name for name in schema.fieldNames() if name not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")

    def column(field: T.StructField):
        value = F.col(field.name)
        fractional = isinstance(df.schema[field.name].dataType, T.FractionalType)
        if fractional and isinstance(field.dataType, T.IntegralType):
            problem = F.raise_error(F.lit(f"{field.name} has a fraction")).cast("double")
            value = F.when(value != F.floor(value), problem).otherwise(value)
        value = value.cast(field.dataType)
        if strict and not field.nullable:
            problem = F.raise_error(F.lit(f"{field.name} is missing")).cast(field.dataType)
            value = F.when(value.isNull(), problem).otherwise(value)
        return value.alias(field.name)

    return df.select(*[column(field) for field in schema])
