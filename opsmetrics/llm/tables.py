"""Reading the corpus tables and storing intermediate ones."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmetrics.storage import materialize

__all__ = ["FOLDS", "fold", "fold_of", "held_out", "materialize", "read"]

FOLDS = 5


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo the number of folds; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS, F.lit(-1))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold no classifier learns from."""
    return fold(doc_id) == 0


def fold_of(doc_id: int) -> int:
    """The same remainder in Python."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS
