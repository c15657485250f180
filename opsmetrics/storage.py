"""Tables in the shared folder: lineage cuts and the stored fact."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# The temporary folder of each local-mode application without the setting.
_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without the setting gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="opsmetrics-")
    return _LOCAL_FOLDERS[context.applicationId]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    Later steps that read the result several times then cost one computation, a
    lost executor re-reads files instead of replaying the lineage, and the planner
    sees true sizes when it chooses join strategies.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/opsmetrics-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_fact(fact: DataFrame, path: str) -> None:
    """Store a fact by month. The rebalance hint lets AQE split a hot month into
    several files and join thin months into one task."""
    (fact.hint("rebalance", "yr_mo")
        .write.mode("errorifexists").partitionBy("yr_mo").parquet(path))


def read_fact(spark: SparkSession, path: str,
              start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Read a stored fact; a date range also prunes the month folders.

    Pruning assumes ``yr_mo`` is the calendar month of ``call_date``.
    """
    fact = spark.read.parquet(path)
    if start is not None:
        fact = fact.filter((F.col("yr_mo") >= start.year * 100 + start.month)
                           & (F.col("call_date") >= F.lit(start)))
    if end is not None:
        fact = fact.filter((F.col("yr_mo") <= end.year * 100 + end.month)
                           & (F.col("call_date") <= F.lit(end)))
    return fact
