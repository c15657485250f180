"""Documents through the corpus operators, stage by stage.

A stage takes what the one before it kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opsmetrics.llm import decontamination, mixing, near_dedup, secret_scan, toxicity
from opsmetrics.llm.queries import MIX_PERCENT, MOST_EPOCHS, SOURCE_WEIGHTS, TOXIC_LIMIT
from opsmetrics.llm.tables import materialize, read

# Near duplicates share four fifths of their shingles of five words.
SHINGLE_WORDS, NEAR_PERCENT = 5, 80

# The stages learn and compare where classes need it; no closed SQL says the same.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject. The classifier learns from
    the labelled documents of the whole table."""
    model = toxicity.fit_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model, TOXIC_LIMIT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    return near_dedup.drop_near_duplicates(docs, SHINGLE_WORDS, NEAR_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, findings in their texts replaced by a mark."""
    return secret_scan.redact(docs, secret_scan.fit_network(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with the words it takes of each and its source's target."""
    return mixing.mix(docs, SOURCE_WEIGHTS, MIX_PERCENT, MOST_EPOCHS).filter("taken > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
