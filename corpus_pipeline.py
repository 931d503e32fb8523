"""Cleaning of a document corpus in stages, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelode.llm import contamination, jaccard, packing, private, toxicity
from tracelode.llm.frames import load, small_batches
from tracelode.session import materialize
from tracelode.sources.tables import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


# Pre-tokens that a worker of the last stage remembers: executors still hold what earlier stages took.  Decides speed and memory only.
PACKING_CACHE = 100_000


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the clause grammar does not reject."""
    small_batches(spark)
    return toxicity.keep_civil(docs, toxicity.fit(docs, load(spark, folder, "labels", "doc_id", "toxic")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id."""
    small_batches(spark)
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return contamination.keep_clean(docs, load(spark, folder, "benchmark", "item_id", "text"))


def redact_private(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    small_batches(spark)
    return private.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Training sequences of what is left."""
    small_batches(spark)
    return packing.pack(docs, cache=PACKING_CACHE)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("private data", redact_private),
    ("packing", pack),
]

# Learned scores, edit distances and subword ids have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, folder, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
