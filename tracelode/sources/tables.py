"""Loaders for the star-schema tables and their stand-in roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.session import prepare


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micros(column: str) -> Column:
    """Epoch microseconds of a zone-less timestamp read as UTC."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def events(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Event stream with ``ts_us``; ``columns`` prunes the scan."""
    keep = list(columns) or ["event_id", "user_id", "event_type", "value"]
    return table(spark, folder, "events").select(*keep, micros("ts").alias("ts_us"))


def payloads(spark: SparkSession, folder: str, name: str = "customer") -> DataFrame:
    """Fixed-width byte strings: (session, seq, payload)."""
    prefix = {"customer": "c", "supplier": "s"}[name]
    key = {"customer": "c_custkey", "supplier": "s_suppkey"}[name]
    return table(spark, folder, name).select(
        F.col(f"{prefix}_nationkey").alias("session"),
        F.col(key).alias("seq"),
        F.col(f"{prefix}_name").cast("binary").alias("payload"),
    )
