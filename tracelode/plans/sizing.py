"""Size-checked broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS_CONF = "spark.tracelode.maxBroadcastRows"
DEFAULT_BROADCAST_ROWS = 500_000


def broadcast_rows(df: DataFrame) -> int:
    """Most rows that a broadcast may have."""
    return int(df.sparkSession.conf.get(BROADCAST_ROWS_CONF, str(DEFAULT_BROADCAST_ROWS)))


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Mark ``df`` for broadcast only when its row count is measured to be small;
    otherwise leave the join strategy to Spark.  ``rows`` is the count, or an upper
    limit of it, when the caller has measured it already."""
    limit = broadcast_rows(df)
    small = rows <= limit if rows is not None else fits(df, limit)
    return F.broadcast(df) if small else df


def fits(df: DataFrame, limit: int) -> bool:
    """True when ``df`` has at most ``limit`` rows; stops counting beyond it."""
    return df.limit(limit + 1).count() <= limit
