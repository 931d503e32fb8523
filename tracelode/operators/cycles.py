"""Cycle segmentation, volume analysis, capture merging and splitting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.operators.patterns import occurrences
from tracelode.plans.ordered import Ordered
from tracelode.plans.sizing import small_side


def cycles(
    numbered: DataFrame, keys: Sequence[str], frequent: DataFrame, periodic: DataFrame, period: int
) -> DataFrame:
    """Cycle id per row.

    Anchors are frequent-pattern starts when a session has at least two, else
    period-pattern starts when it has at least two, else every ``period`` rows.
    Rows before the first anchor belong to no cycle."""
    keys = list(keys)

    def counted(starts: DataFrame, mode: int) -> DataFrame:
        return starts.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= 2).select(*keys, F.lit(mode).alias("mode"))

    modes = counted(frequent, 1).unionByName(counted(periodic, 2)).groupBy(*keys).agg(F.min("mode").alias("mode"))
    rows = numbered.join(small_side(modes), keys, "left").withColumn("mode", F.coalesce("mode", F.lit(3)))
    anchors = frequent.select(*keys, "pos", F.lit(1).alias("kind")).unionByName(periodic.select(*keys, "pos", F.lit(2).alias("kind")))
    flags = anchors.groupBy(*keys, "pos").agg(F.collect_set("kind").alias("kinds"))
    marked = rows.join(flags, [*keys, "pos"], "left")
    start = F.when(F.col("mode") == 3, F.col("pos") % period == 0).otherwise(
        F.coalesce(F.array_contains("kinds", F.col("mode")), F.lit(False))
    )
    out = Ordered(marked, keys, ["pos"]).with_islands("cycle", start).frame().drop("kinds")
    return out.where(F.col("cycle") > 0)


def pattern_starts(df: DataFrame, keys: Sequence[str], order: Sequence[str], tokens: str, pattern: Sequence[str]) -> DataFrame:
    return occurrences(df, keys, order, tokens, pattern)


def volume(df: DataFrame, keys: Sequence[str], payload: Column) -> DataFrame:
    """Payload volume per session."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("payloads"),
        F.sum(F.length(payload)).cast("long").alias("bytes"),
        F.min(F.length(payload)).cast("long").alias("min_len"),
        F.max(F.length(payload)).cast("long").alias("max_len"),
        F.avg(F.length(payload)).alias("avg_len"),
    )


def merge_captures(df: DataFrame, source: str, order: Sequence[str], index: str = "merged_index") -> DataFrame:
    """Concatenate captures in source order and renumber all rows from 0."""
    return Ordered(df, [], [source, *order]).with_row_number(index).frame()


def capture_offsets(df: DataFrame, source: str, time: str) -> DataFrame:
    """Segment table of a merged capture: first index, size, first and last time."""
    per_source = df.groupBy(source).agg(
        F.count(F.lit(1)).alias("n"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts")
    )
    total = Ordered(per_source, [], [source]).with_cumsum("_upto", F.col("n")).frame()
    return total.withColumn("start_index", F.col("_upto") - F.col("n")).drop("_upto")


def split_by_count(df: DataFrame, order: Sequence[str], size: int, name: str = "part_no") -> DataFrame:
    """Part number so that every part holds ``size`` rows (the last may be short)."""
    rows = Ordered(df, [], order).with_row_number("_rn").frame()
    return rows.withColumn(name, F.floor(F.col("_rn") / size)).drop("_rn")
