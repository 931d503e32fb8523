"""Labelled perturbation of recorded tables for evaluation sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.plans.ordered import Ordered
from tracelode.plans.sizing import small_side


def sample_starts(df: DataFrame, position: str, low: int, high: int, count: int, seed: int) -> DataFrame:
    """Distinct start rows in [low, high), reproducible for a seed: the rows with the
    smallest seeded hash."""
    inside = df.where((F.col(position) >= low) & (F.col(position) < high)).select(F.col(position).alias("start")).distinct()
    return inside.orderBy(F.xxhash64(F.lit(seed), "start"), "start").limit(count)


def linear_bridge(first: Column, last: Column, step: Column, steps: int) -> Column:
    return first + (last - first) * step / steps


def tail_template(values: Sequence[float]) -> Column:
    """Template values by offset, the last one held."""
    array = F.array(*[F.lit(float(v)) for v in values])
    return F.get(array, F.least(F.col("_offset"), F.lit(len(values) - 1)).cast("int"))


def overwrite_tails(df: DataFrame, starts: DataFrame, position: str, templates: dict[str, Column], status: Sequence[str] = ()) -> DataFrame:
    """One labelled copy of the table per start row, columns replaced from the start on.

    The copies are the result asked for; the starts are a handful of rows, size-checked
    before they are broadcast."""
    splits = Ordered(starts, [], ["start"]).with_row_number("_n").frame()
    splits = splits.select("start", F.concat(F.lit("test_"), F.lpad((F.col("_n") + 1).cast("string"), 2, "0")).alias("split"))
    rows = df.crossJoin(small_side(splits)).withColumn("_offset", F.col(position) - F.col("start"))
    hit = F.col("_offset") >= 0
    for column, value in templates.items():
        changed = F.rint(value) if column in status else value
        rows = rows.withColumn(column, F.when(hit, changed).otherwise(F.col(column)))
    return rows.withColumn("malicious", hit).drop("_offset")


def label_log(perturbed: DataFrame, position: str, time: str, injected: Sequence[str]) -> DataFrame:
    """Half-open row and time span per split, with the affected columns."""
    bad = F.col("malicious")
    return perturbed.groupBy("split", "start").agg(
        F.min(F.when(bad, F.col(time))).alias("start_ts"), F.max(F.when(bad, F.col(time))).alias("last_ts"),
        (F.max(F.when(bad, F.col(position))) + 1).alias("end_exclusive"), F.count_if(bad).alias("rows"),
    ).withColumn("injected", F.lit("|".join(injected)))
