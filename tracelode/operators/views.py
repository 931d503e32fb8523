"""Time handling of recorded inputs, dense one-second views and match decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.operators.resample import opened
from tracelode.plans.ordered import Ordered

SECOND = 1_000_000
# Fixed value of the reference: from this share of numbers on, a column holds Unix seconds.
NUMERIC_SHARE = 0.95


def epoch_seconds(text: Column, pattern: str | None = None, zone: str = "UTC") -> Column:
    """Seconds since 1970 of a wall-clock text read in ``zone``; null if it does not parse."""
    stamp = F.try_to_timestamp(text, F.lit(pattern)) if pattern else F.try_to_timestamp(text)
    return F.unix_micros(F.to_utc_timestamp(stamp, zone)) / SECOND


def parsed_times(df: DataFrame, column: str, name: str, pattern: str | None = None) -> DataFrame:
    """``name``: seconds since 1970.  A column of numbers, at least 95 % of its known values, is read as Unix seconds and its
    other values become null; any other column is parsed as text.  One pass decides for the whole column."""
    number = F.expr(f"try_cast(`{column}` as double)")
    share = df.agg(F.avg(F.when(F.col(column).isNotNull(), number.isNotNull().cast("double")))).first()[0]
    value = number if share is not None and share >= NUMERIC_SHARE else epoch_seconds(F.col(column).cast("string"), pattern)
    return df.withColumn(name, value)


def local_window(df: DataFrame, time_us: str, start: str, end: str, zone: str) -> DataFrame:
    """Rows whose time, a wall clock of ``zone``, lies between two wall-clock texts of the same zone, both included."""
    clock = lambda text: F.unix_micros(F.to_utc_timestamp(F.lit(text).cast("timestamp"), zone))
    moment = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(F.col(time_us)), zone))
    return df.where(moment.between(clock(start), clock(end)))


def dense_spans(df: DataFrame, keys: Sequence[str], time_us: str, channel: str, value: str, channels: Sequence[str], order: str) -> DataFrame:
    """(keys, sec, until, channels): the dense view as stretches of seconds, ``until`` included, in which no channel changes.

    Only seconds with rows are sorted; a row without a key has null channels."""
    keys = list(keys)
    held = F.lit(True)
    for k in keys:
        held = held & F.col(k).isNotNull()
    at = F.floor(F.col(time_us) / SECOND).alias("sec")
    last = {c: F.max_by(value, F.when(held & (F.col(channel) == c), F.struct(time_us, order))).alias(c) for c in channels}
    wide = df.where(F.col(time_us).isNotNull()).groupBy(*keys, at).agg(*last.values())
    scan = known_before_or_after(Ordered(wide, keys, ["sec"]), channels).with_lead("_next", F.col("sec")).frame()
    return scan.select(*keys, "sec", F.coalesce(F.col("_next") - 1, F.col("sec")).alias("until"), *channels)


def known_before_or_after(scan: Ordered, channels: Sequence[str]) -> Ordered:
    """Channels filled forward, then backward: all forward scans share one order, all backward ones another."""
    for c in channels:
        scan = scan.with_last_known(f"_p_{c}", F.col(c))
    for c in channels:
        scan = scan.with_next_known(f"_n_{c}", F.col(c))
    return scan.transform(lambda df: df.withColumns({c: F.coalesce(f"_p_{c}", f"_n_{c}") for c in channels}).drop(*(f"_{n}_{c}" for n in "pn" for c in channels)))


def dense_seconds(df: DataFrame, keys: Sequence[str], time_us: str, channel: str, value: str, channels: Sequence[str], order: str) -> DataFrame:
    """One row for every second between a key's first and last: the last value of each channel in it, forward then backward
    filled."""
    spans = dense_spans(df, keys, time_us, channel, value, channels, order)
    return opened(spans, "sec", "until", 1).select(*keys, "sec", *channels)


def recovered_view(above: DataFrame, below: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Rows of the upper view with the channels of the lower view at their second, forward then backward filled."""
    out = above.join(below.select(*keys, "sec", *channels), [*keys, "sec"], "left")
    return known_before_or_after(Ordered(out, keys, ["sec"]), channels).frame()


def recovered_from_spans(above: DataFrame, spans: DataFrame, keys: Sequence[str], channels: Sequence[str], there: Column) -> DataFrame:
    """:func:`recovered_view` for a lower view given as :func:`dense_spans`, of which the seconds ``there`` exist: a row meets
    the last stretch that starts before or at its second, so the seconds of stretches are not written out."""
    keys = list(keys)
    body = F.struct(*above.columns)
    starts = spans.select(*keys, "sec", F.lit(0).alias("_side"), F.struct("until", *channels).alias("_open"))
    rows = above.select(*keys, "sec", F.lit(1).alias("_side"), body.alias("_row"))
    scan = Ordered(rows.unionByName(starts, allowMissingColumns=True), keys, ["sec", "_side"]).with_last_known("_last", F.col("_open"))
    met = there & (F.col("sec") <= F.col("_last.until"))
    scan = scan.transform(lambda df: df.where("_side = 1").select(*keys, "sec", "_side", "_row", *scan.chunk_columns(), *(F.when(met, F.col(f"_last.{c}")).alias(c) for c in channels)))
    return known_before_or_after(scan, channels).frame().select("_row.*", *channels)


def column_decisions(rates: DataFrame, keys: Sequence[str], rate: str, threshold: float) -> DataFrame:
    """Per key: columns, columns whose exact rate reaches the threshold, and their share."""
    good = F.count_if(F.col(rate) >= threshold)
    return rates.groupBy(*keys).agg(F.count(F.lit(1)).alias("columns"), good.alias("matched"), (good / F.count(F.lit(1))).alias("share"))
