"""Cleaning, grids, resampling, filling and normalization of series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.plans.ordered import Ordered
from tracelode.plans.quantiles import robust_scale, with_group


def clean_series(df: DataFrame, keys: Sequence[str], time: str, value: str, order: str) -> DataFrame:
    """Null-free series, last row per duplicate timestamp (map-side combined)."""
    valid = df.where(F.col(time).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return valid.groupBy(*keys, time).agg(F.max_by(value, order).alias(value))


def grid(bounds: DataFrame, keys: Sequence[str], start: str, end: str, step: int, name: str) -> DataFrame:
    """Every multiple of ``step`` in [start, end].

    Expanded in two stages, so a long range becomes many rows early and no single
    row ever carries a huge array."""
    first = F.ceil(F.col(start) / step) * step
    last = F.floor(F.col(end) / step) * step
    outer = bounds.select(*keys, first.alias("_a"), last.alias("_b")).where(F.col("_a") <= F.col("_b"))
    return opened(outer, "_a", "_b", step).select(*keys, F.col("_a").alias(name))


def opened(spans: DataFrame, start: str, end: str, step: int) -> DataFrame:
    """Spans as one row for each of their steps: ``start`` takes its place, other columns are repeated.  Both ends are multiples
    of ``step``, the end not before the start."""
    block = step * 4096
    outer = spans.withColumn("_g", F.explode(F.sequence(F.floor(F.col(start) / block), F.floor(F.col(end) / block))))
    low = F.greatest(F.col(start), F.col("_g") * block)
    high = F.least(F.col(end), (F.col("_g") + 1) * block - step)
    return outer.withColumn(start, F.explode(F.sequence(low, high, F.lit(step).cast("long")))).drop("_g")


def bucketed(df: DataFrame, keys: Sequence[str], time: str, value: str, step: int, how: str, order: str | None = None) -> DataFrame:
    """One value per step: mean, last, or mode with last as tie-break.  ``order`` tells
    rows of one time apart; without it the greater value counts as the later one."""
    later = F.struct(time, order or value)
    at = (F.floor(F.col(time) / step) * step).alias("t")
    if how == "mean":
        return df.groupBy(*keys, at).agg(F.avg(value).alias("v"))
    if how == "last":
        return df.groupBy(*keys, at).agg(F.max_by(value, later).alias("v"))
    if how == "mode":
        counts = df.groupBy(*keys, at, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"), F.max(later).alias("_l"))
        return counts.groupBy(*keys, "t").agg(F.max_by("_v", F.struct("_c", "_l")).alias("v"))
    raise ValueError(f"unknown aggregation {how!r}")


def fill(df: DataFrame, keys: Sequence[str], time: str, value: str, how: str, reach: int | None = None, beyond: str = "hold") -> DataFrame:
    """ffill+bfill, or linear in time between known points and flat outside.

    ``reach``, in units of ``time``, limits the interpolation: a missing value further than that behind the last known point
    keeps what was interpolated at the limit (``hold``), or, with ``beyond="null"``, gaps with such values stay null as a
    whole; values outside the known points are flat in any case."""
    known = F.struct(F.col(time).alias("t"), F.col(value).alias("v"))
    point = F.when(F.col(value).isNotNull(), known)
    scan = Ordered(df, keys, [time])
    if reach is not None and beyond == "null":  # each known point also carries the time of the row before it, the end of a gap
        scan = scan.with_lag("_before", F.col(time))
        point = F.when(F.col(value).isNotNull(), F.struct(F.col(time).alias("t"), F.col(value).alias("v"), F.col("_before").alias("b")))
    scan = scan.with_last_known("_p", point).with_next_known("_n", point).frame()
    p, n = F.col("_p"), F.col("_n")
    if how == "ffill":
        filled = F.coalesce(p["v"], n["v"])
    else:
        at = F.col(time) if reach is None or beyond == "null" else F.least(F.col(time), p["t"] + reach)
        weight = (at - p["t"]) / (n["t"] - p["t"])
        between = p["v"] + weight * (n["v"] - p["v"])
        filled = F.when(F.col(value).isNotNull(), F.col(value)).otherwise(F.coalesce(between, p["v"], n["v"]))
        if reach is not None and beyond == "null":
            filled = F.when(F.col(value).isNull() & (n["b"] - p["t"] > reach), None).otherwise(filled)
    return scan.withColumn(value, filled).drop("_p", "_n", "_before")


def resample(
    df: DataFrame, keys: Sequence[str], time: str, value: str, step: int, how: str, filling: str, limit: int | None = None, beyond: str = "hold"
) -> DataFrame:
    """Dense series (keys, t, v) at multiples of ``step``; ``limit`` is the most steps that are interpolated in a row."""
    keys = list(keys)
    per_step = bucketed(df, keys, time, value, step, how)
    bounds = per_step.groupBy(*keys).agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    dense = grid(bounds, keys, "_lo", "_hi", step, "t").join(per_step, [*keys, "t"], "left")
    return fill(dense, keys, "t", "v", filling, None if limit is None else limit * step, beyond)


def common_grid(a: DataFrame, b: DataFrame, keys: Sequence[str], time: str, step: int) -> DataFrame:
    """Steps between the later start and the earlier end of two series."""
    keys = list(keys)

    def ends(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys).agg(F.min(time).alias("lo"), F.max(time).alias("hi"))

    both = ends(a).unionByName(ends(b)).groupBy(*keys).agg(
        F.max("lo").alias("_lo"), F.min("hi").alias("_hi"), F.count(F.lit(1)).alias("_n")
    )
    return grid(both.where(F.col("_n") == 2), keys, "_lo", "_hi", step, "t")


def is_discrete(df: DataFrame, keys: Sequence[str], value: str, most: int = 8) -> DataFrame:
    """At most ``most`` distinct values (9 decimals), all integral."""
    distinct = df.where(F.col(value).isNotNull()).select(*keys, F.round(value, 9).alias("_u")).distinct()
    whole = F.bool_and(F.abs(F.col("_u") - F.rint("_u")) <= 1e-6)
    return distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("uniques"), whole.alias("_w")).select(
        *keys, "uniques", ((F.col("uniques") <= most) & F.col("_w")).alias("discrete")
    )


def normalize(df: DataFrame, keys: Sequence[str], value: str, method: str, name: str, eps: float = 1e-9) -> DataFrame:
    keys, v = list(keys), F.col(value)
    if method == "none":
        return df.withColumn(name, v)
    if method == "zscore":
        stats = df.groupBy(*keys).agg(F.avg(value).alias("_c"), F.stddev_pop(value).alias("_s"))
    elif method == "minmax":
        stats = df.groupBy(*keys).agg(F.min(value).alias("_c"), (F.max(value) - F.min(value)).alias("_s"))
    elif method == "robust_zscore":
        scale = robust_scale(df.select(*keys, value), keys, value)
        stats = scale.select(*keys, F.col("median").alias("_c"), F.col("scale").alias("_s"))
    else:
        raise ValueError(f"unknown method {method!r}")
    scaled = F.when(F.col("_s") > eps, (v - F.col("_c")) / F.col("_s")).otherwise(F.lit(0.0))
    return with_group(df, stats, keys).withColumn(name, scaled).drop("_c", "_s")


def state_rows(df: DataFrame, keys: Sequence[str], time: str, channel: str, value: str, channels: Sequence[str], order: str) -> DataFrame:
    """Latest value of every channel at each distinct time, once all were seen; of
    several at one time, the one that ``order`` puts last."""
    keys = list(keys)
    per_time = df.groupBy(*keys, time).agg(
        *[F.max_by(value, F.when(F.col(channel) == c, F.col(order))).alias(c) for c in channels]
    )
    scan = Ordered(per_time, keys, [time])
    for c in channels:
        scan = scan.with_last_known(c, F.col(c))
    out = scan.frame()
    for c in channels:
        out = out.where(F.col(c).isNotNull())
    return out


def state_map(df: DataFrame, channels: Sequence[str]) -> Column:
    return F.create_map(*[part for c in channels for part in (F.lit(c), F.col(c))])


def per_second_last(df: DataFrame, keys: Sequence[str], time: str, value: str, order: str, unit: int = 1_000_000) -> DataFrame:
    """Last value in every whole second; ``order`` tells rows of one time apart."""
    return df.groupBy(*keys, F.floor(F.col(time) / unit).alias("sec")).agg(F.max_by(value, F.struct(time, order)).alias(value))


def sampling_interval(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Mean distance of consecutive samples."""
    span = (F.max(time) - F.min(time)) / F.nullif(F.count(F.lit(1)) - 1, F.lit(0))
    return df.groupBy(*keys).agg(span.alias("interval"), F.count(F.lit(1)).alias("n"))


def shift_time(df: DataFrame, time: str, offset: int) -> DataFrame:
    return df.withColumn(time, F.col(time) + offset)


def round_time(value: Column, decimals: int | None = None, step: float | None = None) -> Column:
    """Half-even rounding to decimals or to a multiple of ``step``."""
    if step is not None:
        return F.rint(value / step) * step
    return F.bround(value, decimals or 0)


