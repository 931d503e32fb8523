"""Exact quantiles that do not hold a group in memory.

Values are first reduced to (value, count); a cumulative count over the distinct
values then finds the rows around each requested position.  Linear
interpolation between neighbours, rounded as SQL's ``quantile_cont`` does it, so that
comparisons at equality come out alike."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.plans.ordered import Ordered
from tracelode.plans.sizing import small_side
from tracelode.session import materialize


def weights(df: DataFrame, keys: Sequence[str], value: str, count: Column | None = None) -> DataFrame:
    """(keys, _v, _c): distinct non-null values with their counts.

    Written once, because the size check, the scan and every later statistic read
    it; the input itself is scanned a single time."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg((F.count(F.lit(1)) if count is None else F.sum(count)).alias("_c"))
    return materialize(counts)


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c in doubles with the product's rounding error added back; ``b`` lies between 0 and 1."""

    def halves(x: Column) -> tuple[Column, Column]:
        far = x * F.lit(134217729.0)
        high = far - (far - x)
        return high, x - high

    (ah, al), (bh, bl) = halves(a), halves(b)
    product = a * b
    lost = ((ah * bh - product) + ah * bl + al * bh) + al * bl
    total = product + c
    rest = total - product
    return total + (((product - (total - rest)) + (c - rest)) + lost)


def between(low: Column, high: Column, share: Column) -> Column:
    """The value at ``share`` of the way from ``low`` to ``high``: low * (1 - share) + high * share, where only the second product
    is rounded."""
    low, high = low.cast("double"), high.cast("double")
    large = F.greatest(F.abs(low), F.abs(high)) > 1e290  # splitting would overflow
    plain = low * (1 - share) + high * share
    return F.when((share == 0) | (low == high), low).when(large, plain).otherwise(fused(low, 1 - share, high * share))


def _from_weights(counts: DataFrame, keys: list[str], wanted: Mapping[str, float]) -> tuple[DataFrame, int | None]:
    """Quantiles from weights, and the number of groups the size check found."""
    scan = Ordered(counts, keys, ["_v"])
    ranked = scan.with_cumsum("_upto", F.col("_c")).frame()
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    joined = with_group(ranked, sizes, keys, scan.groups)
    first, last = F.col("_upto") - F.col("_c"), F.col("_upto") - 1
    aggregates = []
    for name, q in wanted.items():
        at = (F.col("_n") - 1) * F.lit(float(q))
        low, high = F.floor(at), F.ceil(at)
        covers_low = (first <= low) & (low <= last)
        covers_high = (first <= high) & (high <= last)
        lower = F.max(F.when(covers_low, F.col("_v")))
        upper = F.max(F.when(covers_high, F.col("_v")))
        share = F.max(at - low)
        aggregates.append(between(lower, upper, share).alias(name))
    return joined.groupBy(*keys).agg(*aggregates), scan.groups


def quantiles(df: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, float], count: Column | None = None) -> DataFrame:
    """One row per group with the named quantiles of the non-null values; ``count`` tells how often a row counts."""
    return _from_weights(weights(df, keys, value, count), list(keys), wanted)[0]


def quantile(df: DataFrame, value: str, q: float, accuracy: int = 1_000, guess: tuple[int, float, float] | None = None) -> float | None:
    """One quantile of all non-null values, as :func:`quantiles` gives it, without a sort of them.

    A sketch brackets it by some ranks in ``accuracy``; a second pass counts the values below the bracket and the distinct
    ones inside, where the exact rank is looked up.  ``guess``, the number of values and a bracket, saves the sketch.  If the
    guess misses the rank, the sketch follows, and if that misses it, all values are ranked."""
    if guess is None:
        reach = 4 / accuracy
        ends = F.percentile_approx(value, [max(0.0, q - reach), min(1.0, q + reach)], accuracy * 2)
        row = df.agg(F.count(value).alias("n"), ends.alias("ends"), F.min(value).alias("least"), F.max(value).alias("most")).first()
        if not row["n"]:
            return None
        n, low, high = row["n"], row["ends"][0] if q > reach else row["least"], row["ends"][1] if q + reach < 1 else row["most"]
    else:
        n, low, high = guess
    near = df.where(F.col(value) <= high).groupBy(F.when(F.col(value) >= low, F.col(value)).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    counts = materialize(near)
    inside = counts.where(F.col("_v").isNotNull())
    sums = counts.agg(F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_c"))), F.lit(0)).alias("below"), F.sum("_c").alias("upto")).first()
    at = (n - 1) * q
    first, last = math.floor(at), math.ceil(at)
    if first < sums["below"] or last >= (sums["upto"] or 0):
        return quantile(df, value, q, accuracy) if guess else quantiles(df, [], value, {"t": q}).first()["t"]
    ranked = Ordered(inside, [], ["_v"]).with_cumsum("_upto", F.col("_c")).frame()
    upto = F.col("_upto") + sums["below"]
    found = ranked.agg(F.min(F.when(upto > first, F.col("_v"))).alias("a"), F.min(F.when(upto > last, F.col("_v"))).alias("b")).first()
    return math.fma(float(found["a"]), 1 - (at - first), float(found["b"]) * (at - first)) if first < last else found["a"]


def medians(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    return quantiles(df, keys, value, {name: 0.5})


def with_group(df: DataFrame, stats: DataFrame, keys: Sequence[str], groups: int | None = None) -> DataFrame:
    """Attach per-group statistics; without keys the statistics are one row."""
    return df.join(small_side(stats, groups), list(keys)) if keys else df.crossJoin(F.broadcast(stats))


def _spread(counts: DataFrame, middle: DataFrame, keys: list[str], groups: int | None) -> DataFrame:
    """Absolute deviations from the median as weights again."""
    apart = with_group(counts, middle, keys, groups).withColumn("_d", F.abs(F.col("_v") - F.col("median")))
    return materialize(apart.groupBy(*keys, F.col("_d").alias("_v")).agg(F.sum("_c").alias("_c")))


def mad(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median and median absolute deviation per group."""
    keys = list(keys)
    counts = weights(df, keys, value)
    middle, groups = _from_weights(counts, keys, {"median": 0.5})
    spread, _ = _from_weights(_spread(counts, middle, keys, groups), keys, {"mad": 0.5})
    return with_group(spread, middle, keys, groups)


def robust_scale(df: DataFrame, keys: Sequence[str], value: str, fallback: float = 1.0, eps: float = 1e-9) -> DataFrame:
    """1.4826 MAD, else population deviation, else IQR / 1.349, else ``fallback``."""
    keys = list(keys)
    counts = weights(df, keys, value)
    base, groups = _from_weights(counts, keys, {"median": 0.5, "_q1": 0.25, "_q3": 0.75})
    spread, _ = _from_weights(_spread(counts, base.drop("_q1", "_q3"), keys, groups), keys, {"mad": 0.5})
    mean = counts.groupBy(*keys).agg((F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("_m"))
    apart = F.pow(F.col("_v") - F.col("_m"), 2) * F.col("_c")
    std = with_group(counts, mean, keys, groups).groupBy(*keys).agg(F.sqrt(F.sum(apart) / F.sum("_c")).alias("_std"))
    out = with_group(with_group(base, spread, keys, groups), std, keys, groups)
    scaled, width = F.col("mad") * 1.4826, (F.col("_q3") - F.col("_q1")) / 1.349
    scale = F.when(scaled > eps, scaled).when(F.col("_std") > eps, F.col("_std")).when(width > eps, width)
    chosen = scale.otherwise(F.lit(float(fallback) if fallback > eps else 1.0))
    return materialize(out.withColumn("scale", chosen).drop("_q1", "_q3", "_std"))
