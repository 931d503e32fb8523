"""Similarity of paired series.

``left`` and ``right`` are long tables (keys, i, v); ``keys`` name the pair.  Most
measures need only per-side summaries, so pairs meet as one row each; the
positional measures join on (pair, i); nearest-value precision is an ordered scan.
Measures that no position enters also take sides as distinct values (keys, v, c) with
their counts c."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelode.operators.alignment import neighbours
from tracelode.plans.ordered import Ordered
from tracelode.plans.quantiles import quantiles
from tracelode.plans.sizing import small_side
from tracelode.session import materialize

# Weights of the combined score.
WEIGHTS = {"dtw": 0.15, "kl": 0.15, "cosine": 0.15, "range": 0.4, "cv": 0.15}
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def _weight(series: DataFrame) -> Column:
    """How many rows a row stands for."""
    return F.col("c") if "c" in series.columns else F.lit(1).cast("long")


def counted_summaries(counts: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """:func:`summaries` of distinct values with counts."""
    keys, v, c = list(keys), F.col("v"), F.col("c")
    known = F.sum(F.when(v.isNotNull(), c))
    first = counts.groupBy(*keys).agg(
        F.sum(c).alias(f"{prefix}_n"), (F.sum(v * c) / known).alias(f"{prefix}_mean"), F.min("v").alias(f"{prefix}_min"), F.max("v").alias(f"{prefix}_max"),
    )
    apart = counts.join(small_side(first.select(*keys, F.col(f"{prefix}_mean").alias("_m"))), keys)
    std = apart.groupBy(*keys).agg(F.sqrt(F.sum(F.pow(v - F.col("_m"), 2) * c) / known).alias(f"{prefix}_std"))
    return first.join(std, keys)


def summaries(series: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    return series.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(f"{prefix}_n"), F.avg("v").alias(f"{prefix}_mean"), F.stddev_pop("v").alias(f"{prefix}_std"),
        F.min("v").alias(f"{prefix}_min"), F.max("v").alias(f"{prefix}_max"),
    )


def both(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return summaries(left, keys, "a").join(summaries(right, keys, "b"), list(keys))


def positional(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums over the common prefix."""
    keys = list(keys)
    rows = left.select(*keys, "i", F.col("v").alias("x")).join(right.select(*keys, "i", F.col("v").alias("y")), [*keys, "i"])
    return _sums(rows, keys)


def _sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("m"), F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"),
        F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.covar_pop("x", "y").alias("cov"), F.stddev_pop("x").alias("dx"),
        F.stddev_pop("y").alias("dy"), F.max(F.abs(x)).alias("mx"), F.max(F.abs(y)).alias("my"), F.max(F.abs(x - y)).alias("gap"),
    )


def pearson(sums: DataFrame, eps: float = 1e-10) -> Column:
    flat_x, flat_y = F.col("dx") < eps, F.col("dy") < eps
    close = F.abs(F.col("sx") - F.col("sy")) / F.col("m") < 1e-6
    r = F.try_divide(F.col("cov"), F.col("dx") * F.col("dy"))
    return F.when(flat_x & flat_y, F.when(close, 1.0).otherwise(0.0)).when(flat_x | flat_y, 0.0).otherwise(r)


def cosine(sums: DataFrame) -> Column:
    size = F.sqrt("sxx") * F.sqrt("syy")
    usable = (size > 0) & (F.col("mx") < 1e100) & (F.col("my") < 1e100)
    return F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col("sxy"), size)))).otherwise(0.0)


def range_overlap() -> Column:
    inner = F.greatest(F.lit(0.0), F.least("a_max", "b_max") - F.greatest("a_min", "b_min"))
    outer = F.greatest("a_max", "b_max") - F.least("a_min", "b_min")
    return F.when(outer == 0, 1.0).otherwise(F.try_divide(inner, outer))


def cv_similarity(alpha: float = 1.0) -> Column:
    ca, cb = F.try_divide(F.col("a_std"), F.col("a_mean")), F.try_divide(F.col("b_std"), F.col("b_mean"))
    diff = F.abs(ca - cb) * alpha
    return F.when(ca.isNull() | cb.isNull() | (diff > 50), 0.0).otherwise(F.exp(-diff))


def epsilon() -> Column:
    return F.least(F.col("a_mean") * 0.1, F.col("b_mean") * 0.1)


def kl_similarity(left: DataFrame, right: DataFrame, pair: DataFrame, keys: Sequence[str]) -> DataFrame:
    """exp(-KL) of min-max scaled histograms; bins follow the left length."""
    keys = list(keys)
    bins = F.least(F.lit(20), F.greatest(F.lit(5), F.floor(F.sqrt("a_n")))).cast("int")
    info = pair.select(*keys, bins.alias("bins"), *[f"{s}_{x}" for s in "ab" for x in ("n", "min", "max")])

    def histogram(series: DataFrame, side: str) -> DataFrame:
        low, high = F.col(f"{side}_min"), F.col(f"{side}_max")
        unit = F.coalesce(F.try_divide(F.col("v") - low, high - low), F.lit(0.0))
        cell = F.least(F.floor(unit * F.col("bins")), F.col("bins") - 1).cast("int")
        rows = series.join(info, keys).withColumn("bin", cell)
        return rows.groupBy(*keys, "bin").agg(F.sum(_weight(series)).alias(f"{side}_c"))

    every = info.select(*keys, "bins", "a_n", "b_n", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    cells = every.join(histogram(left, "a"), [*keys, "bin"], "left").join(histogram(right, "b"), [*keys, "bin"], "left")
    tiny = 1e-10
    p = (F.coalesce("a_c", F.lit(0)) + tiny) / (F.col("a_n") + F.col("bins") * tiny)
    q = (F.coalesce("b_c", F.lit(0)) + tiny) / (F.col("b_n") + F.col("bins") * tiny)
    out = cells.groupBy(*keys).agg(F.sum(p * F.log(p / q)).alias("kl"))
    return out.select(*keys, F.when(F.col("kl") > 50, 0.0).otherwise(F.least(F.lit(1.0), F.exp(-F.col("kl")))).alias("kl_similarity"))


def quantile_similarity(left: DataFrame, right: DataFrame, pair: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of quartiles, taken inside the common range, that agree within epsilon."""
    keys = list(keys)
    low, high = F.greatest("a_min", "b_min"), F.least("a_max", "b_max")
    info = pair.select(*keys, low.alias("_lo"), high.alias("_hi"), epsilon().alias("_eps"))

    def inside(series: DataFrame, side: str) -> DataFrame:
        rows = series.join(info, keys).where(F.col("v").between(F.col("_lo"), F.col("_hi")))
        return quantiles(rows, keys, "v", {f"{side}_{k}": q for k, q in QUARTILES.items()}, _weight(series))

    joined = info.join(inside(left, "a"), keys, "left").join(inside(right, "b"), keys, "left")
    hits = sum((F.when(F.abs(F.col(f"a_{k}") - F.col(f"b_{k}")) <= F.col("_eps"), 1).otherwise(0) for k in QUARTILES), F.lit(0))
    return joined.select(*keys, F.when(F.col("_lo") < F.col("_hi"), hits / 3).otherwise(F.lit(0.0)).alias("quantile_similarity"))


def precision_k(left: DataFrame, right: DataFrame, pair: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of left values whose mean distance to the 3 nearest right values is within
    epsilon.  The three nearest are among three neighbours on either side, which
    an ordered scan over the values provides; no pairs are formed."""
    keys = list(keys)
    order = ["v", "i"]
    if "c" in right.columns:  # more than three copies of a value change nothing
        right = right.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(3).cast("long"), F.col("c")))))
    r = Ordered(right.select(*keys, "v", "i"), keys, order)
    r = r.with_lag("p1", F.col("v")).with_lag("p2", F.col("p1")).with_lead("n1", F.col("v")).with_lead("n2", F.col("n1"))
    ranked = r.frame()
    marks = left.select(*keys, F.col("v").alias("x"), _weight(left).alias("_c"))
    found = neighbours(marks, ranked, keys, "x", "v", "i", ["v", "p1", "p2", "n1", "n2"])
    prev, nxt = F.col("prev"), F.col("next")
    candidates = F.array(prev["v"], prev["p1"], prev["p2"], nxt["v"], nxt["n1"], nxt["n2"])
    distances = F.array_sort(F.transform(F.array_compact(candidates), lambda c: F.abs(c - F.col("x"))))
    nearest = F.slice(distances, 1, 3)
    mean = F.aggregate(nearest, F.lit(0.0), lambda acc, d: acc + d) / F.size(nearest)
    info = pair.select(*keys, epsilon().alias("_eps"))
    rows = found.withColumn("_d", mean).join(info, keys)
    return rows.groupBy(*keys).agg((F.sum(F.when(F.col("_d") <= F.col("_eps"), F.col("_c")).otherwise(0)) / F.sum("_c")).alias("precision_k"))


def dtw_similarity(left: DataFrame, right: DataFrame, keys: Sequence[str], radius: int = 1) -> DataFrame:
    """exp(-3 * distance / length) of min-max scaled series under multilevel DTW.

    Both series of a pair meet in one task at full length, as warping is sequential;
    the method keeps a few cells for each point, so memory grows with their length."""
    keys = list(keys)

    def scaled(series: DataFrame, side: str) -> DataFrame:
        n = series.groupBy(*keys).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
        unit = F.coalesce(F.try_divide(F.col("v") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
        rows = series.join(n, keys).select(*keys, "i", unit.alias("u"))
        packed = F.transform(F.array_sort(F.collect_list(F.struct("i", "u"))), lambda e: e["u"])
        return rows.groupBy(*keys).agg(packed.alias(side))

    return _warped(scaled(left, "a").join(scaled(right, "b"), keys), keys, radius)


def _warped(pairs: DataFrame, keys: list[str], radius: int = 1) -> DataFrame:
    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
            out.append(float(np.exp(-min(10.0, 3.0 * multilevel_dtw(x, y, radius) / max(len(x), len(y))))))
        return pd.Series(out)

    return pairs.select(*keys, score("a", "b").alias("dtw_similarity"))


def _banded(x: np.ndarray, y: np.ndarray, lows: list[int], highs: list[int], traced: bool):
    """Cost of the cheapest warping path inside per-row column ranges, and, if ``traced``, its least and greatest column in
    each row; only cells in range are kept, without a trace those of one row."""
    inf = float("inf")
    ys, rows = y.tolist(), []
    row, low, high = [0.0], -1, -1  # the corner before the first cell
    for value, lo, hi in zip(x.tolist(), lows, highs):
        above = row[lo - 1 - low : hi - low + 1] if lo > low else [inf] * (low - lo + 1) + row[: max(0, hi - low + 1)]
        above += [inf] * (hi - lo + 2 - len(above))
        row, low, high, before = [], lo, hi, inf
        corner = above[0]
        for other, up in zip(ys[lo : hi + 1], above[1:]):
            least = up if up < corner else corner
            if before < least:
                least = before
            before = (value - other if value > other else other - value) + least
            row.append(before)
            corner = up
        if traced:
            rows.append(row)
    end = len(y) - 1
    cost = row[end - low] if low <= end <= high else inf
    if not traced:
        return cost, None, None
    first, last = [0] * len(rows), [0] * len(rows)
    i, j = len(rows) - 1, end
    last[i] = j

    def at(i: int, j: int) -> float:
        if i < 0 or j < 0:
            return 0.0 if i == j == -1 else inf
        return rows[i][j - lows[i]] if lows[i] <= j <= highs[i] else inf

    while i >= 0 and j >= 0:
        first[i] = j
        up, left, corner = at(i - 1, j), at(i, j - 1), at(i - 1, j - 1)
        if up <= left and up <= corner:
            i -= 1
        elif left <= corner:
            j -= 1
            continue
        else:
            i, j = i - 1, j - 1
        if i >= 0:
            last[i] = j
    return cost, np.array(first), np.array(last)


def multilevel_dtw(x: np.ndarray, y: np.ndarray, radius: int) -> float:
    """Distance by halving, solving the half size and refining around its path."""

    def solve(a: np.ndarray, b: np.ndarray, traced: bool):
        n, m = len(a), len(b)
        if n < radius + 2 or m < radius + 2:
            return _banded(a, b, [0] * n, [m - 1] * n, traced)
        half = [(s[: len(s) // 2 * 2].reshape(-1, 2)).mean(axis=1) for s in (a, b)]
        _, first, last = solve(*half, True)
        rows = len(first) + radius
        lows, highs = np.full(rows, m), np.full(rows, -1)
        for shift in range(-radius, radius + 1):  # rows within the radius of a row of the path
            own, put = slice(max(0, -shift), len(first)), slice(max(0, shift), len(first) + shift)
            lows[put], highs[put] = np.minimum(lows[put], first[own]), np.maximum(highs[put], last[own])
        lows, highs = np.repeat(2 * (lows - radius), 2)[:n], np.repeat(2 * (highs + radius) + 1, 2)[:n]
        if len(lows) < n:  # an odd last row that no path row reaches
            lows, highs = np.append(lows, lows[-1]), np.append(highs, highs[-1])
        highs = np.minimum(m - 1, highs)
        highs[-1] = m - 1
        lows = np.minimum(np.maximum(0, lows), highs)
        return _banded(a, b, lows.tolist(), highs.tolist(), traced)

    return float(solve(x, y, False)[0])


def weighted_scores(left: DataFrame, right: DataFrame, keys: Sequence[str], weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """All measures and the weighted score, one row per pair; measures without a weight are left out if they need a pass of
    their own."""
    keys = list(keys)
    warped = dtw_similarity(left, right, keys) if "dtw" in weights else None
    return _weighted(left, right, keys, weights, both(left, right, keys), positional(left, right, keys), warped)


def _weighted(
    left: DataFrame, right: DataFrame, keys: list[str], weights: dict[str, float], pair: DataFrame, sums: DataFrame, warped: DataFrame | None
) -> DataFrame:
    out = pair.join(sums, keys, "left")
    out = out.select(
        *keys, "a_n", "b_n", range_overlap().alias("overlap"), cv_similarity().alias("cv"),
        F.coalesce(cosine(sums), F.lit(0.0)).alias("cosine"), F.coalesce(pearson(sums), F.lit(0.0)).alias("pearson"),
    )
    parts = [
        kl_similarity(left, right, pair, keys).withColumnRenamed("kl_similarity", "kl"),
        quantile_similarity(left, right, pair, keys),
        precision_k(left, right, pair, keys),
    ]
    if warped is not None:
        parts.append(warped.withColumnRenamed("dtw_similarity", "dtw"))
    for part in parts:
        out = out.join(part, keys, "left")
    out = out.withColumn("range", 0.6 * F.col("precision_k") + 0.2 * F.col("overlap") + 0.2 * F.col("quantile_similarity"))
    score = sum((F.col(name) * weight for name, weight in weights.items()), F.lit(0.0))
    return out.withColumn("weighted_score", score)


def sliding_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], ratio: float = 2.0, most: int = 10):
    """Windows of the longer side as long as the shorter one when lengths differ by more
    than ``ratio``; returns both sides keyed by (keys, window).

    At most ``2 * most`` windows cover a row, so rows grow by a constant factor."""
    keys = list(keys)
    n = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_la")).join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_lb")), keys)
    plan = _window_plan(n, ratio, most)

    def spread(side: DataFrame, own: str, other: str) -> DataFrame:
        rows = side.join(plan, keys)
        longer = F.col("_slide") & (F.col(own) > F.col(other))
        windows = F.when(longer, _covering()).otherwise(F.sequence(F.lit(0).cast("long"), F.col("_last").cast("long")))
        out = rows.withColumn("window", F.explode(windows))
        shift = F.when(longer, F.col("window") * F.col("_step")).otherwise(0)
        return out.select(*keys, "window", (F.col("i") - shift).alias("i"), "v")

    return spread(left, "_la", "_lb"), spread(right, "_lb", "_la")


SHAPE = ["_la", "_lb"]  # lengths of both sides, which decide the windows


def _window_plan(n: DataFrame, ratio: float, most: int) -> DataFrame:
    """``n`` with width, step and last number of the windows."""
    short, long = F.least("_la", "_lb"), F.greatest("_la", "_lb")
    positions = long - short + 1
    step = F.greatest(F.lit(1), F.floor(positions / F.least(F.lit(most), positions)))
    slide = long > short * ratio
    return n.withColumns({
        "_w": short, "_step": F.when(slide, step).otherwise(long), "_last": F.when(slide, F.floor((long - short) / step)).otherwise(0), "_slide": slide,
    })


def _covering() -> Column:
    """Numbers of the windows that cover the row ``i`` of the longer side."""
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - F.col("_w") + 1) / F.col("_step")))
    last = F.least(F.col("_last"), F.floor(F.col("i") / F.col("_step")))
    return F.when(last >= first, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<bigint>"))


def paired_scores(
    pairs: DataFrame, left: DataFrame, right: DataFrame, keys: Sequence[str], weights: dict[str, float] = WEIGHTS, ratio: float = 2.0, most: int = 10
) -> DataFrame:
    """:func:`weighted_scores` by (keys, field, column, window) of the :func:`sliding_pairs` of ``pairs`` (keys, field, column) of
    series (keys, name, i, v).

    Series are not copied for each pair: a series stands once for the lengths it meets, in windows only where it is the longer
    side.  Measures that no position enters read distinct values with counts, and products of positions are added up as
    they meet."""
    keys = list(keys)
    own = [*keys, "field", "column"]
    sizes = [s.groupBy(*keys, F.col("name").alias(n)).agg(F.count(F.lit(1)).alias(c)) for s, n, c in ((left, "field", "_la"), (right, "column", "_lb"))]
    plan = materialize(_window_plan(pairs.select(*own).join(sizes[0], [*keys, "field"]).join(sizes[1], [*keys, "column"]), ratio, most))
    each = plan.withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last").cast("long"))))
    whole = F.lit(-1).cast("long")  # window number of a side that is taken as a whole
    number = {n: F.when(F.col("_slide") & (F.col(c) > F.col(d)), F.col("window")).otherwise(whole) for n, c, d in (("field", "_la", "_lb"), ("column", "_lb", "_la"))}
    each = materialize(each.select(*own, *SHAPE, "window", number["field"].alias("_field"), number["column"].alias("_column")))

    def view(series: DataFrame, name: str, length: str, other: str) -> DataFrame:
        """(keys, name, lengths, window number, i, v)"""
        wanted = plan.select(*keys, name, *SHAPE, "_w", "_step", "_last", "_slide").distinct()
        rows = series.select(*keys, F.col("name").alias(name), "i", "v").join(small_side(wanted), [*keys, name])
        longer = F.col("_slide") & (F.col(length) > F.col(other))
        rows = rows.withColumn(f"_{name}", F.explode(F.when(longer, _covering()).otherwise(F.array(whole))))
        shift = F.when(longer, F.col(f"_{name}") * F.col("_step")).otherwise(0)
        return rows.select(*keys, name, *SHAPE, f"_{name}", (F.col("i") - shift).alias("i"), "v")

    views = {"field": view(left, "field", "_la", "_lb"), "column": view(right, "column", "_lb", "_la")}

    def counts(name: str) -> DataFrame:
        group = [*keys, name, *SHAPE, f"_{name}"]
        rows = views[name].groupBy(*group, "v").agg(F.count(F.lit(1)).alias("c"))
        return materialize(rows.join(small_side(each), group).select(*own, "window", "v", "c"))

    def packed(name: str, side: str) -> DataFrame:
        rows = views[name].groupBy(*keys, name, *SHAPE, f"_{name}").agg(
            F.sort_array(F.collect_list(F.struct("i", "v"))).alias("_s"), F.min("v").alias("_lo"), F.max("v").alias("_hi")
        )
        unit = F.transform("_s", lambda e: F.coalesce(F.try_divide(e["v"] - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)))
        return rows.withColumn(side, unit).drop("_s", "_lo", "_hi")

    ends = [*own, "window"]
    a, b = counts("field"), counts("column")
    x = views["field"].join(small_side(plan.select(*own, *SHAPE)), [*keys, "field", *SHAPE]).withColumnRenamed("v", "x")
    met = x.join(views["column"].withColumnRenamed("v", "y"), [*keys, "column", *SHAPE, "i"])
    sums = materialize(_sums(met.withColumn("window", F.greatest("_field", "_column", F.lit(0))), ends))
    warped = None
    if "dtw" in weights:
        both_sides = each.join(packed("field", "a"), [*keys, "field", *SHAPE, "_field"]).join(packed("column", "b"), [*keys, "column", *SHAPE, "_column"])
        parts = max(96, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        warped = _warped(both_sides.select(*ends, "a", "b").repartition(parts, *ends), ends)
    pair = materialize(counted_summaries(a, ends, "a").join(counted_summaries(b, ends, "b"), ends))
    return _weighted(a, b, ends, weights, pair, sums, warped)


def column_scores(per_window: DataFrame, keys: Sequence[str], stop: float = 0.95) -> DataFrame:
    """.7 best + .3 mean over the windows up to the first one above ``stop``."""
    keys = list(keys)
    first = per_window.where(F.col("weighted_score") > stop).groupBy(*keys).agg(F.min("window").alias("_f"))
    kept = per_window.join(first, keys, "left").where(F.col("_f").isNull() | (F.col("window") <= F.col("_f")))
    best, mean = F.max("weighted_score"), F.avg("weighted_score")
    return kept.groupBy(*keys).agg((0.7 * best + 0.3 * mean).alias("score"), F.count(F.lit(1)).alias("windows"))


def repetition_penalty(score: Column, repetition: Column, threshold: float, limit: float = 0.8) -> Column:
    """Matched scores lose what the most common value exceeds ``limit`` by."""
    return F.when((score > threshold) & (repetition > limit), score - (repetition - limit)).otherwise(score)


def field_score(score: Column, repetition: Column, threshold: float, constant: Column, on_block: Column) -> Column:
    """Field-level score: clipped below at ``threshold``; constant off-block fields get 0."""
    clipped = F.greatest(repetition_penalty(score, repetition, threshold), F.lit(threshold))
    return F.when(constant & ~on_block, 0.0).otherwise(clipped)


def presence_ratio(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of left text values that occur on the right."""
    keys = list(keys)
    counts = left.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    known = right.select(*keys, "v").distinct().withColumn("_k", F.lit(1))
    joined = counts.join(known, [*keys, "v"], "left")
    return joined.groupBy(*keys).agg((F.sum(F.when(F.col("_k") == 1, F.col("c")).otherwise(0)) / F.sum("c")).alias("presence"))
