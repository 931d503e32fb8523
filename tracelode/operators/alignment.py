"""Time alignment: as-of, nearest, interpolating and window matches.

As-of style matches never form pairs: both sides are put on one time axis and the
neighbour is carried along an ordered scan.  Window matches look at *bounded* blocks
of the right side, so rows shuffled grow with the number of blocks a window
touches and not with the number of pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.plans.ordered import Ordered
from tracelode.plans.quantiles import with_group
from tracelode.session import materialize


def values_equal(a: Column, b: Column, tolerance: float = 1e-4) -> Column:
    """Fixed-tolerance equality; two nulls are equal."""
    return F.coalesce(F.abs(a - b) < tolerance, a.isNull() & b.isNull())


def values_equal_dynamic(a: Column, b: Column) -> Column:
    """Tolerance by magnitude: .01 above 100, .005 above 1, else .001."""
    size = F.least(F.abs(a), F.abs(b))
    tolerance = F.when(size > 100, 0.01).when(size > 1, 0.005).otherwise(0.001)
    return F.coalesce(F.abs(a - b) < tolerance, a.isNull() & b.isNull())


def texts_equal(a: Column, b: Column) -> Column:
    return F.coalesce(F.trim(a) == F.trim(b), a.isNull() & b.isNull())


def neighbours(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    right_tie: str,
    right_values: Sequence[str],
) -> DataFrame:
    """Left rows with ``prev`` (last right row at or before) and ``next`` (first
    right row after), each a struct of the right time and values or null."""
    keys = list(keys)
    body = F.struct(F.col(right_time).alias("t"), *[F.col(c) for c in right_values])
    marks = left.select(
        *keys,
        F.col(left_time).alias("_t"),
        F.lit(1).alias("_side"),
        F.lit(None).cast(right.schema[right_tie].dataType).alias("_tie"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_l"),
        F.lit(None).cast(right.select(body.alias("r")).schema["r"].dataType).alias("_r"),
    )
    points = right.select(
        *keys,
        F.col(right_time).alias("_t"),
        F.lit(0).alias("_side"),
        F.col(right_tie).alias("_tie"),
        F.lit(None).cast(marks.schema["_l"].dataType).alias("_l"),
        body.alias("_r"),
    )
    scan = Ordered(points.unionByName(marks), keys, ["_t", "_side", "_tie"])
    scan = scan.with_last_known("prev", F.col("_r")).with_next_known("next", F.col("_r"))
    return scan.frame().where(F.col("_side") == 1).select("_l.*", "prev", "next")


def asof(found: DataFrame, left_time: str, mode: str, tolerance: float | None = None, exact: bool = True) -> DataFrame:
    """``match`` struct for backward / forward / nearest (ties to the earlier row)."""
    t, prev, nxt = F.col(left_time), F.col("prev"), F.col("next")
    back = F.when(F.lit(exact) | (prev["t"] < t), prev)
    ahead = F.when(F.lit(exact) & (prev["t"] == t), prev).otherwise(nxt)
    if mode == "backward":
        match = back
    elif mode == "forward":
        match = ahead
    elif mode == "nearest":
        closer = F.when(nxt.isNull() | (t - prev["t"] <= nxt["t"] - t), prev).otherwise(nxt)
        match = F.when(prev.isNull(), nxt).otherwise(closer)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    if tolerance is not None:
        match = F.when(F.abs(match["t"] - t) <= tolerance, match)
    return found.withColumn("match", match)


def nearest_within(found: DataFrame, left_time: str, threshold: float) -> DataFrame:
    """Nearest match closer than ``threshold`` (strict)."""
    near = asof(found, left_time, "nearest")
    return near.withColumn("match", F.when(F.abs(F.col("match")["t"] - F.col(left_time)) < threshold, F.col("match")))


def interpolated(found: DataFrame, left_time: str, value: str, tolerance: float | None = None) -> DataFrame:
    """Linear interpolation when both neighbours are in tolerance, else the nearest
    one in tolerance (ties to the earlier)."""
    t, prev, nxt = F.col(left_time), F.col("prev"), F.col("next")
    left_gap, right_gap = t - prev["t"], nxt["t"] - t
    limit = F.lit(tolerance) if tolerance is not None else F.lit(float("inf"))
    both = (left_gap <= limit) & (right_gap <= limit)
    weight = left_gap / (nxt["t"] - prev["t"])
    line = prev[value] + weight * (nxt[value] - prev[value])
    pick_prev = nxt.isNull() | (left_gap <= right_gap)
    nearest = F.when(prev.isNotNull() & pick_prev & (left_gap <= limit), prev[value]).when(
        nxt.isNotNull() & (prev.isNull() | (left_gap > right_gap)) & (right_gap <= limit), nxt[value]
    )
    exact = prev["t"] == t
    return found.withColumn("matched", F.when(exact, prev[value]).when(both, line).otherwise(nearest))


def best_in_window(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    left_id: str,
    right_time: str,
    right_tie: str,
    before: int,
    after: int,
    rank: Callable[[Column], list[Column]],
    block: int = 64,
) -> DataFrame:
    """Left rows with ``best``: the right row in ``[t - before, t + after]`` whose
    ``rank`` (a list of columns, smaller is better) comes first; null if none.

    One ordered scan numbers the right rows and finds each window's first and
    last position.  Right rows are packed into blocks of ``block`` rows, a left row
    visits the blocks its window touches, and block winners are reduced before the
    shuffle.  No pair is ever emitted and no partner is dropped."""
    keys = list(keys)
    body = F.struct(*[F.col(c) for c in right.columns])
    lt = F.struct(*[F.col(c) for c in left.columns])
    tie_type = right.schema[right_tie].dataType
    body_type = right.select(body.alias("r")).schema["r"].dataType

    def marks(shift: int, kind: int) -> DataFrame:
        return left.select(
            *keys,
            (F.col(left_time) + shift).alias("_t"),
            F.lit(kind).alias("_kind"),
            F.lit(None).cast(tie_type).alias("_tie"),
            F.col(left_id).alias("_id"),
            (lt if kind == 1 else F.lit(None)).cast(left.select(lt.alias("l")).schema["l"].dataType).alias("_l"),
            F.lit(None).cast(body_type).alias("_r"),
        )

    low = marks(-before, -1)
    points = right.select(
        *keys,
        F.col(right_time).alias("_t"),
        F.lit(0).alias("_kind"),
        F.col(right_tie).alias("_tie"),
        F.lit(None).cast(left.schema[left_id].dataType).alias("_id"),
        F.lit(None).cast(low.schema["_l"].dataType).alias("_l"),
        body.alias("_r"),
    )
    union = points.unionByName(low).unionByName(marks(after, 1))
    scan = Ordered(union, keys, ["_t", "_kind", "_tie", "_id"])
    scan = scan.with_cumsum("_seen", F.when(F.col("_kind") == 0, 1).otherwise(0).cast("long"))
    placed = materialize(scan.frame().select(*keys, "_kind", "_id", "_l", "_r", "_seen"))
    spans = (
        placed.where(F.col("_kind") != 0)
        .groupBy(*keys, "_id")
        .agg(
            F.max(F.when(F.col("_kind") == -1, F.col("_seen"))).alias("_lo"),
            F.max(F.when(F.col("_kind") == 1, F.col("_seen"))).alias("_hi"),
            F.max_by("_l", "_kind").alias("_l"),
        )
    )
    blocks = (
        placed.where(F.col("_kind") == 0)
        .withColumn("_blk", F.floor((F.col("_seen") - 1) / block))
        .groupBy(*keys, "_blk")
        .agg(F.collect_list(F.struct((F.col("_seen") - 1).alias("p"), F.col("_r").alias("r"))).alias("_rows"))
    )
    visits = spans.where(F.col("_hi") > F.col("_lo")).select(
        *keys,
        "_id",
        "_lo",
        "_hi",
        F.col("_l"),
        F.explode(F.sequence(F.floor(F.col("_lo") / block), F.floor((F.col("_hi") - 1) / block))).alias("_blk"),
    )
    opened = visits.join(blocks, [*keys, "_blk"]).select("_id", "_lo", "_hi", "_rows", "_l.*")
    inside = F.filter("_rows", lambda e: (e["p"] >= F.col("_lo")) & (e["p"] < F.col("_hi")))
    ranked = F.transform(
        inside,
        lambda e: F.struct(
            *[c.alias(f"k{i}") for i, c in enumerate(rank(e["r"]))], e["p"].alias("p"), e["r"].alias("r")
        ),
    )
    winners = opened.select(*[F.col(k).alias(f"_key_{k}") for k in keys], "_id", F.array_min(ranked).alias("_w"))
    best = winners.groupBy(*[f"_key_{k}" for k in keys], "_id").agg(F.min("_w").alias("_w"))
    match = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    best = best.withColumnRenamed("_id", "_win_id")
    condition = F.col("_id") == F.col("_win_id")
    for part in match:
        condition = condition & part
    return spans.join(best, condition, "left").select("_l.*", F.col("_w.r").alias("best"))


def value_then_time(left_time: str, left_value: str, right_time: str, right_value: str, equal=values_equal):
    """Exact values win by time; otherwise smaller value difference, then time."""

    def rank(r: Column) -> list[Column]:
        diff = F.abs(r[right_value] - F.col(left_value))
        away = F.abs(r[right_time] - F.col(left_time))
        exact = equal(F.col(left_value), r[right_value])
        return [F.when(exact, 0).otherwise(1), F.when(exact, F.lit(0.0)).otherwise(diff), away]

    return rank


def closest_value(left_time: str, left_value: str, right_time: str, right_value: str):
    """Smallest value difference, then smallest time difference."""
    return lambda r: [F.abs(r[right_value] - F.col(left_value)), F.abs(r[right_time] - F.col(left_time))]


def row_match(left_time: str, right_time: str, mapping: dict[str, str], equal=values_equal):
    """Most equal columns, then smallest summed difference, then time."""

    def rank(r: Column) -> list[Column]:
        hits, gap = F.lit(0), F.lit(0.0)
        for a, b in mapping.items():
            same = equal(F.col(a), r[b])
            hits = hits - F.when(same, 1).otherwise(0)
            gap = gap + F.when(same, F.lit(0.0)).otherwise(F.coalesce(F.abs(r[b] - F.col(a)), F.lit(0.0)))
        return [hits, gap, F.abs(r[right_time] - F.col(left_time))]

    return rank


def direction_summary(before: DataFrame, after: DataFrame, keys: Sequence[str], left_value: str, right_value: str) -> DataFrame:
    """Match rates of both directions and the better one (ties: more matches, then after)."""
    keys = list(keys)

    def stats(df: DataFrame, name: str) -> DataFrame:
        equal = values_equal(F.col(left_value), F.col("best")[right_value])
        return df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("best").isNotNull()).alias(f"{name}_matches"),
            F.count_if(F.col("best").isNotNull() & equal).alias(f"{name}_exact"),
        )

    joined = stats(before, "before").join(stats(after, "after").drop("total"), keys)
    return joined.withColumn(
        "direction", F.when(F.col("before_exact") > F.col("after_exact"), "before").otherwise("after")
    )


def expand_intervals(
    packets: DataFrame, signal: DataFrame, keys: Sequence[str], packet_time: str, signal_time: str, value: str,
    mode: str = "packet_bins", out_of_range: str = "skip", epsilon: float = 1e-9,
) -> DataFrame:
    """One signal value per packet from the interval [t_i, t_i+1) it falls into.

    A packet outside all intervals gets null (``skip``), the nearest value (``hold``) or
    fails the query (``error``)."""
    if out_of_range not in ("skip", "hold", "error"):
        raise ValueError(f"unknown policy {out_of_range!r}")
    keys = list(keys)
    found = neighbours(packets, signal, keys, packet_time, signal_time, signal_time, [value])
    inside = F.col("prev").isNotNull() & F.col("next").isNotNull()
    v0, v1 = F.col("prev")[value], F.col("next")[value]
    flat = F.abs(v1 - v0) <= epsilon
    t0, t1 = F.col("prev")["t"], F.col("next")["t"]
    if mode == "hold":
        moved = v0
    elif mode == "time_interp":
        moved = v0 + (F.col(packet_time) - t0) / (t1 - t0) * (v1 - v0)
    elif mode in ("packet_bins", "hybrid"):
        inner = found.withColumn("_t0", t0)
        ranked = Ordered(inner.where(inside), [*keys, "_t0"], [packet_time]).with_row_number("_k").frame()
        sizes = inner.where(inside).groupBy(*keys, "_t0").agg(F.count(F.lit(1)).alias("_m"))
        found = ranked.join(sizes, [*keys, "_t0"]).unionByName(inner.where(~inside), allowMissingColumns=True)
        moved = v0 + (F.col("_k") + 1) / (F.col("_m") + 1) * (v1 - v0)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    edge = F.coalesce(v0, v1) if out_of_range == "hold" else F.lit(None).cast("double")
    if out_of_range == "error":
        edge = F.raise_error(F.concat(F.lit("outside the signal: "), F.col(packet_time).cast("string"))).cast("double")
    out = found.withColumn("expanded", F.when(inside, F.when(flat, v0).otherwise(moved)).otherwise(edge))
    assigned = F.lit(True) if out_of_range == "hold" else inside
    return out.withColumn("assigned", assigned).withColumn("interval_start", F.when(inside, t0)).drop(
        "prev", "next", "_t0", "_k", "_m"
    )


def merge_on_time(groups: list[DataFrame], time: str) -> DataFrame:
    """Join group tables on the union of their timestamps, first row per timestamp,
    keep only complete rows."""
    firsts = []
    for df in groups:
        columns = [c for c in df.columns if c not in (time, "_tie")]
        body = F.struct(*[F.col(c) for c in columns])
        firsts.append(df.groupBy(time).agg(F.min_by(body, "_tie").alias("b")).select(time, "b.*"))
    merged = firsts[0]
    for df in firsts[1:]:
        merged = merged.join(df, time, "full_outer")
    return merged.dropna()


def full_outer_diffs(groups: dict[str, DataFrame], time: str, value: str) -> DataFrame:
    """Wide table of one column per group, full outer on time."""
    merged = None
    for name, df in groups.items():
        part = df.select(time, F.col(value).alias(name))
        merged = part if merged is None else merged.join(part, time, "full_outer")
    return merged


def clip_to_range(original: DataFrame, parsed: DataFrame, original_time: str, parsed_time: str, margin: int, shift: int = 0) -> DataFrame:
    """Original rows inside the parsed time range shrunk by ``margin`` on both sides."""
    bounds = parsed.agg((F.min(parsed_time) + margin + shift).alias("_a"), (F.max(parsed_time) - margin + shift).alias("_b"))
    inside = (F.col(original_time) >= F.col("_a")) & (F.col(original_time) <= F.col("_b"))
    return original.crossJoin(F.broadcast(bounds)).where(inside).drop("_a", "_b")


def trim_spread(df: DataFrame, keys: Sequence[str], value: str, width: float = 1.0) -> DataFrame:
    """Values within mean +- ``width`` population deviations, with before/after statistics."""
    keys = list(keys)
    stats = df.groupBy(*keys).agg(
        F.avg(value).alias("mean_before"), F.stddev_pop(value).alias("std_before"), F.count(value).alias("n_before")
    )
    joined = with_group(df, stats, keys)
    kept = joined.where(F.abs(F.col(value) - F.col("mean_before")) <= width * F.col("std_before"))
    after = kept.groupBy(*keys).agg(
        F.avg(value).alias("mean_after"), F.stddev_pop(value).alias("std_after"), F.count(value).alias("n_after")
    )
    return with_group(stats, after, keys)
