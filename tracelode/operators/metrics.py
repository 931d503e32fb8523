"""Fit errors, confusion counts, window counts and exposure times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.operators.alignment import asof, neighbours
from tracelode.plans.ordered import Ordered
from tracelode.plans.quantiles import medians, with_group
from tracelode.plans.sizing import fits, small_side


def fit_metrics(df: DataFrame, keys: Sequence[str], parsed: str, target: str) -> DataFrame:
    """MSE, RMSE, MAE, R2 and MAPE over pairs without nulls.

    R2 is 0 below two points; a constant target gives 1 when matched exactly, else 0.
    MAPE leaves out zero targets and is infinite when nothing is left."""
    keys = list(keys)
    p, t = F.col(parsed), F.col(target)
    rows = df.where(p.isNotNull() & t.isNotNull())
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((p - t) * (p - t)).alias("mse"),
        F.avg(F.abs(p - t)).alias("mae"),
        F.sum((p - t) * (p - t)).alias("_res"),
        F.var_pop(t).alias("_var"),
        F.avg(F.when(t != 0, F.abs((t - p) / F.nullif(t, F.lit(0.0))))).alias("_mape"),
    )
    total = F.col("_var") * F.col("n")
    r2 = (
        F.when(F.col("n") < 2, 0.0)
        .when(F.col("_var") == 0, F.when(F.col("_res") == 0, 1.0).otherwise(0.0))
        .otherwise(1 - F.try_divide(F.col("_res"), total))
    )
    return out.select(
        *keys, "n", "mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"),
        F.coalesce(F.col("_mape") * 100, F.lit(float("inf"))).alias("mape"),
    )


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 for an empty denominator."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(df: DataFrame, keys: Sequence[str], predicted: Column, actual: Column) -> DataFrame:
    """tp, fp, tn, fn and the derived rates."""
    counts = df.groupBy(*keys).agg(
        F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & ~actual).alias("tn"), F.count_if(~predicted & actual).alias("fn"),
    )
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = counts.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    out = out.withColumn("accuracy", ratio(tp + tn, tp + fp + tn + fn))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def balanced(counts: DataFrame, train_normal: str, train_alarm: str) -> DataFrame:
    """Training, validation and balanced accuracy."""
    tacc = ratio(F.col(train_normal), F.col(train_normal) + F.col(train_alarm))
    vacc = 0.5 * (ratio(F.col("tn"), F.col("tn") + F.col("fp")) + ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return counts.withColumn("tacc", tacc).withColumn("vacc", vacc).withColumn("bacc", 0.5 * (F.col("tacc") + F.col("vacc")))


def best_parameters(results: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Row with the largest bacc; the first one wins ties."""
    body = F.struct(*[F.col(c) for c in results.columns if c not in keys])
    return results.groupBy(*keys).agg(F.min_by(body, F.struct((-F.col("bacc")).alias("b"), F.col(order))).alias("_b")).select(*keys, "_b.*")


def label_times(df: DataFrame, time: str, intervals: DataFrame, start: str, end: str, name: str, most: int = 1_000) -> DataFrame:
    """True when the time lies in any half-open interval.

    A measured handful of intervals travels with the scan.  More of them are put on the
    same time axis: a point is inside when the latest end among the intervals that
    started so far lies after it."""
    if fits(intervals, most):
        spans = intervals.agg(F.collect_list(F.struct(F.col(start).alias("a"), F.col(end).alias("b"))).alias("_i"))
        inside = F.exists("_i", lambda i: (F.col(time) >= i["a"]) & (F.col(time) < i["b"]))
        return df.crossJoin(F.broadcast(spans)).withColumn(name, inside).drop("_i")
    body = F.struct(*[F.col(c) for c in df.columns])
    points = df.select(F.col(time).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_until"), body.alias("_row"))
    marks = intervals.groupBy(F.col(start).alias("_at")).agg(F.max(end).alias("_until")).select(
        "_at", F.lit(0).alias("_side"), "_until", F.lit(None).cast(points.schema["_row"].dataType).alias("_row")
    )
    scan = Ordered(points.unionByName(marks), [], ["_at", "_side"]).with_cummax("_open", F.col("_until")).frame()
    rows = scan.where(F.col("_side") == 1)
    return rows.select("_row.*", F.coalesce(F.col("_open") > F.col("_at"), F.lit(False)).alias(name))


def window_label(start: Column, attack_start: Column, attack_end: Column) -> Column:
    """attack inside the interval, ignored after it, else clean."""
    return (
        F.when((start >= attack_start) & (start < attack_end), "attack").when(start >= attack_end, "ignored").otherwise("clean")
    )


def window_trace(df: DataFrame, keys: Sequence[str], time: str, size: int, predicted: Column, actual: Column, ignored: Column) -> DataFrame:
    """Flags and first alert times per tumbling window."""
    scored = ~actual & ~ignored
    return df.groupBy(*keys, F.floor(F.col(time) / size).alias("window_id")).agg(
        F.bool_or(actual).alias("has_attack"), F.bool_or(~actual & ignored).alias("has_ignored"), F.bool_or(scored).alias("has_clean"),
        F.bool_or(predicted).alias("has_alert"), F.bool_or(predicted & actual).alias("has_attack_alert"),
        F.bool_or(predicted & scored).alias("has_clean_alert"), F.min(F.when(predicted, F.col(time))).alias("first_alert"),
        F.min(F.when(predicted & actual, F.col(time))).alias("first_attack_alert"),
    )


def window_counts(trace: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attack windows count first, ignored ones are left out, the rest is clean."""
    attack = F.col("has_attack")
    ignored = ~attack & F.col("has_ignored")
    clean = ~attack & ~F.col("has_ignored")
    return trace.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("windows"), F.count_if(attack).alias("attack_windows"), F.count_if(ignored).alias("ignored_windows"),
        F.count_if(attack & F.col("has_attack_alert")).alias("tp"), F.count_if(attack & ~F.col("has_attack_alert")).alias("fn"),
        F.count_if(clean & F.col("has_clean_alert")).alias("fp"), F.count_if(clean & ~F.col("has_clean_alert")).alias("tn"),
        F.count_if(ignored & F.col("has_alert")).alias("alerted_ignored"),
    )


def merge_windows(windows: DataFrame, keys: Sequence[str], label: str, alarm: str) -> DataFrame:
    """Alarm OR and label precedence attack > clean > ignored over tasks."""
    rank = F.when(F.col(label) == "attack", 2).when(F.col(label) == "clean", 1).otherwise(0)
    out = windows.groupBy(*keys).agg(F.max(rank).alias("_r"), F.bool_or(alarm).alias(alarm), F.count(F.lit(1)).alias("tasks"))
    name = F.when(F.col("_r") == 2, "attack").when(F.col("_r") == 1, "clean").otherwise("ignored")
    return out.withColumn(label, name).drop("_r")


def exposure(alarms: DataFrame, intervals: DataFrame, time: str, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """First alarm inside each half-open interval and the time it took.

    Alarm times are reduced to distinct points and carried to the interval starts by
    a scan (the next alarm at or after the start), so no range join is needed."""
    points = alarms.select(F.col(time).alias("at")).distinct().withColumn("_tie", F.lit(0))
    found = asof(neighbours(intervals, points, [], start, "at", "_tie", ["at"]), start, "forward")
    first = F.when(F.col("match")["at"] < F.col(end), F.col("match")["at"])
    return found.select(*keys, start, end, first.isNotNull().alias("exposed"), (first - F.col(start)).alias("tte"))


def exposure_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attacks"), F.count_if("exposed").alias("exposed_count"), F.avg(F.when(F.col("exposed"), 1.0).otherwise(0.0)).alias("aer"),
        F.avg("tte").alias("tte_mean"), F.min("tte").alias("tte_min"), F.max("tte").alias("tte_max"),
    )
    middle = medians(rows.where(F.col("tte").isNotNull()), keys, "tte", "tte_median")
    return with_group(base, middle, keys) if not keys else base.join(small_side(middle), keys, "left")


def first_rising_edge(df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, alarm: str, start: Column, end: Column) -> DataFrame:
    """Delay of the first alarm that begins inside the interval."""
    rows = Ordered(df, keys, order).with_lag("_p", F.col(alarm)).frame()
    rising = F.col(alarm) & ~F.coalesce("_p", F.lit(False)) & (F.col(time) >= start) & (F.col(time) < end)
    return rows.groupBy(*keys).agg(F.min(F.when(rising, F.col(time) - start)).alias("tte"))


def rollup_counts(counts: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Totals per prefix of ``levels`` (task, stage, all) with rates."""
    sums = counts.rollup(*levels).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")], F.grouping_id().cast("int").alias("level"))
    return with_rates(sums)


def scaled_windows(intervals: DataFrame, start: str, end: str, scales: Sequence[float], longest: Column | None = None) -> DataFrame:
    """Interval ends at each scale of the duration, never past the original end."""
    base = longest if longest is not None else F.col(end) - F.col(start)
    rows = intervals.withColumn("scale", F.explode(F.array(*[F.lit(float(s)) for s in scales])))
    scaled = F.greatest(F.lit(0.0), base * F.col("scale"))
    return rows.withColumn("effective_end", F.least(F.col(end), (F.col(start) + scaled).cast("long")))


def normalized_window(start: Column, end: Column, limit_seconds: float | None, shift_seconds: float) -> tuple[Column, Column]:
    """Attack window in seconds: capped duration, then shifted."""
    last = F.least(end, start + limit_seconds) if limit_seconds is not None else end
    return start + shift_seconds, last + shift_seconds
