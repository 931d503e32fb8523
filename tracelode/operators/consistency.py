"""Cross-level consistency: do a supervisory and a control series of the same
variable still agree?

Window statistics for every lag come from one pass of sums.  A row is copied once
per (window, lag) it takes part in, a fixed factor, and the sums are combined
before the shuffle; no window is ever collected."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.operators.alignment import asof, interpolated, neighbours
from tracelode.operators.resample import normalize, shift_time
from tracelode.plans.ordered import Ordered, halo
from tracelode.plans.quantiles import mad, medians, quantiles, with_group
from tracelode.plans.sizing import small_side
from tracelode.session import materialize


@dataclass(frozen=True)
class ConsistencyConfig:
    window: int = 60
    step: int = 5
    max_lag: int = 5
    lag_mad_multiplier: float = 3.0
    alpha: float = 0.5
    beta: float = 0.35
    gamma: float = 0.15
    residual_quantile: float = 0.99
    residual_run: int = 3
    top_pairs: int = 2
    consecutive: int = 3
    min_points: int = 10
    policy: str = "system_threshold"
    digits: int = 9


EPS = 1e-9


def prepare(rows: DataFrame, keys: Sequence[str], time: str, method: str = "robust_zscore") -> DataFrame:
    """Paired raw series (keys, time, xr, yr) to dense positions and normalized values."""
    finite = rows.where(F.col("xr").isNotNull() & F.col("yr").isNotNull())
    dense = Ordered(materialize(finite), keys, [time]).with_row_number("i").frame()
    return materialize(normalize(normalize(dense, keys, "xr", method, "x"), keys, "yr", method, "y"))


def pair_on_grid(sup: DataFrame, ctl: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """Common-grid axis: both sides resampled to the same steps."""
    keys = list(keys)
    left = sup.select(*keys, time, F.col(value).alias("xr"))
    return left.join(ctl.select(*keys, time, F.col(value).alias("yr")), [*keys, time])


def pair_on_supervisory(
    sup: DataFrame, ctl: DataFrame, keys: Sequence[str], time: str, value: str, tie: str, tolerance: float, discrete: bool, offset: int = 0
) -> DataFrame:
    """Supervisory axis: control values matched to the supervisory times."""
    keys = list(keys)
    moved = shift_time(ctl, time, offset)
    marks = sup.select(*keys, time, F.col(value).alias("xr"))
    found = neighbours(marks, moved.select(*keys, F.col(time).alias("_ct"), tie, value), keys, time, "_ct", tie, [value])
    if discrete:
        out = asof(found, time, "backward", tolerance).withColumn("yr", F.col("match")[value])
    else:
        out = interpolated(found, time, value, tolerance).withColumnRenamed("matched", "yr")
    return out.select(*keys, time, "xr", "yr")


def _copies(rows: DataFrame, keys: Sequence[str], config: ConsistencyConfig) -> DataFrame:
    """Rows repeated for every complete window they belong to."""
    sizes = rows.groupBy(*keys).agg((F.max("i") + 1).alias("_n"))
    joined = rows.join(small_side(sizes), list(keys))
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - config.window + 1) / config.step)).cast("long")
    last = F.least(F.floor(F.col("i") / config.step), F.floor((F.col("_n") - config.window) / config.step)).cast("long")
    windows = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return joined.withColumn("win", F.explode(windows)).drop("_n")


def _correlation(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column, least: int, digits: int) -> Column:
    vx, vy = sxx / n - (sx / n) * (sx / n), syy / n - (sy / n) * (sy / n)
    cov = sxy / n - (sx / n) * (sy / n)
    usable = (n >= max(2, least)) & (vx > EPS * EPS) & (vy > EPS * EPS)
    return F.coalesce(F.when(usable, F.round(F.try_divide(cov, F.sqrt(vx * vy)), digits)), F.lit(0.0))


def lag_correlations(prepared: DataFrame, keys: Sequence[str], config: ConsistencyConfig) -> DataFrame:
    """Shape and trend correlation per (window, lag).

    ``prepared``: (keys, i, x, y, ...) with dense i; lag l pairs x[i] with y[i + l],
    both inside the window; trends pair the following differences."""
    keys, L = list(keys), config.max_lag
    spread = halo(prepared.select(*keys, "i", "x", "y"), keys, "i", L, L + 1)
    w = Window.partitionBy(*keys, "_blk").orderBy("i")

    def at(offset: int) -> Column:
        return F.lead("y", offset).over(w) if offset >= 0 else F.lag("y", -offset).over(w)

    shifted = spread.select("*", F.lead("x", 1).over(w).alias("_x1"), *[at(o).alias(f"_y{o + L}") for o in range(-L, L + 2)])
    shifted = shifted.where(F.col("_home") == F.col("_blk"))
    lags = F.array(
        *[F.struct(F.lit(o).alias("lag"), F.col(f"_y{o + L}").alias("y"), F.col(f"_y{o + L + 1}").alias("y1")) for o in range(-L, L + 1)]
    )
    rows = _copies(shifted.select(*keys, "i", "x", "_x1", lags.alias("_lags")), keys, config)
    rows = rows.withColumn("_p", F.explode("_lags")).select(*keys, "win", "i", "x", "_x1", "_p.*")
    start = F.col("win") * config.step
    end = start + config.window
    partner = F.col("i") + F.col("lag")
    rows = rows.where((partner >= start) & (partner < end) & F.col("y").isNotNull())
    inner = (F.col("i") + 1 < end) & (partner + 1 < end)
    dx = F.when(inner, F.col("_x1") - F.col("x"))
    dy = F.when(inner, F.col("y1") - F.col("y"))
    x, y = F.col("x"), F.col("y")
    sums = rows.groupBy(*keys, "win", "lag").agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"),
        F.count(dx).alias("m"), F.sum(dx).alias("tx"), F.sum(dy).alias("ty"), F.sum(dx * dx).alias("txx"), F.sum(dy * dy).alias("tyy"), F.sum(dx * dy).alias("txy"),
    )
    c = F.col
    shape = _correlation(c("n"), c("sx"), c("sy"), c("sxx"), c("syy"), c("sxy"), config.min_points, config.digits)
    trend = _correlation(c("m"), c("tx"), c("ty"), c("txx"), c("tyy"), c("txy"), max(2, config.min_points - 1), config.digits)
    return sums.select(*keys, "win", "lag", "n", shape.alias("shape_corr"), trend.alias("trend_corr"))


def best_lags(correlations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Highest shape correlation per window; ties go to the smallest lag."""
    order = F.struct((-F.col("shape_corr")).alias("c"), F.col("lag"))
    body = F.struct("lag", "n", "shape_corr", "trend_corr")
    return correlations.groupBy(*keys, "win").agg(F.min_by(body, order).alias("b")).select(*keys, "win", "b.*")


def residuals_at(prepared: DataFrame, lags: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raw residual sup[i] - ctl[i + lag] for one lag per group."""
    keys = list(keys)
    sup = prepared.select(*keys, "i", "xr").join(small_side(lags), keys).withColumn("_j", F.col("i") + F.col("lag"))
    ctl = prepared.select(*keys, F.col("i").alias("_j"), "yr")
    return sup.join(ctl, [*keys, "_j"]).select(*keys, "i", (F.col("xr") - F.col("yr")).alias("residual"))


def _pair_scores(prepared: DataFrame, best: DataFrame, limits: DataFrame, keys: list[str], pair: str, config: ConsistencyConfig) -> DataFrame:
    """Disagreement per window at its best lag."""
    rows = _copies(prepared.select(*keys, "i", "xr"), keys, config)
    chosen = rows.join(best, [*keys, "win"]).withColumn("_j", F.col("i") + F.col("lag"))
    start = F.col("win") * config.step
    chosen = chosen.where((F.col("_j") >= start) & (F.col("_j") < start + config.window))
    ctl = prepared.select(*keys, F.col("i").alias("_j"), "yr")
    joined = chosen.join(ctl, [*keys, "_j"]).join(small_side(limits.select(pair, "residual_median", "residual_threshold")), pair)
    off = F.abs(F.col("xr") - F.col("yr") - F.col("residual_median")) > F.greatest(F.lit(EPS), F.col("residual_threshold"))
    flagged = joined.withColumn("_off", off)
    # A window holds at most ``window`` rows, so this partition is bounded.
    w = Window.partitionBy(*keys, "win").orderBy("i")
    runs = flagged.withColumn("_g", F.row_number().over(w) - F.sum(F.when(F.col("_off"), 1).otherwise(0)).over(w))
    streak = runs.groupBy(*keys, "win", "_g").agg(
        F.count_if("_off").alias("_s"), F.count(F.lit(1)).alias("_c"), F.first("lag").alias("lag"),
        F.first("shape_corr").alias("shape_corr"), F.first("trend_corr").alias("trend_corr"), F.first("n").alias("n"),
    )
    total = config.alpha + config.beta + config.gamma
    out = streak.groupBy(*keys, "win").agg(
        F.max("_s").alias("longest_streak"), (F.sum("_s") / F.sum("_c")).alias("exceedance_ratio"), F.first("lag").alias("best_lag"),
        (1 - F.first("shape_corr")).alias("d_shape"), (1 - F.first("trend_corr")).alias("d_trend"), F.first("n").alias("n"),
    )
    out = out.withColumn("d_res", F.when(F.col("longest_streak") >= config.residual_run, 1.0).otherwise(0.0))
    score = (config.alpha * F.col("d_shape") + config.beta * F.col("d_trend") + config.gamma * F.col("d_res")) / total
    return out.where(F.col("n") >= max(2, config.min_points)).withColumn("pair_score", F.round(score, config.digits + 3))


def calibrate_lags(correlations: DataFrame, keys: Sequence[str], pair: str, config: ConsistencyConfig) -> DataFrame:
    """Lag centre (half-even median of the best lags), spread and tolerance per pair."""
    lags = best_lags(correlations, keys).select(pair, F.col("lag").cast("double").alias("lag"))
    stats = mad(lags, [pair], "lag")
    radius = F.greatest(F.lit(1), F.ceil(config.lag_mad_multiplier * F.greatest(F.lit(1.0), F.col("mad"))))
    centre = F.rint("median").cast("int")
    return stats.select(
        pair, centre.alias("lag_center"), F.col("mad").alias("lag_mad"),
        F.greatest(F.lit(-config.max_lag), centre - radius).cast("int").alias("lag_low"),
        F.least(F.lit(config.max_lag), centre + radius).cast("int").alias("lag_high"),
    )


def calibrate_residuals(prepared: DataFrame, lags: DataFrame, keys: Sequence[str], pair: str, config: ConsistencyConfig) -> DataFrame:
    """Residual median and the quantile of absolute deviations at the lag centre."""
    rows = materialize(residuals_at(prepared, _with_segments(prepared, lags, keys, pair), keys))
    middle = materialize(medians(rows, [pair], "residual", "residual_median"))
    apart = with_group(rows, middle, [pair]).withColumn("_d", F.abs(F.col("residual") - F.col("residual_median")))
    limit = quantiles(apart, [pair], "_d", {"residual_threshold": config.residual_quantile})
    return middle.join(small_side(limit), pair)


def _with_segments(prepared: DataFrame, lags: DataFrame, keys: Sequence[str], pair: str) -> DataFrame:
    groups = prepared.select(*keys).distinct()
    return groups.join(small_side(lags.select(pair, F.col("lag_center").alias("lag"))), pair)


@dataclass
class ConsistencyModel:
    pairs: DataFrame
    system_threshold: float
    config: ConsistencyConfig


def pair_windows(prepared: DataFrame, keys: Sequence[str], pair: str, limits: DataFrame, config: ConsistencyConfig) -> DataFrame:
    """Pair scores with lags restricted to the calibrated tolerance."""
    keys = list(keys)
    correlations = materialize(lag_correlations(prepared, keys, config))
    allowed = correlations.join(small_side(limits.select(pair, "lag_low", "lag_high")), pair)
    inside = allowed.where(F.col("lag").between(F.col("lag_low"), F.col("lag_high"))).drop("lag_low", "lag_high")
    return materialize(_pair_scores(prepared, best_lags(inside, keys), limits, keys, pair, config))


def fit(prepared: DataFrame, keys: Sequence[str], pair: str, config: ConsistencyConfig) -> ConsistencyModel:
    """Calibrate lags, residual limits and score thresholds on benign segments."""
    keys = list(keys)
    lags = materialize(calibrate_lags(lag_correlations(prepared, keys, config), keys, pair, config))
    limits = materialize(lags.join(small_side(calibrate_residuals(prepared, lags, keys, pair, config)), pair))
    scores = pair_windows(prepared, keys, pair, limits, config)
    tops = scores.groupBy(pair).agg(F.max("pair_score").alias("pair_threshold"), F.count(F.lit(1)).alias("training_windows"))
    model = materialize(limits.join(small_side(tops), pair))
    segments = [k for k in keys if k != pair]
    system = system_scores(scores, model, segments, pair, config)
    threshold = system.agg(F.max("system_score").alias("t")).first()["t"]
    return ConsistencyModel(model, float(threshold), config)


def system_scores(scores: DataFrame, model: DataFrame, segments: Sequence[str], pair: str, config: ConsistencyConfig) -> DataFrame:
    """Mean of the k highest pair scores per window, with alarming pairs."""
    group = [*segments, "win"]
    marked = scores.join(small_side(model.select(pair, "pair_threshold")), pair)
    w = Window.partitionBy(*group).orderBy(F.col("pair_score").desc(), F.col(pair))
    ranked = marked.withColumn("_r", F.row_number().over(w))
    alarm = (F.col("d_res") > 0) | (F.col("pair_score") > F.col("pair_threshold"))
    top = F.col("_r") <= config.top_pairs
    names = F.array_sort(F.collect_list(F.when(top, F.struct("_r", F.col(pair).alias("p")))))
    return ranked.groupBy(*group).agg(
        F.round(F.avg(F.when(top, F.col("pair_score"))), config.digits + 3).alias("system_score"),
        F.array_join(F.transform(names, lambda e: e["p"]), "|").alias("top_pairs"),
        F.count(F.lit(1)).alias("available_pairs"), F.count_if(alarm).alias("pair_alarms"),
        F.array_join(F.array_sort(F.collect_list(F.when(alarm, F.col(pair)))), "|").alias("alarming_pairs"),
    )


def score(prepared: DataFrame, keys: Sequence[str], pair: str, model: ConsistencyModel) -> DataFrame:
    """System scores of new segments, gated alarms included."""
    scores = pair_windows(prepared, keys, pair, model.pairs, model.config)
    segments = [k for k in keys if k != pair]
    system = system_scores(scores, model.pairs, segments, pair, model.config)
    return gate(system.withColumn("system_threshold", F.lit(model.system_threshold)), segments, model.config)


def gate(system: DataFrame, segments: Sequence[str], config: ConsistencyConfig) -> DataFrame:
    """Alarm once ``consecutive`` windows in a row are above threshold."""
    if config.policy in ("any_pair", "or", "any_pv"):
        above = F.col("pair_alarms") > 0
    elif config.policy in ("system_threshold", "score_threshold"):
        above = F.col("system_score") > F.col("system_threshold")
    else:
        raise ValueError(f"unknown policy {config.policy!r}")
    return streaks(system.withColumn("above_threshold", above), segments, ["win"], "above_threshold", config.consecutive)


def streaks(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, needed: int) -> DataFrame:
    """``consecutive_count`` of true rows so far and ``alarm_flag`` at ``needed``."""
    rows = Ordered(df, keys, order).with_row_number("_rn")
    rows = rows.with_cummax("_reset", F.when(~F.col(flag), F.col("_rn")))
    count = F.when(F.col(flag), F.col("_rn") - F.coalesce("_reset", F.lit(-1))).otherwise(0)
    out = rows.with_column("consecutive_count", count).frame().drop("_rn", "_reset")
    return out.withColumn("alarm_flag", F.col("consecutive_count") >= needed)


def longest_streaks(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str) -> DataFrame:
    return streaks(df, keys, order, flag, 1).groupBy(*keys).agg(F.max("consecutive_count").alias("longest"))


def alarm_events(windows: DataFrame, keys: Sequence[str], order: str, start: str, end: str) -> DataFrame:
    """Maximal runs of alarm windows: span, peak score and pairs in first-seen order.

    A pair counts once per run at its first window, so the list that is collected is
    bounded by the number of pairs."""
    keys = list(keys)
    rows = Ordered(windows, keys, [order]).with_lag("_p", F.col("alarm_flag"))
    rows = rows.with_islands("_run", F.col("alarm_flag") & ~F.coalesce("_p", F.lit(False))).frame()
    active = rows.where("alarm_flag")
    spans = active.groupBy(*keys, "_run").agg(
        F.min(start).alias("alarm_start"), F.max(end).alias("alarm_end"), F.max("system_score").alias("max_score"), F.count(F.lit(1)).alias("windows")
    )
    seen = active.select(*keys, "_run", order, F.posexplode(F.split("top_pairs", r"\|")).alias("_k", "pair"))
    first = seen.groupBy(*keys, "_run", "pair").agg(F.min(F.struct(F.col(order), F.col("_k"))).alias("_f"))
    names = F.array_sort(F.collect_list(F.struct("_f", "pair")))
    lists = first.groupBy(*keys, "_run").agg(F.array_join(F.transform(names, lambda e: e["pair"]), "|").alias("contributing_pairs"))
    return spans.join(lists, [*keys, "_run"]).drop("_run")
