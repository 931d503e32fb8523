"""Autocorrelation, peak picking and period search."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.operators.greedy import greedy_select
from tracelode.operators.patterns import SEPARATOR, numbered_rows, positions, session_lengths
from tracelode.operators.sessions import token_dictionary
from tracelode.plans.ordered import Ordered, ahead
from tracelode.plans.sizing import small_side
from tracelode.session import materialize


@dataclass(frozen=True)
class PeriodConfig:
    autocorr_threshold: float = 0.65
    max_lag: int = 40
    min_segments: int = 10
    similarity_threshold: float = 0.9
    time_jitter_ratio: float = 1.2
    coverage_threshold: float = 0.55
    patience: int = 10
    best_tolerance: float = 0.9
    tolerance: float = 0.9
    start_prefix: str = "C"


def autocorrelation(numbered: DataFrame, keys: Sequence[str], value: str, max_lag: int) -> DataFrame:
    """Biased autocorrelation for lags 0..max_lag-1.

    Expanding the centred product keeps it to one pass over integer sums, so
    neither a mean join nor a second scan is needed and sums are exact."""
    rows = ahead(numbered, keys, "pos", max_lag, {"_next": F.col(value).cast("long")})
    x, left = F.col("_next")[0], F.size("_next")
    lags = range(max_lag)
    # One row stays one row: a sum of products for each lag, and what the ends of the session take off the plain sum.
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("t0"),
        *[F.sum(F.try_element_at("_next", F.lit(k + 1)) * x).alias(f"_p{k}") for k in lags],
        *[F.sum(F.when(left <= k, x)).alias(f"_e{k}") for k in lags],
        *[F.sum(F.when(F.col("pos") < k, x)).alias(f"_b{k}") for k in lags],
    )
    zero = F.lit(0)
    parts = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_p{k}").alias("sxy"), F.coalesce(f"_e{k}", zero).alias("end"), F.coalesce(f"_b{k}", zero).alias("begin")) for k in lags])
    joined = sums.select(*keys, "n", "t0", F.col("_p0").alias("s0"), F.explode(parts).alias("_l")).where(F.col("_l.lag") < F.col("n")).select(
        *keys, "n", "t0", "s0", F.col("_l.lag").alias("lag"), F.col("_l.sxy").alias("sxy"), (F.col("n") - F.col("_l.lag")).alias("m"),
        (F.col("t0") - F.col("_l.end")).alias("sx"), (F.col("t0") - F.col("_l.begin")).alias("sy"),
    )
    mean = F.col("t0") / F.col("n")
    centred = F.col("sxy") - mean * (F.col("sx") + F.col("sy")) + F.col("m") * mean * mean
    variance = F.col("s0") - F.col("t0") * mean
    return joined.select(*keys, "lag", F.when(variance > 0, centred / variance).alias("r"))


def peaks(acf: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Local maxima of at most ``max_lag`` rows per session; a plateau counts once,
    at its middle, and the two ends never count."""
    w = Window.partitionBy(*keys).orderBy("lag")
    step = F.when(F.col("r") == F.lag("r").over(w), 0).otherwise(1)
    runs = acf.withColumn("_s", step).withColumn("_run", F.sum("_s").over(w))
    tops = runs.groupBy(*keys, "_run").agg(
        F.floor((F.min("lag") + F.max("lag")) / 2).cast("int").alias("lag"), F.first("r").alias("r")
    )
    by_run = Window.partitionBy(*keys).orderBy("_run")
    around = tops.withColumn("_p", F.lag("r").over(by_run)).withColumn("_n", F.lead("r").over(by_run))
    return around.where((F.col("r") > F.col("_p")) & (F.col("r") > F.col("_n")) & (F.col("r") >= threshold)).select(
        *keys, "lag", "r"
    )


def segment_table(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, tokens: str, lags: DataFrame, config: PeriodConfig, direct: int = 1_000
) -> tuple[DataFrame, DataFrame]:
    """Statistics of every base segment of every candidate period, and the bases' tokens as ``token_id``; ``base_pos`` names a base.

    A base is a distinct window that starts with the client prefix in the leading part of the session; ``df`` holds a
    ``token_id`` for each token of a session, so windows are short arrays of integers.  In sessions of up to ``direct`` rows
    every base meets the later windows as they are, at most ``direct`` for each row.  In longer ones they meet through an
    equality join on pieces: a window with at most ``e`` differing tokens agrees with the base on at least one of ``e + 1``
    pieces, so nothing is compared pair by pair blindly."""
    keys = list(keys)
    ordered = numbered_rows(df, keys, order)
    numbered = materialize(ordered.frame().select(
        *keys, "pos", F.col("token_id").cast("int").alias("_t"), F.col(tokens).startswith(config.start_prefix).alias("_lead"), F.col(time).alias("_ts")
    ))
    lengths = session_lengths(numbered, keys)
    reach = config.max_lag
    windows = ahead(numbered, keys, "pos", reach, {"_toks": F.col("_t"), "_times": F.col("_ts")})
    periods = materialize(lags.select(*keys, F.col("lag").alias("period")).join(small_side(lengths), keys))
    group = [*keys, "period"]
    cut = (
        windows.join(small_side(periods), keys)
        .where(F.size("_toks") >= F.col("period"))
        .select(*group, "n", "pos", "_lead", "_ts", F.slice("_toks", F.lit(1), F.col("period")).alias("seg"), F.element_at("_times", F.col("period")).alias("_end"))
    )
    lead = F.floor(F.col("n") * (1 - config.coverage_threshold)) - 1
    bases = materialize(
        cut.where((F.col("pos") < lead) & F.col("_lead"))
        .groupBy(*group, "n", "seg")
        .agg(F.min("pos").alias("base_pos"), F.min_by("_ts", "pos").alias("base_ts"), F.min_by("_end", "pos").alias("base_end"))
    )
    left = bases.select(*group, "n", F.col("seg").alias("base"), "base_pos")
    right = cut.where((F.col("pos") < F.col("n") - F.col("period"))).select(*group, "n", "pos", F.col("_ts").alias("ts"), F.col("_end").alias("end_ts"), "seg")
    same = F.size(F.filter(F.zip_with("base", "seg", lambda a, b: a == b), lambda v: v)) / F.col("period")

    def meet(bases: DataFrame, later: DataFrame, on: list[str]) -> DataFrame:
        pairs = bases.drop("n").join(later.drop("n"), on).where(F.col("pos") >= F.col("base_pos") + F.col("period")).withColumn("sim", same)
        return pairs.where(F.col("sim") >= config.similarity_threshold).select(*group, "base_pos", "pos", "sim", "ts", "end_ts")

    short = F.col("n") <= direct
    near = meet(left.where(short), right.where(short), group)
    if ordered.largest > direct:
        allowed = F.floor(F.round((1 - config.similarity_threshold) * F.col("period"), 6)).cast("int")
        width = F.greatest(F.floor(F.col("period") / (allowed + 1)), F.lit(1)).cast("int")

        def pieces(column: str) -> Column:
            count = F.ceil(F.col("period") / width).cast("int")
            return F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(F.slice(column, i * width + 1, width)))).alias("piece", "code")

        long = meet(left.where(~short).select("*", pieces("base")), right.where(~short).select("*", pieces("seg")), [*group, "piece", "code"])
        near = near.unionByName(long.groupBy(*group, "base_pos", "pos").agg(*(F.first(c).alias(c) for c in ("sim", "ts", "end_ts"))))
    picked = greedy_select(near, [*group, "base_pos"], "pos", F.col("period"), bound=ordered.largest)
    first = bases.select(
        *group, "base_pos", F.col("base_pos").alias("pos"), F.lit(None).cast("double").alias("sim"), F.col("base_ts").alias("ts"), F.col("base_end").alias("end_ts")
    )
    rows = picked.unionByName(first)
    seq = Ordered(rows, [*group, "base_pos"], ["pos"], ordered.largest).with_lead("next_ts", F.col("ts")).frame()
    gap = (F.col("next_ts") - F.col("end_ts")) / 1e6
    length = (F.col("end_ts") - F.col("ts")) / 1e6
    stats = seq.groupBy(*group, "base_pos").agg(
        F.count(F.lit(1)).alias("segments"),
        F.avg("sim").alias("similarity"),
        F.avg(gap).alias("interval_mean"),
        F.stddev_samp(gap).alias("interval_std"),
        F.avg(length).alias("duration_mean"),
        F.stddev_samp(length).alias("duration_std"),
    )
    stats = stats.join(small_side(lengths), keys).withColumn("coverage", F.col("segments") * F.col("period") / F.col("n"))
    return stats, bases.select(*group, "base_pos", "seg")


def named_bases(stats: DataFrame, bases: DataFrame, dictionary: DataFrame, keys: Sequence[str], tokens: str) -> DataFrame:
    """``stats`` with the text ``base`` of each base."""
    group = [*keys, "period", "base_pos"]
    spread = bases.join(small_side(stats.select(*group)), group).select(*group, F.posexplode("seg").alias("_i", "token_id"))
    words = spread.join(small_side(dictionary.select(*keys, "token_id", tokens)), [*keys, "token_id"])
    texts = words.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", tokens))), lambda e: e[tokens]), SEPARATOR).alias("base"))
    return stats.join(texts, group)


def valid_segments(stats: DataFrame, config: PeriodConfig) -> DataFrame:
    """Enough segments, steady spacing, similar and covering enough."""
    return stats.where(
        (F.col("segments") > config.min_segments)
        & (F.col("interval_std") <= F.col("interval_mean") * config.time_jitter_ratio)
        & (F.col("similarity") >= config.similarity_threshold)
        & (F.col("coverage") >= config.coverage_threshold)
    )


_RESULT = (
    "period int, period_pattern string, segments long, coverage double, similarity double, interval_mean double, "
    "interval_std double, duration_mean double, duration_std double"
)


def _ratio(current: float, best: float, floor: float) -> float:
    now, then = (current - floor) / (1 - floor), (best - floor) / (1 - floor)
    return now / (then if then > 0 else 1)


def _best_base(rows: pd.DataFrame, cfg: PeriodConfig):
    """Ordered choice among the valid bases of one period."""
    best, stale = None, 0
    zero = {"coverage": 0.0, "similarity": 0.0, "interval_mean": 0.0, "interval_std": 0.0, "duration_mean": float("inf"), "duration_std": float("inf")}
    for row in rows.sort_values("base_pos").to_dict("records"):
        held = best or zero
        if row["similarity"] < held["similarity"]:
            stale += 1
            if stale > cfg.patience:
                break
            continue
        weight = _ratio(row["coverage"], held["coverage"], cfg.coverage_threshold) or 1e-12
        votes = (
            (row["coverage"] > held["coverage"] * cfg.best_tolerance)
            + (row["interval_mean"] > held["interval_mean"])
            + (row["duration_mean"] < held["duration_mean"])
            + (
                row["interval_std"] / weight < held["interval_std"]
                or row["duration_std"] / weight < held["duration_std"]
            )
        )
        if votes >= 3:
            best, stale = row, 0
    return best


def choose_period(stats: DataFrame, keys: Sequence[str], config: PeriodConfig) -> DataFrame:
    """Best period per session.  The input holds only the *valid* bases, a few rows
    per session, and invalid ones cannot influence the ordered choice."""
    keys = list(keys)
    fields = ", ".join(f"{c} {stats.schema[c].dataType.simpleString()}" for c in keys)

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        best = None
        for period, rows in pdf.groupby("period", sort=True):
            row = _best_base(rows, config)
            if row is None:
                continue
            if best is not None:
                repeat, rest = divmod(int(period), int(best["period"]))
                if rest == 0 and repeat > 1 and row["base"].split(SEPARATOR) == best["base"].split(SEPARATOR) * repeat:
                    continue
            held_cov = best["coverage"] if best else 0.0
            weight = (period / (best["period"] if best else 1)) * (
                _ratio(row["coverage"], held_cov, config.coverage_threshold) or 1e-12
            )
            steadier = best is None or (
                row["interval_std"] / weight < best["interval_std"] or row["duration_std"] / weight < best["duration_std"]
            )
            if row["coverage"] * config.tolerance > held_cov and steadier:
                best = row
        if best is None:
            return pd.DataFrame(columns=[*keys, *[f.split()[0] for f in _RESULT.split(", ")]])
        best = {**best, "period_pattern": best["base"]}
        return pd.DataFrame([{c: best[c] for c in [*keys, *[f.split()[0] for f in _RESULT.split(", ")]]}])

    return stats.groupBy(*keys).applyInPandas(decide, f"{fields}, {_RESULT}")


def identify_periods(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, tokens: str, config: PeriodConfig = PeriodConfig()
) -> DataFrame:
    """Period, pattern and stability per session."""
    keys = list(keys)
    dictionary = materialize(token_dictionary(df, keys, tokens))
    coded = df.join(small_side(dictionary), [*keys, tokens], "left")
    numbered = positions(coded.where(F.col("token_id").isNotNull()), keys, order)
    acf = autocorrelation(numbered, keys, "token_id", config.max_lag)
    lags = materialize(peaks(acf, keys, config.autocorr_threshold))
    stats, bases = segment_table(coded, keys, order, time, tokens, lags, config)
    valid = materialize(valid_segments(stats, config))
    best = choose_period(named_bases(valid, bases, dictionary, keys, tokens), keys, config)
    score = lags.select(*keys, F.col("lag").alias("period"), F.col("r").alias("autocorr_score"))
    return best.join(score, [*keys, "period"], "left")


def periods_by_length(results: DataFrame) -> DataFrame:
    """Sessions per period length."""
    return results.groupBy("period").agg(F.count(F.lit(1)).alias("sessions"), F.avg("coverage").alias("coverage"))


def consistency(results: DataFrame, key: str, capture: str, pattern: str, interval: Column, length_sum: Column, max_cv: float = 0.1) -> DataFrame:
    """Cross-capture stability of sessions seen in at least two captures."""
    return (
        results.groupBy(key)
        .agg(
            F.countDistinct(capture).alias("captures"),
            F.countDistinct(pattern).alias("patterns"),
            F.countDistinct(length_sum).alias("length_sums"),
            F.avg(interval).alias("interval_mean"),
            F.stddev_pop(interval).alias("interval_std"),
        )
        .where(F.col("captures") >= 2)
        .withColumn("interval_cv", F.try_divide("interval_std", "interval_mean"))
        .withColumn("interval_stable", F.col("interval_cv") <= max_cv)
    )
