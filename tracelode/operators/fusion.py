"""Alarm holding, fusion of asynchronous streams, window evidence and hybrid rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.operators.metrics import ratio
from tracelode.plans.ordered import Ordered


def hold(df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, alarm: str, span: float, name: str = "held") -> DataFrame:
    """Alarm stays on for ``span`` after an alarm point, both ends included."""
    if span <= 0:
        return df.withColumn(name, F.col(alarm))
    rows = Ordered(df, keys, order).with_cummax("_last", F.when(F.col(alarm), F.col(time)))
    held = F.coalesce(F.col(time) - F.col("_last") <= span, F.lit(False))
    return rows.with_column(name, held).frame().drop("_last")


def fuse(df: DataFrame, keys: Sequence[str], time: str, stream: str, alarm: str, streams: Sequence[str], votes: int = 1, tie: str | None = None) -> DataFrame:
    """State of every stream at each distinct time, from when all have reported; the
    fused alarm needs ``votes`` streams (1 is OR)."""
    keys = list(keys)
    order = F.col(tie) if tie else F.lit(0)
    at = df.groupBy(*keys, time).agg(
        *[F.max_by(F.when(F.col(stream) == s, F.col(alarm)), F.when(F.col(stream) == s, order)).alias(s) for s in streams]
    )
    scan = Ordered(at, keys, [time])
    for s in streams:
        scan = scan.with_last_known(s, F.col(s))
    out = scan.frame()
    for s in streams:
        out = out.where(F.col(s).isNotNull())
    count = sum((F.when(F.col(s), 1).otherwise(0) for s in streams), F.lit(0))
    return out.select(*keys, time, count.alias("votes")).withColumn("fused", F.col("votes") >= votes)


def window_evidence(df: DataFrame, keys: Sequence[str], time: str, size: int, channel: str, alarm: str, score_ratio: str) -> DataFrame:
    """Alarming channels and the highest score ratio of at least 1 per window."""
    at = F.floor(F.col(time) / size) * size
    return df.groupBy(*keys, at.alias("window_start")).agg(
        F.countDistinct(F.when(F.col(alarm), F.col(channel))).alias("channels"),
        F.max(F.when(F.col(score_ratio) >= 1, F.col(score_ratio))).alias("max_ratio"),
    )


def hybrid(evidence: DataFrame, other: str, low: float, high: float, gate: int) -> DataFrame:
    """Predictions by rule: either, gated by channel count, high confidence."""
    found = F.col("channels") > 0
    top = F.coalesce(F.col("max_ratio"), F.lit(0.0))
    agree = F.coalesce(F.col(other), F.lit(False))
    return (
        evidence.withColumn("rule_or", found | agree)
        .withColumn("rule_gated", agree | (F.col("channels") >= gate))
        .withColumn("rule_confident", agree | (top >= high))
        .withColumn("rule_vote", (top >= high) | ((top >= low) & (agree | (F.col("channels") >= gate))))
    )


def asymmetric(ratios: DataFrame, other: str, low: float, high: float, votes: int, joint_weight: int) -> DataFrame:
    """High-confidence, or low-confidence with agreement or enough votes."""
    parts = {"sup": 1, "ctrl": 1, "joint": joint_weight}
    value = {p: F.coalesce(F.col(p), F.lit(0.0)) for p in parts}
    cast = sum((F.when(value[p] >= low, w).otherwise(0) for p, w in parts.items()), F.lit(0))
    top = F.greatest(*value.values(), F.lit(0.0))
    chosen = (top >= high) | ((top >= low) & (F.coalesce(F.col(other), F.lit(False)) | (cast >= votes)))
    return ratios.withColumn("votes", cast).withColumn("predicted", chosen)


def subset_votes(hits: DataFrame, instance: str, channel: str, pre: str, attack: str, start: str, channels: Sequence[str]) -> DataFrame:
    """Counts for every channel subset and vote.

    ``hits``: first alarm before and inside the attack per (instance, channel).
    Subsets are bit masks exploded per instance, so the work grows with the
    instances; the masks only depend on the configured channels."""
    bit = F.create_map(*[x for i, c in enumerate(channels) for x in (F.lit(c), F.lit(1 << i))])
    per = hits.groupBy(instance).agg(
        F.collect_list(F.struct(F.try_element_at(bit, F.col(channel)).alias("b"), F.col(pre).alias("p"), F.col(attack).alias("a"))).alias("h"),
        F.min(start).alias("t0"),
    )
    rows = per.withColumn("mask", F.explode(F.sequence(F.lit(1), F.lit((1 << len(channels)) - 1))))
    rows = rows.withColumn("vote", F.explode(F.sequence(F.lit(1), F.bit_count("mask"))))
    mine = F.filter("h", lambda e: (e["b"].bitwiseAND(F.col("mask"))) != 0)
    before = F.size(F.filter(mine, lambda e: e["p"].isNotNull()))
    inside = F.array_sort(F.filter(F.transform(mine, lambda e: e["a"]), lambda a: a.isNotNull()))
    hit = F.size(inside) >= F.col("vote")
    early = before >= F.col("vote")
    rows = rows.withColumn("_hit", hit).withColumn("_early", early).withColumn("_tte", F.get(inside, F.col("vote") - 1) - F.col("t0"))
    counts = rows.groupBy("mask", "vote").agg(
        F.count_if("_hit").alias("tp"), F.count_if("_early").alias("fp"), F.count_if(~F.col("_early")).alias("tn"), F.count_if(~F.col("_hit")).alias("fn"),
        F.count_if(F.col("_hit") & ~F.col("_early")).alias("strict_tp"), F.avg(F.when(F.col("_hit"), F.col("_tte"))).alias("tte_mean"),
        F.count(F.lit(1)).alias("instances"),
    )
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumn("f1", ratio(2 * precision * recall, precision + recall)).withColumn("strict_aer", F.col("strict_tp") / F.col("instances"))


def clean_alarm_seconds(alarms: DataFrame, channel: str, time: str, unit: int = 1_000_000) -> DataFrame:
    """Distinct channels alarming per second, as a count per number of channels."""
    per = alarms.groupBy(F.floor(F.col(time) / unit).alias("sec")).agg(F.countDistinct(channel).alias("channels"))
    return per.groupBy("channels").agg(F.count(F.lit(1)).alias("seconds"))


def ordered_union(names: Column) -> Column:
    """Distinct members of pipe lists in first-seen order."""
    return F.array_join(F.filter(F.array_distinct(F.flatten(F.transform(names, lambda n: F.split(n, r"\|")))), lambda n: n != ""), "|")
