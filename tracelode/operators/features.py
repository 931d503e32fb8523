"""Packet, sequence, flow and cycle features for one-class models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions.binary import bytes_or_empty
from tracelode.plans.ordered import Ordered, ahead

HEADER = 7
PACKET_BYTES = 57
SEQUENCE_BYTES = 14
STATS = ("duration", "packets", "bytes", "min_size", "mean_size", "max_size", "std_size", "min_iat", "mean_iat", "max_iat", "std_iat")


def padded_bytes(payload: Column, width: int) -> Column:
    """First ``width`` bytes as numbers, zero padded."""
    values = F.transform(bytes_or_empty(F.substring(payload, 1, width)), lambda b: b.cast("double"))
    return F.slice(F.concat(values, F.array_repeat(F.lit(0.0), width)), 1, width)


def packet_vector(header: Sequence[Column], payload: Column, width: int = PACKET_BYTES) -> Column:
    return F.concat(F.array(*[h.cast("double") for h in header]), padded_bytes(payload, width))


def sequence_vectors(df: DataFrame, keys: Sequence[str], order: Sequence[str], header: Sequence[Column], payload: Column, time: str, label: Column, size: int = 3) -> DataFrame:
    """Concatenated vectors of ``size`` consecutive packets, stamped with the last one;
    the label is set when any packet has it."""
    base = df.withColumn("_v", packet_vector(header, payload, SEQUENCE_BYTES)).withColumn("_label", label)
    rows = Ordered(base, keys, order).with_row_number("pos").frame().select(*keys, "pos", time, "_v", "_label")
    wide = ahead(rows, keys, "pos", size, {"_w": F.struct("_v", F.col(time).alias("t"), "_label")})
    return wide.where(F.size("_w") == size).select(
        *keys, "pos", F.col("_w")[size - 1]["t"].alias("ts"), F.flatten(F.transform("_w", lambda e: e["_v"])).alias("features"),
        F.exists("_w", lambda e: e["_label"]).alias("label"),
    )


def flow_features(df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, size: str, forward: Column, label: Column, unit: float = 1000.0) -> DataFrame:
    """11 statistics over all, forward and backward packets of every flow (33 in all).

    Gaps come from three ordered scans; everything after is one conditional
    aggregate with partial combination."""
    keys = list(keys)
    base = df.withColumn("_fwd", forward).withColumn("_label", label)
    rows = Ordered(base, keys, order).with_lag("_gap_all", F.col(time))
    t = F.col(time)
    for name, flag in (("fwd", F.col("_fwd")), ("bwd", ~F.col("_fwd"))):
        # Last time of the same direction before this row.
        rows = rows.with_last_known(f"_seen_{name}", F.when(flag, t)).with_lag(f"_gap_{name}", F.col(f"_seen_{name}"))
    out = rows.frame()
    aggregates: list[Column] = []
    for name, flag in (("all", F.lit(True)), ("fwd", F.col("_fwd")), ("bwd", ~F.col("_fwd"))):
        n = F.when(flag, F.col(size).cast("double"))
        gap = F.when(flag, (t - F.col(f"_gap_{name}")) / unit)
        values = [
            (F.max(F.when(flag, t)) - F.min(F.when(flag, t))) / unit, F.count(n).cast("double"), F.sum(n), F.min(n), F.avg(n), F.max(n), F.stddev_pop(n),
            F.min(gap), F.avg(gap), F.max(gap), F.stddev_pop(gap),
        ]
        aggregates += [F.coalesce(v, F.lit(0.0)).alias(f"{name}_{s}") for s, v in zip(STATS, values)]
    return out.groupBy(*keys).agg(
        *aggregates, F.bool_or("_label").alias("label"), ((F.min(time) + F.max(time)) / 2).alias("mid_ts"),
        F.coalesce(F.min(F.when(F.col("_label"), t)), F.min(time)).alias("sample_ts"),
    )


def feature_vector(df: DataFrame, name: str = "features") -> DataFrame:
    """The 33 named statistics as one array."""
    columns = [f"{side}_{s}" for side in ("all", "fwd", "bwd") for s in STATS]
    return df.withColumn(name, F.array(*columns))
