"""Payloads of periods: packets picked by index, cut into periods of a fixed count, the server's data joined in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.operators.greedy import greedy_select
from tracelode.plans.ordered import Ordered


def indexed_packets(packets: DataFrame, keys: Sequence[str], order: Sequence[str], indices: DataFrame | None = None, index: str = "packet_index") -> DataFrame:
    """``packets`` with ``index``, their place in order; with ``indices`` (keys, index) only those named there, each once."""
    rows = Ordered(packets, keys, order).with_row_number(index).frame()
    return rows if indices is None else rows.join(indices.select(*keys, index), [*keys, index], "left_semi")


def period_payloads(
    packets: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, period: int, server: Column, data: str = "data", drop_empty: bool = False
) -> DataFrame:
    """(keys, period_no, timestamp, parts, payload) of every ``period`` packets of a session.

    The timestamp is that of the first packet; ``server`` tells packets sent by a server, of which those with data are joined in
    order.  A period holds ``period`` packets at most, so what is collected is bounded."""
    keys, order = list(keys), list(order)
    rows = Ordered(packets, keys, order).with_row_number("_rn").frame().withColumn("period_no", F.floor(F.col("_rn") / period))
    part = F.when(server & (F.length(data) > 0), F.struct("_rn", F.hex(data).alias("h")))
    out = rows.groupBy(*keys, "period_no").agg(F.min_by(time, "_rn").alias("timestamp"), F.array_sort(F.collect_list(part)).alias("_p"))
    out = out.select(*keys, "period_no", "timestamp", F.size("_p").alias("parts"), F.unhex(F.array_join(F.transform("_p", lambda p: p["h"]), "")).alias("payload"))
    return out.where(F.col("parts") > 0) if drop_empty else out


def sampled_payloads(periods: DataFrame, keys: Sequence[str], every: int) -> DataFrame:
    """Periods at least ``every``, in units of the timestamp, after the last one kept; a period without a timestamp goes."""
    return greedy_select(periods.where(F.col("timestamp").isNotNull()), list(keys), "timestamp", F.lit(every), ["timestamp", "period_no"])


def consistent_sessions(periods: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only sessions whose payloads are all of one length, which field inference asks for; ``payload_length`` tells it."""
    sizes = periods.groupBy(*keys).agg(F.min(F.length("payload")).alias("payload_length"), F.max(F.length("payload")).alias("_hi"))
    return periods.join(sizes.where(F.col("payload_length") == F.col("_hi")).drop("_hi"), list(keys))
