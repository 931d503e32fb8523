"""Structured Streaming forms of the order-dependent operators.

All of them take a watermark, which bounds the state kept per key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelode.plans.sizing import fits


def sessions(stream: DataFrame, keys: Sequence[str], time: str, gap: str, late: str) -> DataFrame:
    """Inactivity sessions with size and bounds."""
    window = F.session_window(time, gap)
    return stream.withWatermark(time, late).groupBy(*keys, window.alias("session")).agg(
        F.count(F.lit(1)).alias("n"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts")
    )


def window_alarms(stream: DataFrame, keys: Sequence[str], time: str, size: str, alarm: Column, late: str) -> DataFrame:
    """Alarm flag and first alarm time per tumbling window."""
    return stream.withWatermark(time, late).groupBy(*keys, F.window(time, size).alias("window")).agg(
        F.bool_or(alarm).alias("alarm"), F.min(F.when(alarm, F.col(time))).alias("first_alarm"), F.count(F.lit(1)).alias("n")
    )


def _timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.EventTimeTimeout


def pattern_matches(
    stream: DataFrame, key: str, time: str, token: str, pattern: Sequence[str], late: str, idle_ms: int | None = None
) -> DataFrame:
    """Online matcher: advance on the expected token; on a mismatch start over and try the
    same token as the first one.  Emits (key, start_ts, end_ts) per complete match.

    A key's place in the pattern is kept until ``idle_ms`` of event time pass without a
    row of it, for ever if that is None."""
    wanted = list(pattern)
    kind = stream.schema[key].dataType.simpleString()

    def match(group, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, start = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(batches)).sort_values(time)
        found = []
        for stamp, value in zip(rows[time], rows[token]):
            seconds = pd.Timestamp(stamp).timestamp()
            if value != wanted[at]:
                at = 0
            if value == wanted[at]:
                start = seconds if at == 0 else start
                at += 1
                if at == len(wanted):
                    found.append((group[0], start, seconds))
                    at = 0
        state.update((at, float(start)))
        if idle_ms is not None:
            state.setTimeoutTimestamp(int(rows[time].max().timestamp() * 1000) + idle_ms)
        yield pd.DataFrame(found, columns=[key, "start_ts", "end_ts"])

    return (
        stream.withWatermark(time, late)
        .groupBy(key)
        .applyInPandasWithState(
            match, f"{key} {kind}, start_ts double, end_ts double", "at int, start double", "append", _timeout(idle_ms)
        )
    )


def gated_alarms(stream: DataFrame, key: str, time: str, alarm: str, needed: int, late: str, idle_ms: int | None = None) -> DataFrame:
    """Rows whose alarm streak reached ``needed``; the streak is the only state, kept
    until ``idle_ms`` of event time pass without a row of the key, for ever if None."""
    kind = stream.schema[key].dataType.simpleString()

    def gate(group, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (streak,) = state.get if state.exists else (0,)
        rows = pd.concat(list(batches)).sort_values(time)
        out = []
        for stamp, on in zip(rows[time], rows[alarm]):
            streak = streak + 1 if on else 0
            if streak >= needed:
                out.append((group[0], pd.Timestamp(stamp).timestamp(), streak))
        state.update((streak,))
        if idle_ms is not None:
            state.setTimeoutTimestamp(int(rows[time].max().timestamp() * 1000) + idle_ms)
        yield pd.DataFrame(out, columns=[key, "ts", "streak"])

    return (
        stream.withWatermark(time, late)
        .groupBy(key)
        .applyInPandasWithState(gate, f"{key} {kind}, ts double, streak int", "streak int", "append", _timeout(idle_ms))
    )


def first_alarms(
    stream: DataFrame, channel: str, time: str, value: str, model: DataFrame, limits: DataFrame, tails: DataFrame, start: float, end: float, late: str,
    idle_ms: int | None = None, most_models: int = 100_000,
) -> DataFrame:
    """First alarm of every channel before ``start`` and in [start, end), epoch seconds: (channel, phase, ts).

    ``model`` is what :func:`tracelode.operators.subspace.train` gives, ``limits`` (channel, threshold), ``tails`` (channel, tail),
    the last L training values.  A window of L values ends at each row; the state of a channel is its last L values, and
    nothing once both phases are settled.  Rows of a channel must arrive in order of time from batch to batch; inside a
    batch they are sorted.  Channels without a model give nothing.  Models meet the rows as a table of at most
    ``most_models`` components; more channels than that take several streams."""
    if not fits(model, most_models):
        raise ValueError(f"the model has over {most_models} components: run one stream for each part of the channels")
    found = {}
    for name, rows in model.toPandas().groupby(channel):
        rows = rows.sort_values("component")
        found[name] = (np.array(rows["basis"].tolist()).T, rows["projection"].to_numpy(), rows["weight"].to_numpy())
    bounds = {r[channel]: (float(r["threshold"]), [float(x) for x in r["tail"]]) for r in limits.join(tails, channel).collect()}
    kind = stream.schema[channel].dataType.simpleString()

    def scan(group, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        name = group[0]
        if name not in found or name not in bounds:
            return
        threshold, seed = bounds[name]
        tail, before_done, inside_done = state.get if state.exists else (seed, False, False)
        out = []
        if not (before_done and inside_done):
            rows = pd.concat(list(batches)).sort_values(time, kind="stable")
            at = rows[time].astype("datetime64[us]").astype("int64").to_numpy() / 1e6
            basis, projection, weight = found[name]
            seen = np.concatenate([tail, rows[value].to_numpy(float)])
            windows = np.lib.stride_tricks.sliding_window_view(seen, len(seed))[1:]
            apart = (projection - windows @ basis) * weight
            alarm = np.einsum("ij,ij->i", apart, apart) >= threshold
            before, inside = alarm & (at < start), alarm & (at >= start) & (at < end)
            if not before_done and before.any():
                out.append((name, "before", float(at[before.argmax()])))
            if not inside_done and inside.any():
                out.append((name, "inside", float(at[inside.argmax()])))
            before_done = before_done or bool(before.any()) or at[-1] >= start
            inside_done = inside_done or bool(inside.any()) or at[-1] >= end
            tail = [] if before_done and inside_done else seen[-len(seed) :].tolist()
            if idle_ms is not None:
                state.setTimeoutTimestamp(int(at[-1] * 1000) + idle_ms)
        state.update((list(tail), bool(before_done), bool(inside_done)))
        yield pd.DataFrame(out, columns=[channel, "phase", "ts"])

    return (
        stream.withWatermark(time, late)
        .groupBy(channel)
        .applyInPandasWithState(
            scan, f"{channel} {kind}, phase string, ts double", "tail array<double>, before_done boolean, inside_done boolean", "append", _timeout(idle_ms)
        )
    )
