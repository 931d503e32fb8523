"""Session keys, inactivity sessions and token encodings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.plans.ordered import Ordered
from tracelode.plans.sizing import small_side
from tracelode.session import materialize

# Server ports of the supported industrial protocols.
PROTOCOL_PORTS = {"modbus": (502, 503), "enip": (44818,), "mms": (102,)}


def is_protocol_port(port: Column, protocol: str | None = None) -> Column:
    """Port predicate for one protocol, or for any of them."""
    names = [protocol] if protocol else list(PROTOCOL_PORTS)
    return port.isin([p for name in names for p in PROTOCOL_PORTS[name]])


def protocol_of(src_port: Column, dst_port: Column) -> Column:
    """First protocol (enip, modbus, mms) that owns either port."""
    result = F.lit(None).cast("string")
    for name in ("mms", "modbus", "enip"):
        hit = is_protocol_port(src_port, name) | is_protocol_port(dst_port, name)
        result = F.when(hit, F.lit(name)).otherwise(result)
    return result


def session_endpoints(a: Column, b: Column) -> tuple[Column, Column]:
    """Direction-free endpoint pair."""
    return F.least(a, b), F.greatest(a, b)


def token(direction: Column, length: Column, code: Column) -> Column:
    return F.concat_ws("-", direction, length.cast("string"), code)


def sessionize(
    df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], timeout: float, name: str = "session_no"
) -> Ordered:
    """Inactivity sessions: a gap of exactly ``timeout`` still belongs together."""
    rows = Ordered(df, keys, order).with_lag("_prev", F.col(time))
    gap = F.col("_prev").isNull() | (F.col(time) - F.col("_prev") > timeout)
    return rows.with_islands(name, gap).transform(lambda d: d.drop("_prev"))


def arrival_sessions(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], timeout: float, name: str = "session_no") -> DataFrame:
    """Sessions of rows in order of arrival: a row joins the first session of its keys whose latest arrival it follows by
    ``timeout`` at most, or precedes; else it opens the next one.  Sessions count from 1.

    Where every earlier time lies more than ``timeout`` before every later one, nothing before can be joined any more, and
    the rows are cut into stretches.  A stretch without a step over ``timeout`` is one session, which needs no more than
    scans; others are read in order by a kernel that keeps the latest time of each session of the stretch."""
    keys, order = list(keys), list(order)
    rows = Ordered(df, keys, order).with_row_number("_rn").with_cummax("_top", F.col(time)).with_lag("_before", F.col("_top")).with_lag("_last", F.col(time))
    largest = rows.largest
    back = rows.frame().withColumn("_back", -F.col("_rn"))
    later = Ordered(back, keys, ["_back"], largest).with_cummax("_rest", -F.col(time)).frame().drop("_back")
    clean = F.col("_before").isNull() | (-F.col("_rest") - F.col("_before") > timeout)
    cut = materialize(Ordered(later.withColumn("_cut", clean), keys, ["_rn"], largest).with_islands("_stretch", F.col("_cut")).frame())
    step = ~F.col("_cut") & (F.col(time) - F.col("_last") > timeout)
    place = [*keys, "_stretch"]
    mixed = cut.where(step).select(*place).distinct()
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}")) for c in place]
    plain = cut.alias("r").join(mixed.alias("m"), same, "left_anti").withColumn("_own", F.lit(1).cast("long"))
    open_ = cut.alias("r").join(mixed.alias("m"), same, "left_semi").withColumn("_own", F.lit(0).cast("long"))
    numbered = materialize(plain.unionByName(_first_matches(open_, place, time, timeout)))
    counts = numbered.groupBy(*place).agg(F.max("_own").alias("_n"))
    before = Ordered(counts, keys, ["_stretch"]).with_cumsum("_sum", F.col("_n")).frame().select(*place, (F.col("_sum") - F.col("_n")).alias("_skip"))
    joined = numbered.alias("r").join(before.alias("m"), same).select("r.*", "m._skip")
    return joined.select(*df.columns, (F.col("_skip") + F.col("_own")).alias(name))


def _first_matches(rows: DataFrame, place: list[str], time: str, timeout: float) -> DataFrame:
    """Numbers of the sessions of each stretch, rows read as a stream in order of arrival."""
    placed = rows.repartition(*place).sortWithinPartitions(*place, "_rn")

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, latest = None, []
        for batch in batches:
            out = np.zeros(len(batch), np.int64)
            stretches = list(zip(*(batch[c].tolist() for c in place)))
            for i, (stretch, at) in enumerate(zip(stretches, batch[time].tolist())):
                if stretch != now:
                    now, latest = stretch, []
                for k, last in enumerate(latest):
                    if at - last <= timeout:
                        latest[k] = at
                        break
                else:
                    k = len(latest)
                    latest.append(at)
                out[i] = k + 1
            yield batch.assign(_own=out)

    return placed.mapInPandas(number, rows.schema)


def session_stats(df: DataFrame, keys: Sequence[str], time: str, session: str = "session_no") -> DataFrame:
    """Merged session sizes: map-side combined, no per-session collection."""
    return df.groupBy(*keys, session).agg(
        F.count(F.lit(1)).alias("n"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts")
    )


def pack_token(direction: Column, function: Column, length: Column) -> Column:
    """1 direction bit, 5 function bits, 10 length bits."""
    high = F.shiftleft(direction.bitwiseAND(F.lit(1)), 15)
    middle = F.shiftleft(function.bitwiseAND(F.lit(31)), 10)
    return high.bitwiseOR(middle).bitwiseOR(length.bitwiseAND(F.lit(1023)))


def unpack_token(packed: Column) -> tuple[Column, Column, Column]:
    return (
        F.shiftrightunsigned(packed, 15).bitwiseAND(F.lit(1)),
        F.shiftrightunsigned(packed, 10).bitwiseAND(F.lit(31)),
        packed.bitwiseAND(F.lit(1023)),
    )


def token_dictionary(df: DataFrame, keys: Sequence[str], tokens: str) -> DataFrame:
    """Ordered dictionary per session: ids 0.. in token order.

    The distinct list is taken first, so the ranking sees a vocabulary, not rows."""
    vocabulary = df.select(*keys, tokens).distinct()
    ranked = Ordered(vocabulary, keys, [tokens]).with_row_number("token_id")
    return ranked.frame()


def encode_tokens(df: DataFrame, keys: Sequence[str], tokens: str) -> DataFrame:
    dictionary = token_dictionary(df, keys, tokens)
    return df.join(small_side(dictionary), [*keys, tokens], "inner")
