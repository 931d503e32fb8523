"""Find where known values sit inside payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.functions.binary import decode, is_finite
from tracelode.operators.recovery import typed_number
from tracelode.plans.sizing import broadcast_rows, fits, small_side
from tracelode.session import materialize

# Lengths that a number type has by definition.
WIDTHS = {
    "UINT8": (1,), "INT8": (1,), "UINT16": (2,), "INT16": (2,), "UINT32": (4,), "INT32": (4,), "UINT64": (8,), "INT64": (8,),
    "FLOAT32": (4,), "FLOAT64": (8,), "TIMESTAMP": (4, 8),
}


def offset_values(payloads: DataFrame, keys: Sequence[str], payload: str, length: int, kind: str, endian: str = "big") -> DataFrame:
    """Decoded value at every offset of every payload."""
    data = F.col(payload)
    last = F.length(data) - length
    at = F.explode(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")))
    rows = payloads.select(*keys, payload, at.alias("offset"))
    return rows.select(*keys, "offset", decode(data, F.col("offset"), length, kind, endian).alias("found"))


def locate_values(
    payloads: DataFrame, keys: Sequence[str], payload: str, expected: DataFrame, value: str, length: int, kind: str,
    endian: str = "big", tolerance: float = 1e-4,
) -> DataFrame:
    """(keys, offset, value) wherever a decoded value equals an expected one.

    Both sides are put on a grid one tolerance wide and meet through an equality
    join on the cell and its neighbours; the exact test follows."""
    found = offset_values(payloads, keys, payload, length, kind, endian).where(F.col("found").isNotNull())
    cell = found.withColumn("_cell", F.floor(F.col("found") / tolerance))
    wanted = expected.select(F.col(value).cast("double").alias("expected")).distinct()
    near = wanted.withColumn("_c", F.floor(F.col("expected") / tolerance)).withColumn(
        "_cell", F.explode(F.array(F.col("_c") - 1, F.col("_c"), F.col("_c") + 1))
    )
    hits = cell.join(near, "_cell").where(F.abs(F.col("found") - F.col("expected")) < tolerance)
    return hits.select(*keys, "offset", "found", "expected").distinct()


def locate_sequence(
    payloads: DataFrame, keys: Sequence[str], payload: str, expected: Sequence[float], length: int, kind: str,
    endian: str = "big", tolerance: float = 1e-4,
) -> DataFrame:
    """Offsets at which the expected values follow each other without a gap."""
    data = F.col(payload)
    last = F.length(data) - length * len(expected)
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    rows = payloads.select(*keys, payload, F.explode(starts).alias("offset"))
    for i, value in enumerate(expected):
        got = decode(data, F.col("offset") + i * length, length, kind, endian)
        rows = rows.where(F.abs(got - float(value)) < tolerance)
    return rows.select(*keys, "offset")


def match_counts(hits: DataFrame) -> DataFrame:
    """Matches per offset over all payloads."""
    return hits.groupBy("offset").agg(F.count(F.lit(1)).alias("matches"), F.countDistinct("expected").alias("values"))


def literal_number(data: Column, start: Column, length: int, kind: str, endian: str) -> Column:
    """``typed_number`` of one known format, by the shorter expression where the length is the type's own."""
    order = "little" if endian == "little" or (endian == "n/a" and length > 1) else "big"
    if length in WIDTHS.get(kind, ()):
        return decode(data, start, length, kind, order)
    return typed_number(data, start, *(F.lit(v) for v in (length, kind, endian)))


def all_offsets(payloads: DataFrame, keys: Sequence[str], payload: str, formats: DataFrame) -> DataFrame:
    """(keys, offset, length, type, endian, found): every offset of every payload decoded in every format of (length, type,
    endian).  There are as many formats as there are number types and byte orders, so each has its own expression.

    Decoding is the whole work and a payload file is small, so payloads are dealt over all cores first."""
    context = payloads.sparkSession.sparkContext
    parts = max(context.defaultParallelism, int(payloads.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = F.explode(F.when(F.length(payload) > 0, F.sequence(F.lit(0), F.length(payload) - 1)))
    rows = payloads.select(*keys, payload).repartition(parts, *keys).withColumn("offset", at)
    every = [
        F.struct(
            F.lit(f["length"]).alias("length"), F.lit(f["type"]).alias("type"), F.lit(f["endian"]).alias("endian"),
            literal_number(F.col(payload), F.col("offset"), f["length"], f["type"], f["endian"]).cast("double").alias("found"),
        )
        for f in formats.select("length", "type", "endian").distinct().collect()
    ]
    numbers = F.array(*every).cast("array<struct<length:int,type:string,endian:string,found:double>>")
    return rows.select(*keys, "offset", F.inline(numbers)).where(is_finite(F.col("found")))


def locate_specs(payloads: DataFrame, keys: Sequence[str], payload: str, specs: DataFrame, tolerance: float = 1e-4, hot: int = 1_000_000) -> DataFrame:
    """(keys, name, offset, position, expected, found) for all specs in one pass over the payloads.

    ``specs`` has a row for each expected value: (name, position, value, length, type, endian), position its place in the list.
    Expected values stand in cells one tolerance wide, with both neighbours; decoded values of other cells are dropped at once
    and the rest is written, so payloads are decoded a single time.  Expected values that fit a broadcast meet them where they
    are.  If they do not, a cell that meets over ``hot`` decoded values, as one of a constant prefix does, is split: its values
    are dealt over parts and its expected values copied to each."""
    keys = list(keys)
    own = ["length", "type", "endian"]
    wanted = specs.select("name", "position", F.col("value").cast("double").alias("expected"), *own)
    cell = F.floor(F.col("expected") / tolerance)
    wanted = wanted.withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    place = [*own, "_cell"]
    found = all_offsets(payloads, keys, payload, specs).withColumn("_cell", F.floor(F.col("found") / tolerance))
    near = materialize(found.join(small_side(wanted.select(*place).distinct()), place, "left_semi"))
    if fits(wanted, broadcast_rows(wanted)):
        hits = near.join(F.broadcast(wanted), place)
    else:
        met = near.groupBy(*place).agg(F.count(F.lit(1)).alias("_n"))
        parts = materialize(met.where(F.col("_n") > hot).select(*place, F.ceil(F.col("_n") / hot).cast("int").alias("_parts")))
        # a cell with over ``hot`` values is rare: there are fewer than values / hot of them
        deal = lambda df: df.join(small_side(parts), place, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
        left = deal(near).withColumn("_part", F.pmod(F.xxhash64(*keys, "offset"), F.col("_parts")).cast("int"))
        right = deal(wanted).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        hits = left.drop("_parts").join(small_side(right.drop("_parts")), [*place, "_part"])
    return hits.where(F.abs(F.col("found") - F.col("expected")) < tolerance).select(*keys, "name", "offset", "position", "expected", "found")


def spec_matches(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One match for each payload, spec and offset: the first expected value in the list that fits."""
    first = F.min(F.struct("position", "expected", "found")).alias("_h")
    return hits.groupBy(*keys, "name", "offset").agg(first).select(*keys, "name", "offset", "_h.expected", "_h.found")


def spec_sequences(hits: DataFrame, keys: Sequence[str], specs: DataFrame) -> DataFrame:
    """(keys, name, sequence_start, sequence_end): where all values of a spec follow each other without a gap."""
    sizes = specs.groupBy("name").agg(F.countDistinct("position").alias("_m"), F.first("length").alias("_w"))
    starts = hits.join(small_side(sizes), "name").withColumn("sequence_start", F.col("offset") - F.col("position") * F.col("_w"))
    whole = starts.where(F.col("sequence_start") >= 0).groupBy(*keys, "name", "sequence_start", "_m", "_w").agg(F.countDistinct("position").alias("_c"))
    end = (F.col("sequence_start") + F.col("_m") * F.col("_w") - 1).alias("sequence_end")
    return whole.where(F.col("_c") == F.col("_m")).select(*keys, "name", "sequence_start", end)


def spec_summary(matches: DataFrame, sequences: DataFrame, specs: DataFrame) -> DataFrame:
    """Matches and sequences of every spec."""
    return (
        specs.select("name").distinct()
        .join(matches.groupBy("name").agg(F.count(F.lit(1)).alias("individual_matches")), "name", "left")
        .join(sequences.groupBy("name").agg(F.count(F.lit(1)).alias("sequence_matches")), "name", "left")
        .fillna(0, ["individual_matches", "sequence_matches"])
    )
