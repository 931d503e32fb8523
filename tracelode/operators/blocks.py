"""Constant and dynamic byte blocks of payload columns.

Every statistic starts from the byte histogram (session, position, byte ->
count).  It is combined map-side to at most 256 rows per position, so a session
holding a third of all payloads costs no more than any other after the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions.binary import bytes_or_empty
from tracelode.plans.ordered import Ordered
from tracelode.plans.sizing import small_side

# Single bytes that commonly separate fields, and printable characters.
DELIMITERS = {0x00: "null_terminator", 0xFF: "padding", 0x20: "space", 0x2C: "comma", 0x3B: "semicolon", 0x0A: "newline", 0x0D: "carriage_return"}
PRINTABLE = [*range(0x09, 0x0E), *range(0x20, 0x7F)]


def byte_histogram(payloads: DataFrame, keys: Sequence[str], payload: str = "payload") -> DataFrame:
    exploded = payloads.select(*keys, F.posexplode(bytes_or_empty(F.col(payload))).alias("pos", "byte"))
    return exploded.groupBy(*keys, "pos", "byte").agg(F.count(F.lit(1)).alias("n"))


def lengths(payloads: DataFrame, keys: Sequence[str], payload: str = "payload") -> DataFrame:
    n = F.length(payload)
    return payloads.groupBy(*keys).agg(F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.count(F.lit(1)).alias("payloads"))


def position_stats(histogram: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per position up to the shortest payload: distinct bytes, entropy, extremes and
    the entropies of the two half-bytes."""
    keys = list(keys)
    inside = histogram.join(small_side(sizes), keys).where(F.col("pos") < F.col("min_len"))
    share = F.col("n") / F.col("payloads")
    out = inside.groupBy(*keys, "pos").agg(
        F.count(F.lit(1)).alias("distinct_bytes"),
        F.sum(-share * F.log2(share)).alias("entropy"),
        F.min("byte").alias("min_byte"),
        F.max("byte").alias("max_byte"),
    )

    def half(name: str, value: Column) -> DataFrame:
        merged = inside.groupBy(*keys, "pos", value.alias("h"), "payloads").agg(F.sum("n").alias("n"))
        part = F.col("n") / F.col("payloads")
        return merged.groupBy(*keys, "pos").agg(F.sum(-part * F.log2(part)).alias(name))

    high = half("high_entropy", F.shiftright("byte", 4))
    low = half("low_entropy", F.col("byte").bitwiseAND(F.lit(15)))
    return out.join(high, [*keys, "pos"]).join(low, [*keys, "pos"])


def _runs(positions: DataFrame, keys: list[str], extra: list[Column]) -> DataFrame:
    """Consecutive positions as blocks; a session has at most ``min_len`` rows here."""
    w = Window.partitionBy(*keys).orderBy("pos")
    islands = positions.withColumn("_run", F.col("pos") - F.row_number().over(w))
    blocks = islands.groupBy(*keys, "_run").agg(F.min("pos").alias("start_position"), F.max("pos").alias("end_position"), *extra)
    order = Window.partitionBy(*keys).orderBy("start_position")
    return (
        blocks.withColumn("block_index", F.row_number().over(order) - 1)
        .withColumn("length", F.col("end_position") - F.col("start_position") + 1)
        .drop("_run")
    )


def constant_blocks(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs of positions with one byte value, with delimiter and text hints."""
    fixed = stats.where(F.col("distinct_bytes") == 1).withColumn("_b", F.struct("pos", F.col("min_byte").alias("b")))
    value = F.transform(F.array_sort(F.collect_list("_b")), lambda e: e["b"])
    blocks = _runs(fixed, list(keys), [value.alias("_bytes")])
    delimiter = F.create_map(*[x for k, v in DELIMITERS.items() for x in (F.lit(k), F.lit(v))])
    single = F.col("length") == 1
    shown = F.size(F.filter("_bytes", lambda b: b.isin(PRINTABLE))) / F.col("length")
    ascii_only = F.forall("_bytes", lambda b: b < 128)
    return (
        blocks.withColumn("constant_hex", F.array_join(F.transform("_bytes", lambda b: F.lpad(F.hex(b), 2, "0")), ""))
        .withColumn("delimiter_type", F.when(single, F.try_element_at(delimiter, F.col("_bytes")[0])))
        .withColumn("likely_string", ascii_only & (shown > 0.8))
        .drop("_bytes")
    )


def dynamic_blocks(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Complement of the constant runs; a payload without constants is one block."""
    return _runs(stats.where(F.col("distinct_bytes") > 1), list(keys), [F.max("entropy").alias("max_entropy")])


def extend_blocks(blocks: DataFrame, sizes: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """Grow each block by up to ``most`` bytes per side; blocks are not merged."""
    joined = blocks.join(small_side(sizes), list(keys))
    head = F.least(F.lit(most), F.col("start_position"))
    tail = F.least(F.lit(most), F.col("min_len") - 1 - F.col("end_position"))
    return (
        joined.withColumn("head_extension", head)
        .withColumn("tail_extension", tail)
        .withColumn("extended_start", F.col("start_position") - F.col("head_extension"))
        .withColumn("extended_end", F.col("end_position") + F.col("tail_extension"))
        .drop("min_len", "max_len", "payloads")
    )


def coalesce_ranges(ranges: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Merge ranges that overlap or touch (block counts are bounded by payload length)."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col(start) <= before + 1, 0).otherwise(1)
    marked = ranges.withColumn("_f", fresh).withColumn("_g", F.sum("_f").over(w))
    return marked.groupBy(*keys, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def static_gaps(blocks: DataFrame, sizes: DataFrame, keys: Sequence[str], start: str = "extended_start", end: str = "extended_end") -> DataFrame:
    """Spans no block covers, in front of, between and after the blocks."""
    keys = list(keys)
    covered = coalesce_ranges(blocks, keys, start, end)
    w = Window.partitionBy(*keys).orderBy(start)
    after = F.coalesce(F.lag(end).over(w) + 1, F.lit(0))
    inner = covered.select(*keys, after.alias("start_position"), (F.col(start) - 1).alias("end_position"))
    ends = covered.groupBy(*keys).agg((F.max(end) + 1).alias("start_position")).join(small_side(sizes), keys)
    last = ends.select(*keys, "start_position", (F.col("min_len") - 1).alias("end_position"))
    bare = sizes.join(covered.select(*keys).distinct(), keys, "left_anti").select(
        *keys, F.lit(0).alias("start_position"), (F.col("min_len") - 1).alias("end_position")
    )
    gaps = inner.unionByName(last).unionByName(bare).where(F.col("start_position") <= F.col("end_position"))
    order = Window.partitionBy(*keys).orderBy("start_position")
    return gaps.withColumn("block_index", F.row_number().over(order) - 1).withColumn(
        "length", F.col("end_position") - F.col("start_position") + 1
    )


def split_blocks(blocks: DataFrame, keys: Sequence[str], most: int, limit: int) -> DataFrame:
    """Cut extended blocks longer than ``limit`` into overlapping pieces.

    Pieces are ``2 * most + 8`` long and overlap by ``most``; a short remainder joins
    the piece before it.  The number of pieces follows from the length, so they are
    generated and no loop is needed."""
    size = F.col("extended_end") - F.col("extended_start") + 1
    piece = 2 * most + 8
    step = piece - most
    merge_below = limit - piece + most + 1
    full = F.ceil(F.greatest(size - piece, F.lit(0)) / step).cast("int")
    rest = size - full * step
    pieces = F.when((full > 0) & (rest < piece) & (rest < merge_below), full).otherwise(full + 1)
    long = size > limit
    numbered = blocks.withColumn("_n", F.when(long, pieces).otherwise(1)).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    begin = F.when(long, F.col("piece") * step).otherwise(0)
    final = F.when(F.col("piece") == F.col("_n") - 1, size - 1).otherwise(begin + piece - 1)
    cutout = numbered.withColumn("_a", F.col("extended_start") + begin).withColumn("_z", F.col("extended_start") + final)
    initial_start = F.greatest("_a", "start_position")
    initial_end = F.least("_z", "end_position")
    touches = initial_start <= initial_end
    return cutout.select(
        *keys,
        "block_index",
        "piece",
        F.col("_a").alias("extended_start"),
        F.col("_z").alias("extended_end"),
        F.when(touches, initial_start).otherwise(F.col("_a")).alias("initial_start"),
        F.when(touches, initial_end).otherwise(F.col("_a")).alias("initial_end"),
        F.when(touches, initial_end - initial_start + 1).otherwise(0).alias("initial_length"),
    )


def split_static(gaps: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """Cut static spans longer than ``2 * most`` into ``most``-byte pieces, the
    remainder stays with up to ``2 * most`` bytes."""
    n = F.ceil(F.greatest(F.col("length") - 2 * most, F.lit(0)) / most).cast("int")
    rows = gaps.withColumn("_n", n).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    begin = F.col("start_position") + F.col("piece") * most
    end = F.when(F.col("piece") == F.col("_n"), F.col("end_position")).otherwise(begin + most - 1)
    return rows.select(*keys, "block_index", "piece", begin.alias("start_position"), end.alias("end_position"))


def coverage_check(ranges: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Overlap (error) and gap (warning) between neighbouring ranges."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    following = F.lead(start).over(w)
    state = F.when(following <= F.col(end), "overlap").when(following > F.col(end) + 1, "gap").otherwise("ok")
    return ranges.withColumn("coverage", F.when(following.isNull(), "last").otherwise(state))


def intersecting(fields: DataFrame, blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fields that share a byte with a block.

    A field meets a block when, of the blocks that start at its end or before, the one that reaches furthest reaches its start:
    a running maximum over both in order, one row each whatever their length."""
    keys = list(keys)
    whole = lambda df, *columns: df.where(F.expr(" and ".join(f"`{c}` is not null" for c in [*keys, *columns])))
    body = F.struct(*[F.col(c) for c in fields.columns])
    ends = whole(fields, "start_pos", "end_pos").select(*keys, F.col("end_pos").cast("long").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_reach"), body.alias("_f"))
    starts = whole(blocks, "start_position", "end_position").select(*keys, F.col("start_position").cast("long").alias("_at"), F.lit(0).alias("_side"), F.col("end_position").cast("long").alias("_reach"))
    scan = Ordered(ends.unionByName(starts, allowMissingColumns=True), keys, ["_at", "_side"]).with_cummax("_far", F.col("_reach")).frame()
    return scan.where((F.col("_side") == 1) & (F.col("_far") >= F.col("_f.start_pos"))).select("_f.*")


def cumulative_split(df: DataFrame, time: str, span: int) -> DataFrame:
    """Growing prefixes: segment k holds all rows before ``t0 + (k + 1) * span``.

    Only (first segment, row) is kept: a row belongs to that segment and all later
    ones, so the copies are never materialized unless asked for."""
    start = df.agg(F.min(time).alias("_t0"))
    return df.crossJoin(F.broadcast(start)).withColumn(
        "first_segment", F.floor((F.col(time) - F.col("_t0")) / span)
    ).drop("_t0")


def cumulative_totals(df: DataFrame, time: str, span: int, value: Column, name: str) -> DataFrame:
    """Totals per growing prefix from per-segment sums and a running sum."""
    split = cumulative_split(df, time, span)
    per = split.groupBy("first_segment").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_v"))
    last = per.agg(F.max("first_segment").alias("_m"))
    every = last.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m"))).alias("first_segment"))
    dense = every.join(per, "first_segment", "left").fillna({"_n": 0})
    scan = Ordered(dense, [], ["first_segment"]).with_cumsum("rows", F.col("_n")).with_cumsum(name, F.coalesce("_v", F.lit(0)))
    return scan.frame().select(F.col("first_segment").alias("segment"), "rows", name)


def combine_sessions(payloads: DataFrame, key: str, pattern: str, capture: str) -> DataFrame:
    """Keep sessions whose pattern is the same, and present, in all their captures."""
    check = payloads.groupBy(key).agg(
        F.countDistinct(pattern).alias("_p"), F.count_if(F.col(pattern).isNull()).alias("_missing"), F.countDistinct(capture).alias("captures")
    )
    good = check.where((F.col("_p") == 1) & (F.col("_missing") == 0)).select(key, "captures")
    return payloads.join(small_side(good), key)
