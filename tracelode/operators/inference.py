"""Field type inference over byte columns.

Every statistic a heuristic needs is an aggregate over (session, start): the value of
a slice and of the same slice in the previous payload sit in one row, so ordered
measures need no window per slice.  Equal rows are counted once for each length, before
any type reads them: payloads are cut once, and types read distinct slices with their
counts.  Byte entropies come from the byte histogram."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions import binary
from tracelode.operators import blocks
from tracelode.plans.ordered import Ordered
from tracelode.plans.quantiles import quantiles
from tracelode.plans.sizing import small_side
from tracelode.session import materialize

# Fixed values: (share, low, high, bonus) bands per integer type, base, else and out-of-range terms.
INT_BANDS = {
    "UINT8": (0.3, [(0.7, 0, 15, 0.4), (0.8, 0, 63, 0.3)], 0.2),
    "INT8": (0.3, [(0.7, -8, 7, 0.4), (0.8, -32, 31, 0.3)], 0.2),
    "UINT16": (0.2, [(0.7, 0, 255, 0.3), (0.8, 0, 4095, 0.2)], 0.1),
    "INT16": (0.2, [(0.7, -128, 127, 0.3), (0.8, -2048, 2047, 0.2)], 0.1),
    "UINT32": (0.2, [(0.6, 0, 0xFF, 0.3), (0.8, 0, 0xFFFF, 0.2), (0.95, 0, 0xFFFFFF, 0.1)], -0.2),
    "INT32": (0.2, [(0.6, -128, 127, 0.3), (0.8, -32768, 32767, 0.2), (0.95, -8388608, 8388607, 0.1)], -0.2),
    "UINT64": (0.2, [(0.6, 0, 0xFFFF, 0.3), (0.8, 0, 0xFFFFFF, 0.2), (0.95, 0, 0xFFFFFFFF, 0.1)], -0.2),
    "INT64": (0.2, [(0.6, -32768, 32767, 0.3), (0.8, -8388608, 8388607, 0.2), (0.95, -2147483648, 2147483647, 0.1)], -0.2),
}
# Order of the field types for ties, strings' length factors.
TYPE_ORDER = ["UINT8", "UINT16", "UINT32", "UINT64", "INT8", "INT16", "INT32", "INT64", "FLOAT32", "FLOAT64", "ASCII_STRING", "UTF8_STRING", "BINARY_DATA", "IPV4", "MAC_ADDRESS", "TIMESTAMP"]
LENGTH_FACTORS = {1: 0.55, 2: 0.65, 3: 0.75, 4: 0.85, 5: 0.95}
FIXED_CONFIDENCE = 0.4
COMPARED = (2, 4, 8)
COLUMNS = ["start", "length", "field_type", "endian", "heuristic", "is_dynamic"]


def _step(value: Column, steps: Sequence[tuple[float, float]], otherwise: float) -> Column:
    out = None
    for limit, bonus in steps:
        out = F.when(value >= limit, bonus) if out is None else out.when(value >= limit, bonus)
    return out.otherwise(otherwise)


def _clip(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def _slices(base: DataFrame, keys: list[str], length: int) -> DataFrame:
    """(keys, start, b, p, c): distinct slices with the slice before, for the lengths whose types compare them, and their counts."""
    last = F.col("min_len") - length
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    rows = base.select(*keys, "payload", "prev", F.explode(starts).alias("start"))
    before = binary.cut(F.col("prev"), F.col("start"), length) if length in COMPARED else F.lit(None).cast("binary")
    rows = rows.select(*keys, "start", binary.cut(F.col("payload"), F.col("start"), length).alias("b"), before.alias("p"))
    return materialize(rows.groupBy(*keys, "start", "b", "p").agg(F.count(F.lit(1)).alias("c")))


def _times(condition: Column) -> Column:
    """How many rows fulfil the condition."""
    return F.sum(F.when(condition, F.col("c")).otherwise(0))


def _int_candidates(rows: DataFrame, entropies: DataFrame, keys: list[str], length: int, endian: str) -> DataFrame:
    """Unsigned and signed candidates of one width and byte order."""
    kinds = [(f"UINT{8 * length}", binary.uint), (f"INT{8 * length}", binary.sint)]
    parts = []
    for kind, read in kinds:
        base, bands, rest = INT_BANDS[kind]
        v = read(F.col("b"), 0, length, endian).cast("double")
        p = read(F.col("p"), 0, length, endian).cast("double")
        valued = rows.select(*keys, "start", "c", v.alias("v"), (v - p).alias("d"))
        stats = valued.groupBy(*keys, "start").agg(
            F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), *[_times(F.col("v").between(a, b)).alias(f"b{i}") for i, (_, a, b, _) in enumerate(bands)],
        ).join(entropies, keys)
        share = None
        for i, (limit, _, _, bonus) in enumerate(bands):
            hit = F.col(f"b{i}") >= F.col("n") * limit
            share = F.when(hit, bonus) if share is None else share.when(hit, bonus)
        conf = F.lit(base) + share.otherwise(rest)
        if length == 1:
            gap = F.get("e", F.col("start"))["low"] - F.get("e", F.col("start"))["high"]
            nibble = F.when(gap > 1.0, 0.3).when(gap > 0.6, 0.2).when(gap > 0.3, 0.1).when(gap < -0.3, -0.2).otherwise(0.0)
            conf = conf + F.when(F.col("n") >= 5, nibble).otherwise(0.0)
            out = stats.withColumn("heuristic", _clip(conf))
        else:
            middle = quantiles(valued, [*keys, "start"], "v", {"q1": 0.25, "q3": 0.75}, F.col("c"))
            moved = valued.where(F.col("d").isNotNull())
            mean = moved.groupBy(*keys, "start").agg((F.sum(F.col("d") * F.col("c")) / F.sum("c")).alias("m"))
            spread = moved.join(mean, [*keys, "start"]).groupBy(*keys, "start").agg(F.sqrt(F.sum(F.pow(F.col("d") - F.col("m"), 2) * F.col("c")) / F.sum("c")).alias("dd"))
            stats = stats.join(middle, [*keys, "start"]).join(spread, [*keys, "start"], "left")
            width = F.col("hi") - F.col("lo")
            score = F.try_divide(F.col("q3") - F.col("q1"), width) / (1 + F.try_divide(F.col("dd"), width))
            spread = F.when(F.col("n") < 3, 0.0).when(width == 0, 0.1).otherwise(_step(score, [(0.6, 0.2), (0.4, 0.1), (0.2, -0.05)], -0.2))
            order = range(length) if endian == "little" else range(length - 1, -1, -1)
            e = [F.get("e", F.col("start") + i)["all"] for i in order]
            falls = sum((F.when(a > b, 1.0).when(a == b, 0.5).otherwise(-1.0) for a, b in zip(e, e[1:])), F.lit(0.0)) / (length - 1)
            bonus = F.when(F.col("n") < 3, 0.0).when(falls >= 0.8, 0.3).when(falls >= 0.5, 0.15).when(falls < 0, -0.15)
            # A share in [0, .5) has no bonus defined and voids the heuristic.
            out = stats.withColumn("heuristic", F.when(bonus.isNull(), 0.0).otherwise(_clip(conf + bonus + spread)))
        tagged = out.withColumn("field_type", F.lit(kind)).withColumn("is_dynamic", F.col("lo") != F.col("hi"))
        parts.append(tagged.select(*keys, "start", "field_type", "heuristic", "is_dynamic"))
    return parts[0].unionByName(parts[1])


def _float_candidates(rows: DataFrame, keys: list[str], length: int, endian: str) -> DataFrame:
    data, at = F.col("b"), 0
    if length == 4:
        bits, value, eb, fb, small, large = binary.uint(data, at, 4, endian), binary.float32(data, at, endian), 8, 23, 1e-6, 1e6
        best, fair = (0.42, 0.55), (0.35, 0.65)
    else:
        bits, value, eb, fb, small, large = binary.sint(data, at, 8, endian), binary.float64(data, at, endian), 11, 52, 1e-8, 1e8
        best, fair = (0.40, 0.56), (0.35, 0.65)
    valued = rows.select(*keys, "start", "c", bits.alias("bits"), value.alias("v"))
    fraction = F.col("bits").bitwiseAND(F.lit((1 << fb) - 1))
    size = F.abs(F.col("v"))
    c = F.col("c")
    stats = valued.groupBy(*keys, "start").agg(
        F.sum(c).alias("n"), F.bool_and(binary.is_finite(F.col("v"))).alias("ok"), (F.sum(F.bit_count(fraction) * c) / fb).alias("sig"),
        F.greatest(*[F.sum(F.shiftrightunsigned("bits", fb + k).bitwiseAND(F.lit(1)) * c) for k in range(eb)]).alias("top"),
        F.bit_and(fraction).alias("ba"), F.bit_or(fraction).alias("bo"), _times(((size > 0) & (size < small)) | (size > large)).alias("extreme"),
        _times(((size >= small) & (size <= large)) | (size == 0)).alias("usual"), _times(F.col("v") != F.floor("v")).alias("frac"),
        F.min("bits").alias("lo"), F.max("bits").alias("hi"),
    )
    ratio = F.col("sig") / F.greatest(F.col("top"), F.lit(1))
    shape = F.when(ratio.between(*best), 0.3).when(ratio.between(*fair), 0.2).otherwise(0.0)
    constant = fb - F.bit_count(F.col("ba").bitwiseXOR(F.col("bo")))
    start = 0.2 + shape
    striped = F.when(constant / fb > 0.4, F.greatest(start - 0.2, F.lit(0.0))).otherwise(start)
    n = F.col("n")
    odd = F.when(F.col("extreme") >= n * 0.8, -0.4).when(F.col("extreme") >= n * 0.4, -0.2).otherwise(0.0)
    fractional = F.when(F.col("frac") >= n * 0.9, 0.25).when(F.col("frac") >= n * 0.7, 0.15).otherwise(0.0)
    usual = F.when(F.col("usual") >= n * 0.9, 0.25).when(F.col("usual") >= n * 0.7, 0.15).otherwise(0.0)
    conf = F.when(n < 2, 0.0).otherwise(_clip(striped + odd + fractional + usual))
    return stats.where("ok").select(
        *keys, "start", F.lit(f"FLOAT{8 * length}").alias("field_type"), conf.alias("heuristic"), (F.col("lo") != F.col("hi")).alias("is_dynamic")
    )


def _time_candidates(rows: DataFrame, keys: list[str], length: int, endian: str) -> DataFrame:
    v = binary.unix_millis(F.col("b"), 0, length, endian)
    p = binary.unix_millis(F.col("p"), 0, length, endian)
    valued = rows.select(*keys, "start", "c", v.alias("v"), p.alias("p"))
    d = F.col("v") - F.col("p")
    stats = valued.groupBy(*keys, "start").agg(
        F.sum("c").alias("n"), _times(F.col("v").isNotNull()).alias("good"), F.min("v").alias("lo"), F.max("v").alias("hi"), _times(d >= 0).alias("up"),
        _times(d > 0).alias("rise"), (F.sum(F.when(d > 0, d.cast("double") * F.col("c"))) / F.sum(F.when(d > 0, F.col("c")))).alias("gap"),
    )
    steps = F.greatest(F.col("n") - 1, F.lit(1))
    up, rise = F.col("up") / steps, F.col("rise") / steps
    long_run = F.when((up > 0.98) & (rise > 0.98), 0.4).when((up > 0.98) & (rise > 0.8), 0.3).when((up > 0.98) & (rise > 0.6), 0.2)
    long_run = long_run.when((up > 0.8) & (rise > 0.5), 0.1).otherwise(-0.4)
    trend = F.when(F.col("n") >= 3, long_run).otherwise(F.when(F.col("rise") == F.col("n") - 1, 0.2).otherwise(-0.4))
    # 1990, 2010, 2030 and 2050 in Unix seconds.
    y1990, y2010, y2030, y2050 = 631152000, 1262304000, 1893456000, 2524608000
    lo, hi = F.col("lo"), F.col("hi")
    band, gap_bonus = None, F.lit(0.0)
    for unit in (1, 1000):
        for a, b, bonus in ((y2010, y2030, 0.3), (y1990, y2030, 0.2), (y1990, y2050, 0.1)):
            inside = (lo >= a * unit) & (hi <= b * unit)
            band = F.when(inside, bonus) if band is None else band.when(inside, bonus)
        modern = (lo >= y2010 * unit) & (hi <= y2030 * unit)
        g = F.col("gap") / unit
        timed = F.when(g * unit < 1, -0.2).when(g <= 60, 0.3).when(g <= 3600, 0.2).when(g <= 86400, 0.1).otherwise(-0.2)
        gap_bonus = F.when(modern & (F.col("n") > 3) & F.col("gap").isNotNull(), timed).otherwise(gap_bonus)
    conf = _clip(trend + band.otherwise(-0.2) + gap_bonus)
    return stats.where(F.col("good") == F.col("n")).select(
        *keys, "start", F.lit("TIMESTAMP").alias("field_type"), conf.alias("heuristic"), (lo != hi).alias("is_dynamic")
    )


def _plain_candidates(rows: DataFrame, keys: list[str], length: int) -> DataFrame:
    """Strings, addresses and raw bytes: they have no byte order."""
    if length in COMPARED:
        rows = rows.groupBy(*keys, "start", "b").agg(F.sum("c").alias("c"))
    valued = rows.select(*keys, "start", "b", "c", F.try_validate_utf8(F.col("b").cast("string")).alias("t"))
    c = F.col("c")

    def kept(pattern: str) -> Column:
        return F.sum(F.length(F.regexp_replace("t", pattern, "")) * c)

    stats = valued.groupBy(*keys, "start").agg(
        F.sum(c).alias("n"), _times(F.col("t").isNotNull()).alias("valid"), F.coalesce(F.bool_and(binary.is_protocol_string(F.col("t"))), F.lit(False)).alias("fine"),
        _times(F.col("t").rlike(r"^\p{ASCII}*$")).alias("ascii"), F.sum(F.length("t") * c).alias("chars"),
        kept(r"[^A-Za-z0-9 .,!?;:()\[\]{}\"'\-_]").alias("common_ascii"), kept(r"[^\p{L}\p{N}.,!?;:()\[\]{}\"'\-_]").alias("common_utf8"),
        _times(~F.col("t").rlike(r"[\p{C}\p{Zl}\p{Zp}[\p{Zs}&&[^ ]]]")).alias("printable"), F.min("b").alias("lo"), F.max("b").alias("hi"),
    )
    dynamic = F.col("lo") != F.col("hi")
    factor = LENGTH_FACTORS.get(length, 1.0)
    usable = (F.col("valid") == F.col("n")) & F.col("fine")
    common = F.col("common_ascii") / F.col("chars")
    # All values are valid here (+.4), and the control test always passes (+.2).
    ascii_conf = _clip((0.6 + _step(common, [(0.9, 0.4), (0.8, 0.3), (0.7, 0.2), (0.6, 0.1)], -0.3)) * factor)
    wide = F.col("common_utf8") / F.col("chars")
    shown = F.col("printable") / F.col("n")
    utf8 = 0.5 + _step(shown, [(0.9, 0.2), (0.8, 0.15), (0.7, 0.1), (0.6, 0.05)], -0.15) + _step(wide, [(0.9, 0.3), (0.8, 0.2), (0.7, 0.1), (0.6, 0.05)], -0.3)
    utf8 = _clip(utf8 * F.when(F.col("ascii") / F.col("n") > 0.95, 0.9).otherwise(1.0) * factor)
    options = [
        F.when(usable & (F.col("ascii") == F.col("n")), F.struct(F.lit("ASCII_STRING").alias("field_type"), ascii_conf.alias("heuristic"))),
        F.when(usable, F.struct(F.lit("UTF8_STRING").alias("field_type"), utf8.alias("heuristic"))),
        F.struct(F.lit("BINARY_DATA").alias("field_type"), F.lit(FIXED_CONFIDENCE).alias("heuristic")),
    ]
    for name, size in (("IPV4", 4), ("MAC_ADDRESS", 6)):
        if length == size:
            options.append(F.struct(F.lit(name).alias("field_type"), F.lit(FIXED_CONFIDENCE).alias("heuristic")))
    made = F.explode(F.array_compact(F.array(*options)))
    return stats.select(*keys, "start", dynamic.alias("is_dynamic"), made.alias("c")).select(*keys, "start", "c.*", "is_dynamic")


def candidates(payloads: DataFrame, keys: Sequence[str], seq: str, lengths: Sequence[int] = range(1, 9)) -> DataFrame:
    """Scored candidates (keys, start, length, field_type, endian, confidence, is_dynamic)."""
    keys = list(keys)
    sizes = blocks.lengths(payloads, keys)
    stats = blocks.position_stats(blocks.byte_histogram(payloads, keys), sizes, keys)
    entry = F.struct("pos", F.round("entropy", 12).alias("all"), F.col("low_entropy").alias("low"), F.col("high_entropy").alias("high"))
    table = stats.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("entropies"))
    entropies = materialize(table.withColumnRenamed("entropies", "e"))
    info = sizes.select(*keys, "min_len")
    ordered = Ordered(payloads.select(*keys, seq, "payload"), keys, [seq]).with_lag("prev", F.col("payload"))
    base = materialize(ordered.frame().join(small_side(info), keys))
    small_entropies = small_side(entropies)
    parts = []
    for length in lengths:
        rows = _slices(base, keys, length)
        found = [(_plain_candidates(rows, keys, length), "n/a")]
        if length == 1:
            found.append((_int_candidates(rows, small_entropies, keys, 1, "big"), "n/a"))
        elif length in COMPARED:
            for endian in ("big", "little"):
                found.append((_int_candidates(rows, small_entropies, keys, length, endian), endian))
                if length > 2:
                    found.append((_float_candidates(rows, keys, length, endian), endian))
                    found.append((_time_candidates(rows, keys, length, endian), endian))
        typed = [frame.withColumns({"length": F.lit(length), "endian": F.lit(endian)}).select(*keys, *COLUMNS) for frame, endian in found]
        # Written by length: a task holds the sorters of all parts of a union until it ends.
        parts.append(materialize(reduce(DataFrame.unionByName, typed)))
    out = reduce(DataFrame.unionByName, parts)
    raw = F.col("field_type").isin("BINARY_DATA", "MAC_ADDRESS", "IPV4")
    # The dynamic flag only counts when the heuristic found something.
    moving = F.col("is_dynamic") & (F.col("heuristic") > 0)
    size = F.col("length").cast("double")
    penalty = F.when(raw & moving, -0.15 * F.sqrt(size / 8)).when(~raw & ~moving, -0.15 / F.sqrt(size)).otherwise(0.0)
    conf = F.least(F.lit(1.0), 0.35 + 0.65 * F.col("heuristic") + penalty)
    return out.withColumn("confidence", F.round(conf, 9)).drop("heuristic")


def best_types(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best candidate per (start, length) for either byte order: highest confidence, then
    unsigned before signed before others."""
    order = F.create_map(*[x for i, t in enumerate(TYPE_ORDER) for x in (F.lit(t), F.lit(i))])
    priority = F.when(F.col("field_type").startswith("UINT"), 0).when(F.col("field_type").startswith("INT"), 1).otherwise(2)
    either = F.when(F.col("endian") == "n/a", F.array(F.lit("big"), F.lit("little"))).otherwise(F.array("endian"))
    rows = scored.withColumn("run", F.explode(either))
    rank = F.struct((-F.col("confidence")).alias("c"), priority.alias("p"), F.try_element_at(order, F.col("field_type")).alias("o"))
    body = F.struct("field_type", "endian", "confidence", "is_dynamic")
    return rows.groupBy(*keys, "run", "start", "length").agg(F.min_by(body, rank).alias("b")).select(*keys, "run", "start", "length", "b.*")


def text_scores(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """String-likeness of a text column: acceptable characters and ASCII share."""
    t = F.col(text)
    common = F.length(F.regexp_replace(t, r"[^A-Za-z0-9 .,!?;:()\[\]{}\"'\-_]+", ""))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(t.rlike(r"^\p{ASCII}*$")).alias("ascii_values"), F.sum(F.length(t)).alias("chars"),
        F.sum(common).alias("common_chars"), F.count_if(binary.is_protocol_string(t)).alias("protocol_strings"),
    )


