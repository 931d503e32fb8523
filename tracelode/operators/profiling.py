"""Column profiles, constraints and cleaning.

A profile starts from value counts per column.  They are combined map-side, so a
value that fills a third of a column is one row per task after the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelode.operators.sweep import changing_in_windows
from tracelode.plans.ordered import Ordered
from tracelode.plans.sizing import small_side

# Ranges of the integer field types.
INT_RANGES = [
    ("UINT8", 0, 255), ("INT8", -128, 127), ("UINT16", 0, 65535), ("INT16", -32768, 32767),
    ("UINT32", 0, 4294967295), ("INT32", -2147483648, 2147483647),
]
IPV4 = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"
MAC = r"^[0-9A-Fa-f]{2}([:-][0-9A-Fa-f]{2}){5}$"


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value text, n, numeric value or null)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text")) for c in columns])
    long = df.select(F.explode(pairs).alias("p")).select("p.*")
    counts = long.groupBy("column", "text").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("number", F.expr("try_cast(text as double)"))


def profile(counts: DataFrame) -> DataFrame:
    """Count, nulls, distinct, extremes, mean, sample deviation, repetition and type."""
    present = counts.where(F.col("text").isNotNull())
    numeric = present.where(F.col("number").isNotNull())
    total, weighted = F.sum("n"), F.sum(F.col("n") * F.col("number"))
    base = counts.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("text").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
        F.count("text").alias("distinct_values"),
        F.max(F.when(F.col("text").isNotNull(), F.col("n"))).alias("most_common"),
        F.count_if((F.col("n") > 1) & F.col("text").isNotNull()).alias("repeated_values"),
        # Pattern tests only matter for texts that are not numbers.
        F.bool_and(F.when(F.col("number").isNull(), F.col("text").rlike(IPV4))).alias("_ip"),
        F.bool_and(F.when(F.col("number").isNull(), F.col("text").rlike(MAC))).alias("_mac"),
        F.sum(F.when(F.col("number").isNull() & F.expr("try_to_timestamp(text)").isNotNull(), F.col("n")).otherwise(0)).alias("_dates"),
    )
    moments = numeric.groupBy("column").agg(
        total.alias("numeric_rows"), F.min("number").alias("min_value"), F.max("number").alias("max_value"),
        (weighted / total).alias("mean_value"), F.bool_and(F.col("number") == F.rint("number")).alias("_whole"),
    )
    spread = numeric.join(F.broadcast(moments), "column").groupBy("column").agg(
        F.sum(F.col("n") * F.pow(F.col("number") - F.col("mean_value"), 2)).alias("_ss")
    )
    out = base.join(F.broadcast(moments), "column", "left").join(F.broadcast(spread), "column", "left")
    filled = F.col("rows") - F.col("nulls")
    # One numeric value is enough for a numeric column, as with coercing parsers.
    kind = (
        F.when((F.col("numeric_rows") > 0) & F.col("_whole"), "int")
        .when(F.col("numeric_rows") > 0, "float")
        .when(F.col("_dates") > filled * 0.5, "timestamp")
        .when(F.coalesce("_ip", F.lit(False)), "ip")
        .when(F.coalesce("_mac", F.lit(False)), "mac")
        .otherwise("string")
    )
    return (
        out.withColumn("data_type", kind)
        .withColumn("std_value", F.sqrt(F.col("_ss") / F.nullif(F.col("numeric_rows") - 1, F.lit(0))))
        .withColumn("repetition_ratio", F.col("most_common") / filled)
        .withColumn("is_constant", F.col("distinct_values") == 1)
        .withColumn("is_enumeration", enumeration(filled, F.col("distinct_values"), F.col("repeated_values")))
        .drop("_ip", "_mac", "_dates", "_whole", "_ss")
    )


def enumeration(total: Column, distinct: Column, repeated: Column, most: int = 10, ratio: float = 0.3, share: float = 0.5) -> Column:
    """Few distinct values, most of them repeated; constants are excluded."""
    return (
        (total >= 3) & (distinct > 1) & (distinct <= most) & (distinct <= total * ratio) & (total > distinct)
        & (repeated >= distinct * share)
    )


def monotonic(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Increasing / decreasing flags: over 80 % one way and over 30 % strictly."""
    rows = Ordered(df.where(F.col(value).isNotNull()), keys, order).with_lag("_p", F.col(value)).frame()
    v, p, steps = F.col(value), F.col("_p"), F.count("_p")

    def share(condition: Column) -> Column:
        return F.count_if(condition) / F.nullif(steps, F.lit(0))

    enough = steps >= 2
    return rows.groupBy(*keys).agg(
        F.coalesce(enough & (share(v >= p) > 0.8) & (share(v > p) > 0.3), F.lit(False)).alias("increasing"),
        F.coalesce(enough & (share(v <= p) > 0.8) & (share(v < p) > 0.3), F.lit(False)).alias("decreasing"),
        (steps + 1).alias("n"),
    )


def field_types(profiles: DataFrame) -> DataFrame:
    """Candidate field types per column (one row each)."""
    low, high = F.col("min_value"), F.col("max_value")
    ints = F.array_compact(
        F.array(
            *[F.when((low >= a) & (high <= b), F.lit(name)) for name, a, b in INT_RANGES], F.lit("UINT64"), F.lit("INT64")
        )
    )
    names = (
        F.when(F.col("data_type") == "int", ints)
        .when(F.col("data_type") == "float", F.array(F.lit("FLOAT32"), F.lit("FLOAT64")))
        .when(F.col("data_type") == "timestamp", F.array(F.lit("TIMESTAMP")))
        .when(F.col("data_type") == "ip", F.array(F.lit("IPV4")))
        .when(F.col("data_type") == "mac", F.array(F.lit("MAC_ADDRESS")))
        .otherwise(F.array(F.lit("ASCII_STRING"), F.lit("UTF8_STRING")))
    )
    return profiles.select("column", F.explode(names).alias("field_type"))


def constraints(profiles: DataFrame, trends: DataFrame | None = None) -> DataFrame:
    """Constraint rows (column, kind, low, high, confidence)."""
    rows = profiles
    if trends is not None:
        rows = rows.join(F.broadcast(trends), "column", "left")
    else:
        rows = rows.withColumn("increasing", F.lit(False)).withColumn("decreasing", F.lit(False))
    numeric = F.col("data_type").isin("int", "float")
    none = F.lit(None).cast("double")
    options = [
        (F.col("is_constant"), "constant", none, none),
        (F.col("is_enumeration"), "enumeration", none, none),
        (F.coalesce("increasing", F.lit(False)), "increasing", none, none),
        (F.coalesce("decreasing", F.lit(False)), "decreasing", none, none),
        (numeric, "range", F.col("min_value"), F.col("max_value")),
    ]
    made = F.array_compact(
        F.array(
            *[
                F.when(test, F.struct(F.lit(kind).alias("kind"), a.alias("low"), b.alias("high"), F.lit(0.85).alias("confidence")))
                for test, kind, a, b in options
            ]
        )
    )
    return rows.select("column", F.explode(made).alias("c")).select("column", "c.*")


def constraint_groups(rows: DataFrame, types: DataFrame) -> DataFrame:
    """Per column: types, constraints and group confidence (0.3 without constraints)."""
    kinds = types.groupBy("column").agg(F.array_sort(F.collect_set("field_type")).alias("field_types"))
    packed = rows.groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("kind", "low", "high", "confidence"))).alias("constraints"), F.max("confidence").alias("c")
    )
    return kinds.join(packed, "column", "left").select(
        "column", "field_types", "constraints", F.coalesce("c", F.lit(0.3)).alias("overall_confidence")
    )


def evaluate_constraints(values: DataFrame, rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """Satisfied share per (field, column): mean confidence plus .05 per extra match
    (at most .2), best column per field.

    ``values``: field profiles (field, distinct_values, min_value, max_value,
    increasing, decreasing); ``allowed``: (field, column, misses) counting field
    values an enumeration or constant column does not have."""
    joined = values.crossJoin(F.broadcast(rows)).join(small_side(allowed), ["field", "column"], "left")
    known = F.coalesce(F.col("misses"), F.lit(0)) == 0
    holds = (
        F.when(F.col("kind") == "range", (F.col("min_value") >= F.col("low")) & (F.col("max_value") <= F.col("high")))
        .when(F.col("kind") == "constant", (F.col("distinct_values") == 1) & known)
        .when(F.col("kind") == "enumeration", (F.col("distinct_values") <= 10) & known)
        .when(F.col("kind") == "increasing", F.col("increasing"))
        .otherwise(F.col("decreasing"))
    )
    scored = joined.withColumn("_ok", F.coalesce(holds, F.lit(False)))
    matched = F.count_if("_ok")
    per = scored.groupBy("field", "column").agg(
        matched.alias("matched"), F.count(F.lit(1)).alias("total"),
        (F.sum(F.when(F.col("_ok"), F.col("confidence")).otherwise(0.0)) / F.count(F.lit(1))).alias("_base"),
    )
    bonus = F.when(F.col("matched") > 1, F.least(F.lit(0.2), (F.col("matched") - 1) * 0.05)).otherwise(0.0)
    scored_columns = per.where(F.col("matched") > 0).withColumn("confidence", F.least(F.lit(1.0), F.col("_base") + bonus))
    best = scored_columns.groupBy("field").agg(F.min(F.struct((-F.col("confidence")).alias("c"), F.col("column").alias("k"))).alias("b"))
    return best.select("field", F.col("b.k").alias("matched_column"), (-F.col("b.c")).alias("confidence"))


def dynamic_columns(profiles: DataFrame, repetition: float = 0.98, excluded: Sequence[str] = ()) -> list[str]:
    """Columns that vary, are numeric and do not repeat one value too often.

    The profile has one row per column, so reading it back is bounded by the schema."""
    filled = F.col("rows") - F.col("nulls")
    keep = profiles.where(
        ~F.col("is_constant") & (F.col("most_common") < F.col("rows") * repetition) & (F.col("numeric_rows") == filled)
    ).where(~F.col("column").isin(list(excluded)))
    return sorted(r["column"] for r in keep.select("column").collect())


def dynamic_in_ranges(df: DataFrame, time: str, columns: Sequence[str], ranges: DataFrame) -> DataFrame:
    """Per column: dynamic in any / in all time ranges (range_id, start, end), any number of them.

    A range without rows does not count."""
    flags = changing_in_windows(df, ranges.select("range_id", "start", "end"), [], time, "start", "end", columns).where("points > 0")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}_changes").alias("d")) for c in columns])
    long = flags.select(F.explode(pairs).alias("p")).select("p.*")
    return long.groupBy("column").agg(F.bool_or("d").alias("dynamic_any"), F.bool_and("d").alias("dynamic_all"))


def fill_majority(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, reach: int = 5) -> DataFrame:
    """Missing values take the majority of the rows around them (ties: first seen),
    else the most common value of the group.

    Only missing rows look around: each lists its neighbour positions and meets
    them through an equality join on (group, position)."""
    keys = list(keys)
    rows = Ordered(df, keys, order).with_row_number("_pos").frame()
    missing = rows.where(F.col(value).isNull()).select(*keys, F.col("_pos").alias("_at"))
    around = F.filter(F.sequence(F.col("_at") - reach, F.col("_at") + reach), lambda p: (p >= 0) & (p != F.col("_at")))
    wanted = missing.withColumn("_pos", F.explode(around))
    known = rows.where(F.col(value).isNotNull()).select(*keys, "_pos", F.col(value).alias("_v"))
    votes = wanted.join(known, [*keys, "_pos"]).groupBy(*keys, "_at", "_v").agg(
        F.count(F.lit(1)).alias("c"), F.min("_pos").alias("f")
    )
    local = votes.groupBy(*keys, "_at").agg(F.max_by("_v", F.struct("c", (-F.col("f")).alias("f"))).alias("_local"))
    counts = known.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("c"), F.min("_pos").alias("f"))
    common = counts.groupBy(*keys).agg(F.max_by("_v", F.struct("c", (-F.col("f")).alias("f"))).alias("_common"))
    filled = rows.join(local.withColumnRenamed("_at", "_pos"), [*keys, "_pos"], "left").join(small_side(common), keys, "left")
    return filled.withColumn(value, F.coalesce(value, "_local", "_common")).drop("_pos", "_local", "_common")


def whole_numbers(df: DataFrame, columns: Sequence[str], eps: float = 1e-6) -> DataFrame:
    """Cast double columns that only hold whole numbers to bigint (one pass to test)."""
    checks = [F.bool_and(F.abs(F.col(c) - F.rint(c)) <= eps).alias(c) for c in columns]
    row = df.agg(*checks).first()
    for c in columns:
        if row[c]:
            df = df.withColumn(c, F.rint(c).cast("long"))
    return df


def preprocess(df: DataFrame, time: str) -> DataFrame:
    """Time to Unix milliseconds, texts kept, missing numbers to 0."""
    out = df.withColumn(time, F.unix_millis(F.col(time).cast("timestamp")))
    for field in df.schema.fields:
        if field.name != time and isinstance(field.dataType, T.NumericType):
            out = out.withColumn(field.name, F.coalesce(F.col(field.name), F.lit(0).cast(field.dataType)))
    return out


def timestamp_like(df: DataFrame, column: str) -> Column:
    """Share of values that parse as a timestamp."""
    return F.avg(F.when(F.try_to_timestamp(F.col(column)).isNotNull(), 1.0).otherwise(0.0))


def column_group(name: Column, dataset: str) -> Column:
    """Group key from a column name by data set naming rules; null when unmatched."""
    if dataset == "swat":
        plc = F.regexp_extract(name, r"^P(\d+)", 1)
        prefix = F.substring_index(name, ".", 1)
        third = F.substring(prefix, -3, 1)
        key = F.when(plc != "", F.substring(plc, 1, 1)).when(
            name.contains(".") & (F.length(prefix) >= 3), third
        )
        return F.when(key.rlike(r"^\d$"), key)
    if dataset == "epic":
        parts = F.split(name, r"\.")
        return F.when((F.size(parts) >= 2) & parts[1].contains("IED"), parts[0])
    if dataset == "wadi":
        return F.nullif(F.regexp_extract(name, r"^(HMI_\d+)(?=$|[_.-])", 1), F.lit(""))
    raise ValueError(f"unknown data set {dataset!r}")
