"""From inferred fields to recovered process values: decoding by a table of field specs, and fields scored against columns.

Specs are rows (keys, field, start, length, type, endian), so one plan decodes any mixture of types.  The specs of one
session meet its payloads as a single array: payloads of a session of any size are neither moved together nor copied.
Series are long tables (keys, name, i, v) of numbers or texts with one row of summary for each; only pairs of series that
pass the gates meet value by value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions.binary import NTP_OFFSET, UNIX_2050, _ieee, cut, decode_text, is_finite
from tracelode.operators import matching, similarity
from tracelode.operators.greedy import greedy_select
from tracelode.plans.ordered import Ordered
from tracelode.plans.sizing import small_side
from tracelode.session import materialize

# Names of the field types by what they hold.
INTEGERS = ["UINT8", "INT8", "UINT16", "INT16", "UINT32", "INT32", "UINT64", "INT64", "TIMESTAMP"]
FLOATS = ["FLOAT32", "FLOAT64"]
TEXTS = ["ASCII_STRING", "UTF8_STRING", "IPV4", "MAC_ADDRESS", "BINARY"]
SPEC = ["field", "start", "length", "type", "endian"]
LEAST_FLOAT = 1e-10  # a float field that stays below is taken as constant
REPETITION = 0.8


def value_class(kind: Column) -> Column:
    """``int``, ``float`` or ``text``."""
    return F.when(kind.isin(INTEGERS), "int").when(kind.isin(FLOATS), "float").otherwise("text")


def typed_number(data: Column, start: Column, length: Column, kind: Column, endian: Column) -> Column:
    """Number of a field whose place, type and byte order are columns; null past the end of the data and for text
    types.  ``n/a`` as byte order means big endian for one byte and little endian otherwise."""
    digits = F.hex(cut(data, start, length))
    little = (endian == "little") | ((endian == "n/a") & (length > 1))
    text = F.when(F.length(digits) == 2 * length, F.when(little, F.regexp_replace(F.reverse(digits), "(.)(.)", "$2$1")).otherwise(digits))

    def parts(t: Column) -> Column:
        high, low = F.conv(F.substring(t, 1, 8), 16, 10).cast("long"), F.conv(F.substring(t, 9, 8), 16, 10).cast("long")
        bits, unsigned = F.conv(t, 16, -10).cast("long"), F.conv(t, 16, 10).cast("decimal(20,0)").cast("double")
        return F.struct(bits.alias("bits"), unsigned.alias("unsigned"), high.alias("high"), low.alias("low"))

    def number(p: Column) -> Column:
        bits, unsigned = p["bits"], p["unsigned"]
        half = F.pow(F.lit(2.0), 8 * length - 1)
        signed = F.when(length >= 8, bits.cast("double")).when(unsigned >= half, unsigned - 2 * half).otherwise(unsigned)
        last = UNIX_2050 * 1000
        fixed = (p["high"] - NTP_OFFSET) * 1000 + F.floor(p["low"] * 1000 / F.lit(float(1 << 32))).cast("long")
        seconds = F.when(unsigned <= UNIX_2050, unsigned * 1000).when(unsigned >= NTP_OFFSET, (unsigned - NTP_OFFSET) * 1000)
        stamp = F.when(unsigned <= UNIX_2050, unsigned * 1000).when(unsigned <= last, unsigned).when((fixed >= 0) & (fixed <= last), fixed.cast("double"))
        return (
            F.when(kind.startswith("UINT"), unsigned)
            .when(kind.startswith("INT"), signed)
            .when(kind == "FLOAT32", F.round(_ieee(bits, 8, 23), 6))
            .when(kind == "FLOAT64", F.round(_ieee(bits, 11, 52), 12))
            .when((kind == "TIMESTAMP") & (length == 4), seconds)
            .when((kind == "TIMESTAMP") & (length == 8), stamp)
        )

    # one-element arrays bind the digits and their integers, which are used many times
    return F.transform(F.transform(F.array(text), parts), number)[0]


def typed_text(data: Column, start: Column, length: Column, kind: Column) -> Column:
    """Text of a field; null for numeric types and past the end of the data."""
    whole = F.length(cut(data, start, length)) == length
    text = F.when(kind == "IPV4", decode_text(data, start, length, "IPV4")).when(kind == "MAC_ADDRESS", decode_text(data, start, length, "MAC_ADDRESS"))
    text = text.when(kind.isin("ASCII_STRING", "UTF8_STRING"), decode_text(data, start, length, "UTF8_STRING"))
    return F.when(whole & ~kind.isin(INTEGERS + FLOATS), text.otherwise(decode_text(data, start, length, "BINARY")))


def with_fields(payloads: DataFrame, specs: DataFrame, keys: Sequence[str], payload: str = "payload") -> DataFrame:
    """``payloads`` and ``fields``, an array of (field, type, number, text) by the specs of the keys; rows without specs go."""
    keys = list(keys)
    own = specs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*SPEC))).alias("_specs"))
    rows = payloads.join(small_side(own), keys)

    def read(s: Column) -> Column:
        number = typed_number(F.col(payload), s["start"], s["length"], s["type"], s["endian"])
        return F.struct(s["field"].alias("field"), s["type"].alias("type"), number.alias("number"), typed_text(F.col(payload), s["start"], s["length"], s["type"]).alias("text"))

    return rows.withColumn("fields", F.transform("_specs", read)).drop("_specs")


def decoded(payloads: DataFrame, specs: DataFrame, keys: Sequence[str], keep: Sequence[str], payload: str = "payload") -> DataFrame:
    """One row for each payload and field: keys, ``keep``, field, type, number, text."""
    rows = with_fields(payloads, specs, keys, payload).select(*keys, *keep, F.explode("fields").alias("_f"))
    return rows.select(*keys, *keep, "_f.field", "_f.type", "_f.number", "_f.text")


def value_table(payloads: DataFrame, specs: DataFrame, keys: Sequence[str], keep: Sequence[str], columns: dict[str, str], payload: str = "payload") -> DataFrame:
    """One row for each payload with a column for each named process value; ``columns`` gives ``number`` or ``text``.

    A payload has the values of its session's specs, others are null; nothing is shuffled to widen the rows."""
    rows = with_fields(payloads, specs, keys, payload)
    values = rows.withColumn("_m", F.map_from_entries(F.transform("fields", lambda f: F.struct(f["field"], f))))
    return values.select(*keys, *keep, *(F.col("_m")[F.lit(name)][kind].alias(name) for name, kind in columns.items()))


def alignment_specs(selected: DataFrame, mapping: DataFrame, solutions: DataFrame, column: str = "column") -> DataFrame:
    """Field specs named by the process column that each field was matched with: (session, field, start, length, type, endian)."""
    rows = matching.field_specs(selected, mapping, solutions)
    return rows.select("group_id", "session", F.col(column).alias("field"), "start", "length", "type", "endian")


def field_series(payloads: DataFrame, specs: DataFrame, keys: Sequence[str], order: Sequence[str], period: int | None = None) -> DataFrame:
    """(keys, name, type, i, v, text): values of every field in order, without nulls and floats that are no number.

    ``period``, in units of the first order column, thins payloads to the rate of the process columns: a payload is kept
    when it comes ``period`` after the last one kept."""
    keys, order = list(keys), list(order)
    if period is not None:
        payloads = greedy_select(payloads, keys, order[0], F.lit(period), order)
    rows = decoded(payloads, specs, keys, order).where(F.coalesce(is_finite(F.col("number")), F.col("text").isNotNull()))
    numbered = Ordered(rows.withColumnRenamed("field", "name"), [*keys, "name"], order).with_row_number("i").frame()
    return numbered.select(*keys, "name", "type", "i", F.col("number").alias("v"), "text")


def series_profiles(series: DataFrame, keys: Sequence[str], kind: Column) -> DataFrame:
    """One row for each series: class, length, range, distinct values and the share of the most common one."""
    keys = [*keys, "name"]
    counted = series.groupBy(*keys, kind.alias("kind"), "v", "text").agg(F.count(F.lit(1)).alias("_c"))
    return counted.groupBy(*keys, "kind").agg(
        F.sum("_c").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("values"), (F.max("_c") / F.sum("_c")).alias("repetition"),
    )


def constant_fields(profiles: DataFrame) -> Column:
    """A field of one value, or a float field that never reaches ``LEAST_FLOAT``."""
    return (F.col("values") == 1) | ((F.col("kind") == "float") & (F.col("high") < LEAST_FLOAT))


def _cell(value: Column) -> Column:
    """Ascending number of the power of two that a value lies in, by sign."""
    return F.when(value == 0, 0).otherwise(F.signum(value) * (F.floor(F.log2(F.abs(value))) + 1_100)).cast("int")


def candidate_pairs(fields: DataFrame, columns: DataFrame, keys: Sequence[str] = (), deviation: float | None = None) -> DataFrame:
    """Pairs (keys, field, column) of series of one class; constant fields take no part.

    With ``deviation`` the range of a numeric field must lie in the column's range, widened by this share of its limits.
    Such pairs meet through cells: a column stands in the powers of two that its range covers, some 4,300 at most, a field
    in the one of its least value, so fields only meet columns that can hold them."""
    keys = list(keys)
    left = fields.where(~constant_fields(fields)).select(*keys, F.col("name").alias("field"), "kind", F.col("low").alias("_fl"), F.col("high").alias("_fh"))
    right = columns.select(*keys, F.col("name").alias("column"), "kind", F.col("low").alias("_cl"), F.col("high").alias("_ch"))
    on = [*keys, "kind"]
    if deviation is None:
        return left.join(right, on).select(*keys, "field", "column", "kind")
    numeric = F.col("kind") != "text"
    right = right.withColumn("_cl", F.col("_cl") * (1 - deviation)).withColumn("_ch", F.col("_ch") * (1 + deviation)).where(~numeric | (F.col("_cl") <= F.col("_ch")))
    right = right.withColumn("_cell", F.explode(F.when(numeric, F.sequence(_cell(F.col("_cl")), _cell(F.col("_ch")))).otherwise(F.array(F.lit(0)))))
    left = left.withColumn("_cell", F.when(numeric, _cell(F.col("_fl"))).otherwise(0))
    inside = ~numeric | ((F.col("_fl") >= F.col("_cl")) & (F.col("_fh") <= F.col("_ch")))
    return left.join(right, [*on, "_cell"]).where(inside).select(*keys, "field", "column", "kind")


def pair_scores(pairs: DataFrame, fields: DataFrame, columns: DataFrame, keys: Sequence[str] = (), weights: dict[str, float] = similarity.WEIGHTS) -> DataFrame:
    """(keys, field, column, kind, score): windowed weighted similarity of numbers, share of present values of texts."""
    keys = list(keys)
    own = [*keys, "field", "column"]
    pairs = materialize(pairs)

    def side(series: DataFrame, name: str) -> DataFrame:
        rows = series.select(*keys, F.col("name").alias(name), F.col("text").alias("v"))
        return rows.join(pairs.where(F.col("kind") == "text").select(*own), [*keys, name]).select(*own, "v")

    wanted = pairs.where(F.col("kind") != "text")
    windows = materialize(similarity.paired_scores(wanted, fields, columns, keys, weights))
    numbers = similarity.column_scores(windows, own).select(*own, "score")
    texts = similarity.presence_ratio(side(fields, "field"), side(columns, "column"), own).withColumnRenamed("presence", "score")
    return pairs.join(numbers.unionByName(texts), own).select(*own, "kind", "score")


def field_report(scores: DataFrame, profiles: DataFrame, keys: Sequence[str], threshold: float, on_block: DataFrame | None = None) -> DataFrame:
    """One row for each field: best column, its score, the similarity after the repetition penalty, and what it is.

    Without ``on_block`` constant fields score 0.  With it, (keys, name) of the fields that lie on the searched block, the others
    score 0 and those on the block are scored whatever they hold.  A field without any scored column keeps the threshold."""
    keys = list(keys)
    fields = profiles.withColumn("is_constant", constant_fields(profiles))
    if on_block is None:
        fields = fields.withColumn("is_intersect", ~F.col("is_constant"))
    else:
        marked = on_block.select(*keys, "name").distinct().withColumn("_on", F.lit(True))
        fields = fields.join(marked, [*keys, "name"], "left").withColumn("is_intersect", F.coalesce("_on", F.lit(False))).drop("_on")
    best = scores.groupBy(*keys, F.col("field").alias("name")).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("column").alias("c"))).alias("_b"))
    rows = fields.join(best, [*keys, "name"], "left")
    scored = F.col("is_intersect") & F.col("_b").isNotNull()
    score = F.when(scored, -F.col("_b.s")).otherwise(0.0)
    matched = score > threshold
    similar = F.greatest(similarity.repetition_penalty(score, F.col("repetition"), threshold, REPETITION), F.lit(threshold))
    return rows.select(
        *keys, F.col("name").alias("field"), F.when(scored, F.col("_b.c")).alias("best_column"), score.alias("best_score"), matched.alias("is_matched"),
        F.when(F.col("is_intersect"), similar).otherwise(0.0).alias("similarity"), "repetition", "is_constant", "is_intersect",
    )


def report_summary(report: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Fields, fields scored, fields matched, average similarity of those scored, coverage of all, and the reward."""
    rows = report.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_fields"), F.count_if("is_intersect").alias("scored_fields"),
        F.count_if(F.col("is_intersect") & (F.col("similarity") > threshold)).alias("matched_fields"),
        F.coalesce(F.avg(F.when(F.col("is_intersect"), F.col("similarity"))), F.lit(0.0)).alias("average_similarity"),
    )
    return rows.withColumn("match_coverage", F.col("matched_fields") / F.col("total_fields")).withColumn("total_reward", F.greatest(F.lit(0.0), F.col("average_similarity")))


def column_side_scores(scores: DataFrame, profiles: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Pair scores as a column sees them: fields lose what their most common value exceeds ``REPETITION`` by."""
    keys = list(keys)
    known = profiles.select(*keys, F.col("name").alias("field"), "repetition")
    rows = scores.join(known, [*keys, "field"])
    return rows.withColumn("score", similarity.repetition_penalty(F.col("score"), F.col("repetition"), threshold, REPETITION)).drop("repetition")


def best_solution_of_sessions(scores: DataFrame, totals: DataFrame, keys: Sequence[str], threshold: float, rewards: DataFrame) -> DataFrame:
    """The best solution of every (group, session): columns claim fields inside each solution, then coverage, average and
    reward are blended.  ``scores`` is (keys, solution, column, field, score), ``totals`` (keys, columns), ``rewards`` (keys,
    solution, reward)."""
    keys = list(keys)
    claimed = matching.column_claims(scores.withColumn("_t", F.lit(threshold)), [*keys, "solution"], "column", "field", "score", "_t")
    return matching.best_solutions(claimed.join(rewards, [*keys, "solution"]), totals, keys, "solution", "score", "reward")


def ranked_fields(scores: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """The ``most`` best fields of every column."""
    w = Window.partitionBy(*keys, "column").orderBy(F.col("score").desc(), F.col("field"))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
