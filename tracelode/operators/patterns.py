"""N-gram candidates, greedy occurrence counting and pattern tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.operators.greedy import greedy_select
from tracelode.plans.ordered import Ordered, ahead
from tracelode.plans.sizing import small_side
from tracelode.session import materialize

SEPARATOR = ","


def numbered_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> Ordered:
    """Dense 0-based position of every row in its session, with the measured size."""
    return Ordered(df, keys, order).with_row_number("pos")


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return numbered_rows(df, keys, order).frame()


def ngrams(numbered: DataFrame, keys: Sequence[str], tokens: str, sizes: Sequence[int], prefix: str = "") -> DataFrame:
    """(keys, pos, size, gram) for every complete window of the given sizes that starts with ``prefix``.

    Every window of a position is a start of its longest one, so positions are left out before windows are written."""
    reach = max(sizes)
    rows = ahead(numbered, keys, "pos", reach, {"_next": F.col(tokens)})
    if prefix:
        rows = rows.where(F.array_join("_next", SEPARATOR).startswith(prefix))
    grams = F.explode(
        F.transform(F.array(*[F.lit(s) for s in sizes]), lambda s: F.struct(s.alias("size"), F.slice("_next", F.lit(1), s).alias("gram")))
    )
    spread = rows.select(*keys, "pos", grams.alias("g"))
    complete = F.size("g.gram") == F.col("g.size")
    grams = spread.where(complete).select(
        *keys, "pos", F.col("g.size").cast("int").alias("size"), F.array_join("g.gram", SEPARATOR).alias("gram")
    )
    return grams.where(F.col("gram").startswith(prefix)) if prefix else grams


def session_lengths(numbered: DataFrame, keys: Sequence[str]) -> DataFrame:
    return numbered.groupBy(*keys).agg((F.max("pos") + 1).alias("n"))


def candidates(grams: DataFrame, lengths: DataFrame, keys: Sequence[str], share: float, prefix: str) -> DataFrame:
    """Distinct grams that start inside the leading ``share`` of a session."""
    lead = grams.where(F.col("gram").startswith(prefix)).join(small_side(lengths), list(keys))
    head = lead.where(F.col("pos") < F.floor(F.col("n") * share))
    return head.groupBy(*keys, "size", "gram").agg(F.min("pos").alias("start_pos"))


def greedy_rates(
    grams: DataFrame, picked: DataFrame, lengths: DataFrame, keys: Sequence[str], bound: int | None = None
) -> DataFrame:
    """Non-overlapping matches of each candidate and its rate.

    The rate divides by the positions a left-to-right scan visits: every start
    position less those jumped over inside a match."""
    hits = grams.join(picked.select(*keys, "size", "gram", "start_pos"), [*keys, "size", "gram"])
    kept = greedy_select(hits, [*keys, "size", "gram"], "pos", F.col("size"), bound=bound)
    counted = kept.groupBy(*keys, "size", "gram").agg(
        F.count(F.lit(1)).alias("matches"), F.max("pos").alias("last_pos"), F.min("start_pos").alias("start_pos")
    )
    starts = F.col("n") - F.col("size") + 1
    jump = F.col("size") - 1
    visited = starts - (F.col("matches") - 1) * jump - F.least(jump, F.col("n") - F.col("size") - F.col("last_pos"))
    return (
        counted.join(small_side(lengths), list(keys))
        .withColumn("visited", visited)
        .withColumn("rate", F.col("matches") / F.col("visited"))
    )


def frequent_patterns(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    tokens: str,
    sizes: Sequence[int],
    share: float = 0.2,
    prefix: str = "S",
    min_rate: float = 0.0,
) -> DataFrame:
    rows = numbered_rows(df, keys, order)
    numbered = rows.frame()
    lengths = session_lengths(numbered, keys)
    grams = ngrams(numbered, keys, tokens, sizes, prefix)
    picked = candidates(grams, lengths, keys, share, prefix)
    return greedy_rates(grams, picked, lengths, keys, rows.largest).where(F.col("rate") >= min_rate)


def contains_sequence(long: Column, short: Column) -> Column:
    """Contiguous token containment on separator-joined strings."""
    edge = F.lit(SEPARATOR)
    return F.concat(edge, long, edge).contains(F.concat(edge, short, edge))


def maximal_patterns(patterns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop patterns contained in a longer one of the same session.

    Containment is transitive, so being inside a *kept* longer pattern is the same as being inside any longer one.  A pattern
    inside a longer one is the start of one of its ends: every pattern lists its own ends, and among all ends of a session in
    the order of their bytes those that start with a pattern follow it at once.  Tokens hold no separator."""
    patterns = materialize(patterns)
    parts = F.split("gram", SEPARATOR)
    ends = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda s: F.struct(F.array_join(F.slice(parts, s, F.size(parts)), SEPARATOR).alias("gram"), (s > 1).alias("inner")),
    )
    listed = patterns.select(*keys, F.inline(ends)).groupBy(*keys, "gram").agg(F.bool_or("inner").alias("inner"))
    listed = listed.withColumn("_at", F.concat("gram", F.lit(SEPARATOR)))
    scan = Ordered(listed, keys, ["_at"]).with_lead("_next", F.col("_at")).frame()
    covered = scan.where(F.col("inner") | F.coalesce(F.col("_next").startswith(F.col("_at")), F.lit(False)))
    return patterns.join(covered.select(*keys, "gram"), [*keys, "gram"], "left_anti")


def occurrences(df: DataFrame, keys: Sequence[str], order: Sequence[str], tokens: str, pattern: Sequence[str]) -> DataFrame:
    """Greedy non-overlapping start positions of one pattern."""
    rows = numbered_rows(df, keys, order)
    grams = ngrams(rows.frame(), keys, tokens, [len(pattern)])
    hits = grams.where(F.col("gram") == SEPARATOR.join(pattern))
    return greedy_select(hits, list(keys), "pos", F.lit(len(pattern)), bound=rows.largest).select(*keys, "pos")


def pattern_members(df: DataFrame, keys: Sequence[str], order: Sequence[str], tokens: str, pattern: Sequence[str]) -> DataFrame:
    """Rows covered by the occurrences: each start lists the positions it covers."""
    starts = occurrences(df, keys, order, tokens, pattern)
    covered = starts.select(
        *keys, F.col("pos").alias("start_pos"), F.explode(F.sequence(F.col("pos"), F.col("pos") + len(pattern) - 1)).alias("pos")
    )
    return positions(df, keys, order).join(covered, [*keys, "pos"])


def split_by_pattern(members: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Coverage and spacing of pattern occurrences per session."""
    starts = members.groupBy(*keys, "start_pos").agg(
        F.min(time).alias("first_ts"), F.max(time).alias("last_ts"), F.count(F.lit(1)).alias("len")
    )
    spaced = Ordered(starts, keys, ["start_pos"]).with_lead("next_ts", F.col("first_ts")).frame()
    gap = (F.col("next_ts") - F.col("last_ts")) / 1e6
    return spaced.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("segments"),
        F.sum("len").alias("covered"),
        F.avg(gap).alias("interval_mean"),
        F.stddev_samp(gap).alias("interval_std"),
    )


def fixed_chunks(numbered: DataFrame, keys: Sequence[str], period: int, time: str, tokens: str) -> DataFrame:
    """Consecutive groups of ``period`` rows (the last may be short)."""
    chunk = F.floor(F.col("pos") / period).alias("chunk_no")
    member = F.struct("pos", F.col(tokens).alias("t"))
    return numbered.groupBy(*keys, chunk).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(time).alias("first_ts"),
        F.max(time).alias("last_ts"),
        F.array_join(F.transform(F.array_sort(F.collect_list(member)), lambda m: m["t"]), SEPARATOR).alias("segment"),
    )


def segment_groups(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Member count and first position per distinct segment."""
    return chunks.groupBy(*keys, "segment").agg(
        F.count(F.lit(1)).alias("member_count"), F.min("chunk_no").alias("first_chunk")
    )


def top_segments(groups: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """k largest groups; Spark keeps only k rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col("member_count").desc(), F.col("first_chunk"), F.col("segment"))
    return groups.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def segments_over_ratio(groups: DataFrame, keys: Sequence[str], ratio: float) -> DataFrame:
    peak = groups.groupBy(*keys).agg(F.max("member_count").alias("peak"))
    return groups.join(small_side(peak), list(keys)).where(F.col("member_count") >= F.col("peak") * ratio)


def server_length_sum(pattern: Column) -> Column:
    """Sum of lengths over the server-side tokens ``S-<length>-<code>``."""
    parts = F.filter(F.split(pattern, SEPARATOR), lambda t: t.startswith("S-"))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, t: acc + F.split(t, "-")[1].cast("long"))


def token_similarity(a: Column, b: Column) -> Column:
    """Share of equal positions; 0 for different lengths."""
    same = F.aggregate(
        F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda acc, v: acc + v
    )
    return F.when(F.size(a) == F.size(b), same / F.size(a)).otherwise(F.lit(0.0))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, separators removed; 1 for two empty strings."""
    x, y = F.regexp_replace(a, "[-,]", ""), F.regexp_replace(b, "[-,]", "")
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / longest)


def pick_pattern(patterns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shortest pattern first, then highest rate, count and name."""
    w = Window.partitionBy(*keys).orderBy("size", F.col("rate").desc(), F.col("matches").desc(), "gram")
    return patterns.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")
