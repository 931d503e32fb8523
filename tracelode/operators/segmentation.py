"""Exact segmentation of byte blocks into typed fields.

The reward of a segmentation averages field confidences and the share of neighbouring
fields with the expected entropy order.  For a fixed number of fields both are sums,
so a dynamic program over (position, fields so far, last field static, byte order
seen) finds the best ones exactly.  Its input is the edge table of one block: at
most eight rows per byte, whatever the number of payloads."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.operators import blocks
from tracelode.plans.sizing import small_side

# Weights of the field reward.
COVERAGE, CONFIDENCE, ENTROPY, COMPLETE = 0.10, 0.65, 0.20, 0.05
OFF_BLOCK = 0.9
FIELDS_SHARE = 0.55


def block_edges(types: DataFrame, spans: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Typed slices inside each block, with edge entropies and the on-block flag.

    ``spans``: (keys, block_index, block_start, block_end, initial_start, initial_end)."""
    keys = list(keys)
    at = stats.select(*keys, "pos", F.round("entropy", 12).alias("e"))
    rows = types.join(spans, keys).withColumn("end", F.col("start") + F.col("length") - 1)
    rows = rows.where((F.col("start") >= F.col("block_start")) & (F.col("end") <= F.col("block_end")))
    first = at.withColumnsRenamed({"pos": "start", "e": "first_entropy"})
    last = at.withColumnsRenamed({"pos": "end", "e": "last_entropy"})
    joined = rows.join(small_side(first), [*keys, "start"]).join(small_side(last), [*keys, "end"])
    return joined.withColumn("on_block", (F.col("start") <= F.col("initial_end")) & (F.col("end") >= F.col("initial_start")))


def _pair_ok(run: str, static_before: bool, static_after: bool, before: float, after: float) -> bool:
    if run == "little":
        return static_after or before < after
    return static_before or before > after


def _search(edges: pd.DataFrame, run: str, keep: int) -> list[tuple[float, list[int]]]:
    """Best segmentations as (reward, edge row numbers)."""
    begin, end = int(edges["block_start"].iloc[0]), int(edges["block_end"].iloc[0])
    rows = edges.reset_index(drop=True)
    starting: dict[int, list[int]] = {}
    for i, s in enumerate(rows["start"]):
        starting.setdefault(int(s), []).append(i)
    columns = {c: rows[c].tolist() for c in ("length", "confidence", "is_dynamic", "endian", "first_entropy", "last_entropy", "on_block")}
    worth = [CONFIDENCE * c * (1.0 if on else OFF_BLOCK) for c, on in zip(columns["confidence"], columns["on_block"])]
    ordered = [e != "n/a" for e in columns["endian"]]

    def layers(count: int, entropy: bool, usable) -> dict:
        """Best paths of ``count`` usable fields to the block's end by state; a state is
        (last field static, byte order seen), which with the position decides every gain
        to come."""
        layer = {begin: {(None, False): [(0.0, [])]}}
        for _ in range(count):
            following: dict[int, dict] = {}
            for position, states in layer.items():
                for (static, seen), paths in states.items():
                    for i in starting.get(position, []):
                        if not usable(i):
                            continue
                        now_static = not columns["is_dynamic"][i]
                        slot = following.setdefault(position + int(columns["length"][i]), {}).setdefault((now_static, seen or ordered[i]), [])
                        for value, path in paths:
                            extra = worth[i] / count
                            if path and entropy:
                                extra += ENTROPY / (count - 1) * _pair_ok(run, static, now_static, columns["last_entropy"][path[-1]], columns["first_entropy"][i])
                            slot.append((value + extra, path + [i]))
            layer = {
                p: {s: sorted(v, key=lambda x: (-x[0], x[1]))[:keep] for s, v in states.items()} for p, states in following.items()
            }
        return layer.get(end + 1, {})

    found: list[tuple[float, list[int]]] = []
    for count in range(1, end - begin + 2):
        if count > 1:
            # Paths with a byte order: pairs count.
            for (_, seen), paths in layers(count, True, lambda i: True).items():
                found += [(value + COVERAGE + COMPLETE, path) for value, path in paths if seen]
        # Without a comparable pair the entropy share is fixed at one half, so these are
        # ranked by their confidences alone.
        for paths in layers(count, False, lambda i, one=count == 1: one or not ordered[i]).values():
            found += [(value + ENTROPY * 0.5 + COVERAGE + COMPLETE, path) for value, path in paths]
    found.sort(key=lambda x: (-x[0], x[1]))
    return found[:keep]


def segment(edges: DataFrame, keys: Sequence[str], keep: int = 5) -> DataFrame:
    """Top segmentations per (keys, block, byte order) as one row per field."""
    keys = list(keys)
    group = [*keys, "block_index", "run"]
    fields = ", ".join(f"{c} {edges.schema[c].dataType.simpleString()}" for c in group)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "length"]).reset_index(drop=True)
        out = []
        for rank, (reward, path) in enumerate(_search(pdf, str(pdf["run"].iloc[0]), keep)):
            for number, i in enumerate(path):
                row = pdf.iloc[i]
                out.append(
                    (*[row[c] for c in group], rank, number, int(row["start"]), int(row["length"]), row["field_type"], row["endian"],
                     float(row["confidence"]), bool(row["is_dynamic"]), round(reward, 9))
                )
        names = [*group, "solution", "field_no", "start", "length", "field_type", "endian", "confidence", "is_dynamic", "reward"]
        return pd.DataFrame(out, columns=names)

    return edges.groupBy(*group).applyInPandas(
        solve, f"{fields}, solution int, field_no int, start int, length int, field_type string, endian string, confidence double, is_dynamic boolean, reward double"
    )


def fields_reward(fields: DataFrame, keys: Sequence[str], stats: DataFrame, session: Sequence[str], size: str) -> DataFrame:
    """Reward of given segmentations (one row per field) from aggregates.

    ``size``: column with the block length.  Neighbour terms look at the next field of
    the same segmentation, whose length is bounded by the block."""
    keys, session = list(keys), list(session)
    at = stats.select(*session, "pos", F.round("entropy", 12).alias("e"))
    rows = fields.withColumn("end", F.col("start") + F.col("length") - 1)
    rows = rows.join(small_side(at.withColumnsRenamed({"pos": "start", "e": "_fe"})), [*session, "start"])
    rows = rows.join(small_side(at.withColumnsRenamed({"pos": "end", "e": "_le"})), [*session, "end"])
    order = F.struct("start", "_fe", "_le", "is_dynamic", "endian", "confidence", "length", F.coalesce("on_block", F.lit(True)).alias("on_block"))
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("f"), F.max(size).alias("_size"))
    n = F.size("f")
    endians = F.filter(F.transform("f", lambda x: x["endian"]), lambda e: e != "n/a")
    little = F.size(F.filter(endians, lambda e: e == "little"))
    run_little = little > F.size(endians) - little
    pairs = F.zip_with(F.slice("f", 1, F.greatest(n - 1, F.lit(1))), F.slice("f", 2, F.greatest(n - 1, F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    good = F.size(
        F.filter(
            pairs,
            lambda p: F.when(run_little, ~p["b"]["is_dynamic"] | (p["a"]["_le"] < p["b"]["_fe"])).otherwise(
                ~p["a"]["is_dynamic"] | (p["a"]["_le"] > p["b"]["_fe"])
            ),
        )
    )
    entropy = F.when((n < 2) | (F.size(endians) == 0), 0.5).otherwise(good / (n - 1))
    mean = F.aggregate("f", F.lit(0.0), lambda acc, x: acc + x["confidence"] * F.when(x["on_block"], 1.0).otherwise(OFF_BLOCK)) / n
    covered = F.aggregate("f", F.lit(0), lambda acc, x: acc + x["length"])
    complete = F.when(covered >= F.col("_size"), COMPLETE).otherwise(0.0)
    mixed = F.when((little > 0) & (little < F.size(endians)), 0.5).otherwise(0.0)
    reward = COVERAGE * covered / F.col("_size") + CONFIDENCE * mean + ENTROPY * entropy + complete - mixed
    return packed.select(*keys, n.alias("fields"), F.round(F.greatest(F.lit(0.0), reward), 9).alias("reward"))


def values_reward(fields: DataFrame, keys: Sequence[str], similarity: str, on_block: str, length: str) -> DataFrame:
    """.9 mean similarity of on-block fields + .1 of their byte share."""
    hit = F.col(on_block)
    mean = F.coalesce(F.avg(F.when(hit, F.col(similarity))), F.lit(0.0))
    share = F.sum(F.when(hit, F.col(length)).otherwise(0)) / F.sum(length)
    return fields.groupBy(*keys).agg((0.9 * mean + 0.1 * share).alias("values_reward"))


def total_reward(fields: str, values: str):
    return FIELDS_SHARE * F.col(fields) + (1 - FIELDS_SHARE) * F.col(values)


def merged_spans(extended: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overlapping blocks become one range that is segmented as a whole: the program is
    exact, so re-solving the union replaces pairwise repair of conflicting pieces."""
    ranges = blocks.coalesce_ranges(extended, keys, "extended_start", "extended_end")
    first = extended.groupBy(*keys).agg(F.min("start_position").alias("initial_start"), F.max("end_position").alias("initial_end"))
    rows = ranges.join(small_side(first), list(keys))
    return rows.select(
        *keys, F.col("extended_start").alias("block_index"), F.col("extended_start").alias("block_start"), F.col("extended_end").alias("block_end"),
        F.greatest("extended_start", "initial_start").alias("initial_start"), F.least("extended_end", "initial_end").alias("initial_end"),
    )


def static_spans(gaps: DataFrame, keys: Sequence[str], most: int = 8) -> DataFrame:
    """Static spans as blocks of their own, cut to solvable size."""
    cut = blocks.split_static(gaps, keys, most)
    return cut.select(
        *keys, F.col("start_position").alias("block_index"), F.col("start_position").alias("block_start"), F.col("end_position").alias("block_end"),
        F.col("start_position").alias("initial_start"), F.col("end_position").alias("initial_end"),
    )


def assemble(dynamic: DataFrame, static: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full-payload solution per byte order: best segmentation of every range in order."""
    best = dynamic.where(F.col("solution") == 0).unionByName(static.where(F.col("solution") == 0))
    return best.drop("solution", "field_no", "block_index")


def best_run(rewards: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Byte order with the higher reward (ties: big)."""
    return rewards.groupBy(*keys).agg(F.min_by(F.struct("run", "reward", "fields"), F.struct((-F.col("reward")).alias("r"), "run")).alias("b")).select(*keys, "b.*")
