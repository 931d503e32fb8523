"""Assignment of fields to columns and of column groups to sessions.

Score tables hold one row per (field, column) or (group, session).  Assignments run
in rounds of joins and aggregates, so no score list is walked on the driver; a
round only reports whether anything was matched."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.session import materialize


def greedy_assignment(scores: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """One-to-one assignment in descending score order (ties: a, then b).

    A pair that is the best remaining one for both its ends is exactly what the
    sequential scan would take next for them, so whole sets of such pairs are
    taken per round."""
    rest = materialize(scores.select(a, b, score))
    rank = F.struct((-F.col(score)).alias("s"), F.col(a).alias("a"), F.col(b).alias("b"))
    taken = None
    while not rest.isEmpty():
        best_a = rest.groupBy(a).agg(F.min(rank).alias("_ra"))
        best_b = rest.groupBy(b).agg(F.min(rank).alias("_rb"))
        marked = rest.join(best_a, a).join(best_b, b)
        now = materialize(marked.where((F.col("_ra") == rank) & (F.col("_rb") == rank)).select(a, b, score))
        taken = now if taken is None else taken.unionByName(now)
        rest = materialize(rest.join(now.select(a), a, "left_anti").join(now.select(b), b, "left_anti"))
    return taken if taken is not None else rest


def reusable_assignment(scores: DataFrame, group: str, session: str, score: str) -> DataFrame:
    """Best session per group; sessions may serve several groups."""
    rank = F.struct((-F.col(score)).alias("s"), F.col(session).alias("x"))
    best = scores.groupBy(group).agg(F.min(rank).alias("r"))
    return best.select(group, F.col("r.x").alias(session), (-F.col("r.s")).alias(score))


def column_claims(scores: DataFrame, keys: Sequence[str], column: str, field: str, score: str, threshold: str) -> DataFrame:
    """Columns claim their best free field above their threshold, a field keeps its
    best claimant, and the losers claim again until a round has no conflict."""
    keys = list(keys)
    rest = materialize(scores.where(F.col(score) > F.col(threshold)).select(*keys, column, field, score))
    matched = None
    while not rest.isEmpty():
        choice = F.struct((-F.col(score)).alias("s"), F.col(field).alias("f"))
        wanted = rest.groupBy(*keys, column).agg(F.min(choice).alias("w"))
        claims = wanted.select(*keys, column, F.col("w.f").alias(field), (-F.col("w.s")).alias(score))
        ranked = F.struct((-F.col(score)).alias("s"), F.col(column).alias("c"))
        won = claims.groupBy(*keys, field).agg(F.min(ranked).alias("w"), F.count(F.lit(1)).alias("n"))
        now = materialize(won.select(*keys, F.col("w.c").alias(column), field, (-F.col("w.s")).alias(score), "n"))
        matched = now.drop("n") if matched is None else matched.unionByName(now.drop("n"))
        # Groups of keys without a conflict are finished.
        open_keys = now.groupBy(*keys).agg(F.max("n").alias("n")).where(F.col("n") > 1).select(*keys)
        rest = rest.join(open_keys, keys, "left_semi") if keys else (rest if not open_keys.isEmpty() else rest.limit(0))
        rest = rest.join(now.select(*keys, column), [*keys, column], "left_anti")
        rest = materialize(rest.join(now.select(*keys, field), [*keys, field], "left_anti"))
    return matched if matched is not None else rest


def solution_score(average: Column, coverage: Column, reward: Column, coverage_weight: float = 0.3, score_weight: float = 0.7) -> Column:
    """Matched score and coverage blended with the reward of the solution."""
    matched = average * (1 - coverage_weight) + coverage * coverage_weight
    return score_weight * matched + (1 - score_weight) * reward


def best_solutions(matches: DataFrame, totals: DataFrame, keys: Sequence[str], solution: str, score: str, reward: str) -> DataFrame:
    """Best solution per (group, session) from its matched columns."""
    per = matches.groupBy(*keys, solution).agg(F.avg(score).alias("avg_score"), F.count(F.lit(1)).alias("matched"), F.first(reward).alias(reward))
    joined = per.join(totals, [k for k in keys if k in totals.columns])
    total = solution_score(F.col("avg_score"), F.col("matched") / F.col("columns"), F.col(reward))
    w = Window.partitionBy(*keys).orderBy(F.col("total_score").desc(), F.col(solution))
    return joined.withColumn("total_score", total).withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def unmatched_best(scores: DataFrame, matched: DataFrame, keys: Sequence[str], column: str, field: str, score: str) -> DataFrame:
    """Best score of every column that got no field."""
    free = scores.join(matched.select(*keys, column), [*keys, column], "left_anti")
    return free.groupBy(*keys, column).agg(F.max_by(field, F.struct(F.col(score), F.col(field))).alias("best_field"), F.max(score).alias("best_score"))


def top_matches(scores: DataFrame, keys: Sequence[str], score: str, tie: str, k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(tie))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def field_specs(selected: DataFrame, mapping: DataFrame, solutions: DataFrame) -> DataFrame:
    """Selected solutions joined to their matched columns and field definitions."""
    chosen = mapping.join(selected.select("group_id", "session", "solution"), ["group_id", "session", "solution"])
    return chosen.join(solutions, ["session", "solution", "field"])
