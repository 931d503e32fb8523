"""Evaluation of many scenarios, methods and channels in one plan, and the group figures around it.

A model is a row of a table, trained by group; tests meet the models of their scenario, so nothing is looped over on the
driver however many scenarios, attack tests and channels there are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.operators import subspace
from tracelode.operators.features import flow_features, packet_vector, sequence_vectors
from tracelode.operators.metrics import ratio
from tracelode.operators.sweep import latest_window
from tracelode.plans.ordered import Ordered
from tracelode.session import materialize

MODEL = "_model"


def _named(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """One text for several key columns, lengths included, so that no two keys meet."""
    parts = [F.coalesce(F.concat(F.length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string")), F.lit("-")) for k in keys]
    return rows.withColumn(name, F.concat(*parts))


def scenario_alarms(
    training: DataFrame, tests: DataFrame, scenario: Sequence[str], test: Sequence[str], channel: str, time: str, lag: int, rank: int,
    calibration: DataFrame | None = None, eps: float = 1e-6, factor: float = 1.0,
) -> DataFrame:
    """``tests`` with score, threshold and alarm by the subspace model of their scenario and channel.

    ``training`` is (scenario, channel, i, v) with dense i, ``tests`` (scenario, test, channel, time, v).  Thresholds come from the
    last third of the training rows, or from ``calibration`` (scenario, channel, i, v) with all rows trained on.  A test's first
    windows begin in the last values that its model was trained on."""
    own = [*scenario, channel]
    base = materialize(_named(training, own, MODEL).select(*own, MODEL, "i", "v"))
    if calibration is None:
        base = materialize(subspace.split_training(base, MODEL, lag))
        fitted, held = base.where(F.col("part") == "train"), base.where(F.col("part") == "calibration")
    else:
        fitted, held = base, _named(calibration, own, MODEL).select(*own, MODEL, "i", "v")
    model = materialize(subspace.train(fitted.select(MODEL, "i", "v"), MODEL, lag, rank))
    last = fitted.groupBy(MODEL).agg(F.max("i").alias("_last"))
    tail = fitted.join(last, MODEL).where(F.col("i") > F.col("_last") - (lag - 1)).select(MODEL, (F.col("i") - F.col("_last") + lag - 2).alias("i"), "v")

    def scored(rows: DataFrame, series: str, keep: list[str]) -> DataFrame:
        """Rows (MODEL, series, i, v, keep) behind their model's tail."""
        names = rows.select(MODEL, series).distinct()
        front = tail.join(names, MODEL).select(series, "i", "v")
        body = rows.select(series, (F.col("i") + lag - 1).alias("i"), "v", *keep)
        models = names.join(model, MODEL).select(series, "component", "basis", "projection", "weight")
        found = subspace.score(front.unionByName(body, allowMissingColumns=True), models, series, lag, keep)
        return found.where(F.col("i") >= lag - 1)

    first = held.groupBy(MODEL).agg(F.min("i").alias("_first"))
    checked = scored(held.join(first, MODEL).select(MODEL, F.col(MODEL).alias("_series"), (F.col("i") - F.col("_first")).alias("i"), "v"), "_series", [])
    limits = checked.groupBy(F.col("_series").alias(MODEL)).agg((F.max("score") + eps).alias("threshold"))
    rows = _named(_named(tests, own, MODEL), [*scenario, *test, channel], "_series")
    numbered = Ordered(rows, ["_series"], [time]).with_row_number("i").frame()
    keep = [c for c in tests.columns if c != "v"]
    out = scored(numbered.select(MODEL, "_series", "i", "v", *keep), "_series", keep)
    places = rows.select("_series", MODEL).distinct().join(limits, MODEL).select("_series", "threshold")
    return out.join(places, "_series").select(*keep, "score", "threshold", (F.col("score") >= F.col("threshold") * factor).alias("alarm"))


def channel_hits(alarms: DataFrame, attacks: DataFrame, keys: Sequence[str], channel: str, time: str, start: str, end: str) -> DataFrame:
    """(keys, start, end, channel, before, inside): first alarms of every channel before the attack and in [start, end)."""
    rows = alarms.join(attacks.select(*keys, start, end), list(keys))
    at = F.when(F.col("alarm"), F.col(time))
    return rows.groupBy(*keys, start, end, channel).agg(
        F.min(F.when(F.col(time) < F.col(start), at)).alias("before"), F.min(F.when((F.col(time) >= F.col(start)) & (F.col(time) < F.col(end)), at)).alias("inside")
    )


def instances(hits: DataFrame, attacks: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """One row for each attack test: earliest alarms over its channels, time to exposure, strict success.  A test without any
    rows is not exposed."""
    best = hits.groupBy(*keys).agg(F.min("before").alias("before"), F.min("inside").alias("inside"))
    rows = attacks.select(*keys, start, end).join(best, list(keys), "left")
    return rows.withColumn("tte", F.col("inside") - F.col(start)).withColumn("strict_success", F.col("before").isNull() & F.col("inside").isNotNull())


def scenario_summary(rows: DataFrame, scenario: Sequence[str]) -> DataFrame:
    """Counts of exposed tests and of tests with early alarms, accuracy, F1, mean time to exposure, strict exposure rate."""
    out = rows.groupBy(*scenario).agg(
        F.count(F.lit(1)).alias("n_instances"), F.count_if(F.col("inside").isNotNull()).alias("tp"), F.count_if(F.col("before").isNotNull()).alias("fp"),
        F.avg("tte").alias("tte_mean"), F.count_if("strict_success").alias("strict_tp"),
    )
    out = out.withColumn("tn", F.col("n_instances") - F.col("fp")).withColumn("fn", F.col("n_instances") - F.col("tp"))
    return out.withColumns({
        "acc": (F.col("tp") + F.col("tn")) / (2 * F.col("n_instances")), "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
        "strict_aer": F.col("strict_tp") / F.col("n_instances"),
    })


def clean_alarms(alarms: DataFrame, scenario: Sequence[str], channel: str, time: str) -> DataFrame:
    """Alarm points of every channel on a clean recording, and the first of them."""
    return alarms.groupBy(*scenario, channel).agg(F.count_if("alarm").alias("alarm_points"), F.min(F.when(F.col("alarm"), F.col(time))).alias("first_alarm"))


def exposure_of_windows(windows: DataFrame, keys: Sequence[str], start: str, label: Column, predicted: Column, attack_start: str) -> DataFrame:
    """Time from the start of the attack to the first predicted window that is labelled as one; null without it."""
    hit = F.when(label & predicted, F.col(start))
    return windows.groupBy(*keys).agg((F.min(hit) - F.min(attack_start)).alias("tte"), F.count_if(label & predicted).alias("hits"))


# ---- samples by perspective ------------------------------------------------------------------------------------------------


def cycle_features(packets: DataFrame, cycles: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, size: str, forward: Column, label: Column, unit: float = 1000.0) -> DataFrame:
    """The 33 flow statistics of every cycle (keys, cycle, first, last), last exclusive, of packet positions.

    Packets outside every cycle take no part.  A cycle is stamped with its first labelled packet, else with its first one."""
    keys, order = list(keys), list(order)
    rows = Ordered(packets.withColumn("_fwd", forward).withColumn("_lab", label), keys, order).with_row_number("_pos").frame()
    placed = latest_window(rows, cycles, keys, "_pos", "first", "last", "_in", ["cycle"]).where(F.col("_in").isNotNull())
    own = placed.withColumn("cycle", F.col("_in.cycle")).drop("_in")
    return flow_features(own, [*keys, "cycle"], order, time, size, F.col("_fwd"), F.col("_lab"), unit)


def samples(perspective: str, packets: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, size: str, forward: Column, header: Sequence[Column], payload: Column, label: Column, cycles: DataFrame | None = None) -> DataFrame:
    """Feature rows of one perspective: ``packet``, ``sequence3``, ``flow`` or ``pattern_cycle``, which needs ``cycles``."""
    if perspective == "packet":
        return packets.select(*keys, *order, F.col(time).alias("ts"), packet_vector(header, payload).alias("features"), label.alias("label"))
    if perspective == "sequence3":
        return sequence_vectors(packets, keys, order, header, payload, time, label)
    if perspective == "flow":
        return flow_features(packets, keys, order, time, size, forward, label)
    if perspective == "pattern_cycle" and cycles is not None:
        return cycle_features(packets, cycles, keys, order, time, size, forward, label)
    raise ValueError(f"no samples for perspective {perspective!r}")


# ---- rows of groups, byte orders, fields --------------------------------------------------------------------------------------


def group_match_rates(before: DataFrame, after: DataFrame, keys: Sequence[str], matched: Column, difference: Column) -> DataFrame:
    """Row match rate of a group in the better direction: the higher rate, then ``before`` if it has more matched rows.

    ``before`` and ``after`` hold each row of the group once; the mean and the population deviation of the absolute time
    difference are those of the matched rows."""
    keys = list(keys)

    def rates(rows: DataFrame, name: str) -> DataFrame:
        apart = F.when(matched, F.abs(difference))
        return rows.groupBy(*keys).agg(F.struct(
            (F.count_if(matched) / F.count(F.lit(1))).alias("rate"), F.count_if(matched).alias("matched"), F.count(F.lit(1)).alias("total"),
            F.avg(apart).alias("mean"), F.stddev_pop(apart).alias("std"), F.lit(name).alias("direction"),
        ).alias(name))

    both = rates(before, "before").join(rates(after, "after"), keys, "full")
    b, a = F.col("before"), F.col("after")
    first = a.isNull() | (b["rate"] > a["rate"]) | ((b["rate"] == a["rate"]) & (b["matched"] > a["matched"]))
    best = both.select(*keys, F.when(F.coalesce(first, F.lit(False)), b).otherwise(a).alias("x"))
    return best.select(
        *keys, F.col("x.total").alias("total_rows"), F.col("x.matched").alias("matched_rows"), F.col("x.rate").alias("row_match_rate"),
        F.col("x.mean").alias("avg_time_diff"), F.col("x.std").alias("std_time_diff"), F.col("x.direction").alias("direction"),
    )


def endian_consistency(fields: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Score of a solution by the share of its most common byte order, in bands; fields without one do not count, and a solution
    without any byte order is consistent."""
    big, little = F.count_if(F.col("endian") == "big"), F.count_if(F.col("endian") == "little")
    rows = fields.groupBy(*keys).agg(F.greatest(big, little).alias("_m"), (big + little).alias("_n"))
    share = F.col("_m") / F.col("_n")
    score = F.when(F.col("_n") == 0, 1.0).when(share >= 1, 1.0)
    for low, value in ((0.9, 0.8), (0.8, 0.6), (0.7, 0.4), (0.6, 0.2)):
        score = score.when(share >= low, value)
    return rows.select(*keys, score.otherwise(0.0).alias("consistency"))


def neighbour_fields(fields: DataFrame, blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each block (keys, block_start, block_end, inclusive): the first two and last two dynamic fields that meet it, and the
    nearest fields wholly before the first and behind the last of them.

    ``fields`` is (keys, field, start, end, is_dynamic), ends inclusive.  Keys have one block; fields of a solution are few."""
    keys = list(keys)
    rows = fields.join(blocks, keys)
    meets = F.col("is_dynamic") & (F.col("start") <= F.col("block_end")) & (F.col("end") >= F.col("block_start"))
    rows = rows.withColumn("_on", meets)
    w = Window.partitionBy(*keys)
    rows = rows.withColumn("_s", F.min(F.when(meets, F.col("start"))).over(w)).withColumn("_e", F.max(F.when(meets, F.col("end"))).over(w))
    on = F.array_sort(F.collect_list(F.when(F.col("_on"), F.struct("start", "field"))))
    left = F.max(F.when(F.col("end") < F.col("_s"), F.struct("end", "field")))
    right = F.min(F.when(F.col("start") > F.col("_e"), F.struct("start", "field")))
    out = rows.groupBy(*keys).agg(on.alias("_o"), left.alias("_l"), right.alias("_r"))
    at = lambda k: F.try_element_at("_o", F.lit(k))["field"]
    return out.select(
        *keys, at(1).alias("first_field"), at(2).alias("second_field"), at(-1).alias("last_field"), at(-2).alias("previous_field"),
        F.col("_l.field").alias("field_before"), F.col("_r.field").alias("field_behind"),
    )


def column_thresholds(counts: DataFrame, keys: Sequence[str], enumeration: Column, for_enumerations: float, for_continuous: float) -> DataFrame:
    """Score that a column's fields must pass, by whether its values enumerate."""
    return counts.select(*keys, enumeration.alias("is_enumeration"), F.when(enumeration, for_enumerations).otherwise(for_continuous).alias("threshold"))
