"""Scenario evaluation and the figures of groups, cycles and fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode.operators import profiling, scenarios
from tracelode.plans.ordered import Ordered
from tracelode.queries.registry import query
from tracelode.sources.tables import events, table

DAY = 86_400_000_000
KEYS = ["scenario", "method", "test"]


def tagged(spark, folder):
    """Events as traces: three scenarios of four tests each, the event types as channels, two methods by their limits."""
    ev = events(spark, folder)
    rows = ev.select("event_id", (F.col("user_id") % 3).alias("scenario"), (F.floor(F.col("user_id") / 3) % 4).alias("test"), F.col("event_type").alias("channel"), F.col("ts_us").alias("t"), "value")
    methods = F.array(F.struct(F.lit("wide").alias("method"), F.lit(120.0).alias("limit")), F.struct(F.lit("narrow").alias("method"), F.lit(420.0).alias("limit")))
    both = rows.withColumn("_m", F.explode(methods)).select("*", "_m.method", "_m.limit").drop("_m")
    alarms = both.withColumn("alarm", F.col("value") > F.col("limit"))
    spans = both.groupBy(*KEYS).agg(F.min("t").alias("lo"))
    attacks = spans.select(*KEYS, (F.col("lo") + (F.col("test") + 1) * DAY).alias("start_us"), (F.col("lo") + (2 * F.col("test") + 2) * DAY).alias("end_us"))
    return alarms, attacks


TAGGED = f"""with tr as (select event_id, user_id % 3 as scenario, user_id // 3 % 4 as test, event_type as channel, epoch_us(ts) as t, value, method, value > lim as alarm
    from events, (values ('wide', 120.0), ('narrow', 420.0)) m(method, lim)),
ak as (select scenario, method, test, min(t) + (test + 1) * {DAY} as start_us, min(t) + (2 * test + 2) * {DAY} as end_us from tr group by 1, 2, 3),
hi as (select scenario, method, test, start_us, end_us, channel, min(t) filter (alarm and t < start_us) as before, min(t) filter (alarm and t >= start_us and t < end_us) as inside
    from tr join ak using (scenario, method, test) group by 1, 2, 3, 4, 5, 6),
ins as (select scenario, method, test, start_us, end_us, min(before) as before, min(inside) as inside, min(inside) - start_us as tte, min(before) is null and min(inside) is not null as strict_success
    from hi group by 1, 2, 3, 4, 5)"""


@query("scenario_channel_hits", TAGGED + " select * from hi")
def scenario_channel_hits(spark, folder):
    alarms, attacks = tagged(spark, folder)
    return scenarios.channel_hits(alarms, attacks, KEYS, "channel", "t", "start_us", "end_us")


def _instances(spark, folder):
    alarms, attacks = tagged(spark, folder)
    return scenarios.instances(scenarios.channel_hits(alarms, attacks, KEYS, "channel", "t", "start_us", "end_us"), attacks, KEYS, "start_us", "end_us")


@query("scenario_instances", TAGGED + " select * from ins")
def scenario_instances(spark, folder):
    return _instances(spark, folder)


@query(
    "scenario_summaries",
    TAGGED + """, c as (select scenario, method, count(*) as n_instances, count(inside) as tp, count(before) as fp, count(*) - count(before) as tn, count(*) - count(inside) as fn,
      avg(tte) as tte_mean, count(*) filter (strict_success) as strict_tp from ins group by 1, 2)
    select scenario, method, n_instances, tp, fp, tn, fn, round(tte_mean, 0) as tte_mean, strict_tp, round((tp + tn) / (2 * n_instances), 9) as acc,
      round(case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end, 9) as f1, round(strict_tp / n_instances, 9) as strict_aer from c""",
)
def scenario_summaries(spark, folder):
    """All scenarios under all methods in one table."""
    out = scenarios.scenario_summary(_instances(spark, folder), ["scenario", "method"])
    return out.withColumns({"tte_mean": F.round("tte_mean", 0), **{c: F.round(c, 9) for c in ("acc", "f1", "strict_aer")}})


@query("clean_channel_alarms", TAGGED + " select scenario, method, channel, count(*) filter (alarm) as alarm_points, min(t) filter (alarm) as first_alarm from tr where test = 0 group by 1, 2, 3")
def clean_channel_alarms(spark, folder):
    return scenarios.clean_alarms(tagged(spark, folder)[0].where("test = 0"), ["scenario", "method"], "channel", "t")


@query(
    "exposure_of_windows",
    TAGGED + f""", w as (select scenario, method, test, t // {DAY} * {DAY} as w_us, bool_or(alarm) as predicted from tr group by 1, 2, 3, 4)
    select scenario, method, test, min(w_us) filter (predicted and w_us >= start_us and w_us < end_us) - min(start_us) as tte, count(*) filter (predicted and w_us >= start_us and w_us < end_us) as hits
    from w join ak using (scenario, method, test) group by 1, 2, 3""",
)
def exposure_of_windows(spark, folder):
    """Time to exposure from window predictions."""
    alarms, attacks = tagged(spark, folder)
    windows = alarms.groupBy(*KEYS, (F.floor(F.col("t") / DAY) * DAY).alias("w_us")).agg(F.bool_or("alarm").alias("predicted")).join(attacks, KEYS)
    label = (F.col("w_us") >= F.col("start_us")) & (F.col("w_us") < F.col("end_us"))
    return scenarios.exposure_of_windows(windows, KEYS, "w_us", label, F.col("predicted"), "start_us")


@query("scenario_models")
def scenario_models(spark, folder):
    """Summaries of subspace models: one for each scenario and channel, trained on its first half, tested on the rest."""
    ev = events(spark, folder)
    rows = ev.select((F.col("user_id") % 2).alias("scenario"), (F.floor(F.col("user_id") / 2) % 3).alias("test"), F.col("event_type").alias("channel"), F.struct("ts_us", "event_id").alias("at"), "ts_us", F.col("value").alias("v"))
    middle = rows.groupBy("scenario").agg(F.expr("percentile(ts_us, 0.5)").alias("m"))
    split = rows.join(middle, "scenario")
    train = Ordered(split.where("ts_us < m"), ["scenario", "channel"], ["at"]).with_row_number("i").frame().select("scenario", "channel", "i", "v")
    tests = split.where("ts_us >= m").groupBy("scenario", "test", "channel", "ts_us").agg(F.avg("v").alias("v"))
    alarms = scenarios.scenario_alarms(train, tests, ["scenario"], ["test"], "channel", "ts_us", 8, 3)
    spans = tests.groupBy("scenario", "test").agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"))
    third = F.floor((F.col("hi") - F.col("lo")) / 3)
    attacks = spans.select("scenario", "test", (F.col("lo") + third).alias("start_us"), (F.col("lo") + 2 * third).alias("end_us"))
    hits = scenarios.channel_hits(alarms, attacks, ["scenario", "test"], "channel", "ts_us", "start_us", "end_us")
    return scenarios.scenario_summary(scenarios.instances(hits, attacks, ["scenario", "test"], "start_us", "end_us"), ["scenario"])


# ---- cycles, groups, fields ---------------------------------------------------------------------------------------------------

STATS = [f"{side}_{s}" for side in ("all", "fwd", "bwd") for s in ("packets", "bytes", "mean_size", "duration", "mean_iat", "max_iat")]


def _stats_sql():
    out = []
    for side, flag in (("all", "true"), ("fwd", "fwd"), ("bwd", "not fwd")):
        gap = "g_all" if side == "all" else "g_side"
        out += [
            f"count(*) filter ({flag})::double as {side}_packets", f"round(coalesce(sum(q) filter ({flag}), 0), 2) as {side}_bytes", f"round(coalesce(avg(q) filter ({flag}), 0), 6) as {side}_mean_size",
            f"coalesce((max(ms) filter ({flag}) - min(ms) filter ({flag})) / 1000.0, 0) as {side}_duration",
            f"round(coalesce(avg({gap}) filter ({flag}), 0) / 1000.0, 6) as {side}_mean_iat", f"coalesce(max({gap}) filter ({flag}), 0) / 1000.0 as {side}_max_iat",
        ]
    return ", ".join(out)


@query(
    "cycle_features",
    f"""with p as (select o_custkey % 9 as flow, o_orderkey, o_orderkey * 250 as ms, o_totalprice as q, o_orderkey % 3 > 0 as fwd, o_orderkey % 50 = 0 as lab, row_number() over (partition by o_custkey % 9 order by o_orderkey) - 1 as pos from orders),
    c as (select *, pos // 12 as cycle from p where pos % 12 < 9),
    g as (select *, ms - lag(ms) over (partition by flow, cycle order by o_orderkey) as g_all, ms - lag(ms) over (partition by flow, cycle, fwd order by o_orderkey) as g_side from c)
    select flow, cycle, {_stats_sql()}, bool_or(lab) as label, coalesce(min(ms) filter (lab), min(ms)) as sample_ts from g group by 1, 2""",
)
def cycle_features(spark, folder):
    """Statistics of cycles of nine packets; three packets between two cycles belong to none."""
    packets = table(spark, folder, "orders").select(
        (F.col("o_custkey") % 9).alias("flow"), "o_orderkey", (F.col("o_orderkey") * 250).alias("ms"), F.col("o_totalprice").alias("q")
    )
    counts = packets.groupBy("flow").agg(F.count(F.lit(1)).alias("n"))
    cycles = counts.select("flow", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 12))).alias("cycle")).select("flow", "cycle", (F.col("cycle") * 12).alias("first"), (F.col("cycle") * 12 + 9).alias("last"))
    out = scenarios.samples("pattern_cycle", packets, ["flow"], ["o_orderkey"], "ms", "q", F.col("o_orderkey") % 3 > 0, [], F.lit(b""), F.col("o_orderkey") % 50 == 0, cycles)
    return out.select("flow", "cycle", *(F.round(c, 6 if "mean" in c else 2).alias(c) if "mean" in c or "bytes" in c else F.col(c) for c in STATS), "label", "sample_ts")


@query(
    "group_match_rates",
    """with r as (select l_suppkey % 20 as g, l_quantity - l_linenumber * 5 as d, abs(l_quantity - l_linenumber * 5) < 12 as ok, l_orderkey % 2 as side from lineitem),
    s as (select g, side, count(*) filter (ok) / count(*) as rate, count(*) filter (ok) as m, count(*) as n, avg(abs(d)) filter (ok) as mean, stddev_pop(abs(d)) filter (ok) as std from r group by 1, 2)
    select g, coalesce(x.n, y.n) as total_rows, coalesce(x.m, y.m) as matched_rows, round(coalesce(x.rate, y.rate), 9) as row_match_rate, round(coalesce(x.mean, y.mean), 6) as avg_time_diff, round(coalesce(x.std, y.std), 6) as std_time_diff,
      case when x.n is null then 'after' else 'before' end as direction
    from (select distinct g from s) left join (select b.* from s b left join s a on a.g = b.g and a.side = 1 where b.side = 0 and (a.g is null or b.rate > a.rate or (b.rate = a.rate and b.m > a.m))) x using (g)
      left join (select * from s where side = 1) y using (g)""",
)
def group_match_rates(spark, folder):
    rows = table(spark, folder, "lineitem").select((F.col("l_suppkey") % 20).alias("g"), (F.col("l_quantity") - F.col("l_linenumber") * 5).alias("d"), (F.col("l_orderkey") % 2).alias("side"))
    out = scenarios.group_match_rates(rows.where("side = 0"), rows.where("side = 1"), ["g"], F.abs("d") < 12, F.col("d"))
    return out.withColumns({"row_match_rate": F.round("row_match_rate", 9), "avg_time_diff": F.round("avg_time_diff", 6), "std_time_diff": F.round("std_time_diff", 6)})


@query(
    "endian_consistency",
    """with f as (select p_brand, p_size % 9 as part, case when p_partkey % 11 = 0 then 'little' when p_size % 9 = 0 or p_partkey % 3 = 0 then 'n/a' else 'big' end as e from part),
    c as (select p_brand, part, count(*) filter (e = 'big') as b, count(*) filter (e = 'little') as l from f group by 1, 2), s as (select *, greatest(b, l) / (b + l) as r from c)
    select p_brand, part, case when b + l = 0 or r >= 1 then 1.0 when r >= 0.9 then 0.8 when r >= 0.8 then 0.6 when r >= 0.7 then 0.4 when r >= 0.6 then 0.2 else 0.0 end::double as consistency from s""",
)
def endian_consistency(spark, folder):
    order = F.when(F.col("p_partkey") % 11 == 0, "little").when((F.col("p_size") % 9 == 0) | (F.col("p_partkey") % 3 == 0), "n/a").otherwise("big")
    fields = table(spark, folder, "part").select("p_brand", (F.col("p_size") % 9).alias("part"), order.alias("endian"))
    return scenarios.endian_consistency(fields, ["p_brand", "part"])


@query(
    "neighbour_fields",
    """with f as (select s_nationkey as k, s_suppkey as field, s_suppkey % 97 as s, s_suppkey % 97 + s_suppkey % 4 as e, s_suppkey % 3 > 0 as dyn from supplier),
    o as (select *, dyn and s <= 60 and e >= 30 as hit from f), b as (select k, min(s) filter (hit) as lo, max(e) filter (hit) as hi, list(field order by s, field) filter (hit) as l from o group by 1)
    select k, l[1] as first_field, l[2] as second_field, l[len(l)] as last_field, case when len(l) > 1 then l[len(l) - 1] end as previous_field,
      (select arg_max(field, (e, field)) from f where f.k = b.k and e < lo) as field_before, (select arg_min(field, (s, field)) from f where f.k = b.k and s > hi) as field_behind from b""",
)
def neighbour_fields(spark, folder):
    at = F.col("s_suppkey")
    fields = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("k"), at.alias("field"), (at % 97).alias("start"), (at % 97 + at % 4).alias("end"), (at % 3 > 0).alias("is_dynamic"))
    blocks = fields.select("k").distinct().select("k", F.lit(30).alias("block_start"), F.lit(60).alias("block_end"))
    return scenarios.neighbour_fields(fields, blocks, ["k"])


@query(
    "column_thresholds",
    """with c as (select c_nationkey as k, c_mktsegment as v, count(*) as n from customer group by 1, 2), s as (select k, sum(n) as t, count(*) as u, count(*) filter (n > 1) as r from c group by 1),
    e as (select k, t >= 3 and u > 1 and u <= 10 and u <= t * 0.3 and t > u and r >= u * 0.5 as is_enumeration from s)
    select k, is_enumeration, case when is_enumeration then 0.8 else 0.65 end::double as threshold from e""",
)
def column_thresholds(spark, folder):
    counts = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("k"), "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    rule = counts.groupBy("k").agg(profiling.enumeration(F.sum("n"), F.count(F.lit(1)), F.count_if(F.col("n") > 1)).alias("e"))
    return scenarios.column_thresholds(rule, ["k"], F.col("e"), 0.8, 0.65)
