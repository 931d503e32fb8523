"""Consistency, subspace and one-class detectors, fusion, metrics, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode.operators import calibration, consistency, features, fusion, metrics, oneclass, perturb, resample, subspace, sweep
from tracelode.plans.ordered import Ordered
from tracelode.queries.registry import query
from tracelode.sources.tables import events, micros, table

HOURS3 = 10_800_000_000
DAY = 86_400_000_000
CONFIG = consistency.ConsistencyConfig(window=24, step=4, max_lag=3, min_points=10, residual_run=2, consecutive=2, residual_quantile=0.9)
GROUP = ["pair", "seg"]


def prepared(spark, folder):
    """Two pairs of 3-hour mean series, first two thirds of the month as training."""
    ev = events(spark, folder, "event_type", "value")
    means = resample.bucketed(ev, ["event_type"], "ts_us", "value", HOURS3, "mean")

    def side(pairs, name):
        cases = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.lit(v))])
        rows = means.withColumn("pair", F.try_element_at(cases, F.col("event_type"))).where(F.col("pair").isNotNull())
        return rows.select("pair", "t", F.round("v", 6).alias("v"))

    sup = side({"click": "p1", "purchase": "p2"}, "x")
    ctl = side({"view": "p1", "error": "p2"}, "y")
    rows = consistency.pair_on_grid(sup, ctl, ["pair"], "t", "v")
    seg = F.when(F.floor(F.col("t") / HOURS3) % 240 < 152, "train").otherwise("test")
    return consistency.prepare(rows.withColumn("seg", seg), GROUP, "t")


PREP = """
with b as (select event_type, epoch_us(ts) // 10800000000 * 10800000000 as t, round(avg(value), 6) as v from events group by 1, 2),
j as (select 'p1' as pair, a.t, a.v as xr, c.v as yr from b a join b c on a.t = c.t and a.event_type = 'click' and c.event_type = 'view'
      union all select 'p2', a.t, a.v, c.v from b a join b c on a.t = c.t and a.event_type = 'purchase' and c.event_type = 'error'),
s as (select *, case when (t // 10800000000) % 240 < 152 then 'train' else 'test' end as seg from j),
m as (select pair, seg, median(xr) as mx, median(yr) as my, count(*) as n from s group by 1, 2),
d as (select pair, seg, any_value(mx) as mx, any_value(my) as my, any_value(n) as n, median(abs(xr - mx)) * 1.4826 as sx, median(abs(yr - my)) * 1.4826 as sy from s join m using (pair, seg) group by 1, 2),
pr as (select pair, seg, t, xr, yr, n, row_number() over (partition by pair, seg order by t) - 1 as i, (xr - mx) / sx as x, (yr - my) / sy as y from s join d using (pair, seg)),
nx as (select *, lead(x) over (partition by pair, seg order by i) as x1, lead(y) over (partition by pair, seg order by i) as y1 from pr),
wn as (select pair, seg, unnest(range(cast(floor((n - 24) / 4) as bigint) + 1)) as win from (select pair, seg, any_value(n) as n from pr group by 1, 2) where n >= 24),
lg as (select unnest(range(-3, 4)) as lag),
c0 as (select w.pair, w.seg, w.win, l.lag, a.x, c.y, case when a.i + 1 < w.win * 4 + 24 and c.i + 1 < w.win * 4 + 24 then a.x1 - a.x end as dx,
         case when a.i + 1 < w.win * 4 + 24 and c.i + 1 < w.win * 4 + 24 then c.y1 - c.y end as dy
       from wn w cross join lg l join nx a on a.pair = w.pair and a.seg = w.seg and a.i between w.win * 4 and w.win * 4 + 23
       join nx c on c.pair = w.pair and c.seg = w.seg and c.i = a.i + l.lag and c.i between w.win * 4 and w.win * 4 + 23),
co as (select pair, seg, win, cast(lag as int) as lag, count(*) as n,
         coalesce(round(case when count(*) >= 10 then (avg(x * y) - avg(x) * avg(y)) / nullif(sqrt((avg(x * x) - avg(x) * avg(x)) * (avg(y * y) - avg(y) * avg(y))), 0) end, 9), 0) as shape_corr,
         coalesce(round(case when count(dx) >= 9 then (avg(dx * dy) - avg(dx) * avg(dy)) / nullif(sqrt((avg(dx * dx) - avg(dx) * avg(dx)) * (avg(dy * dy) - avg(dy) * avg(dy))), 0) end, 9), 0) as trend_corr
       from c0 group by 1, 2, 3, 4)
"""


@query("prepared_pairs", PREP + "select pair, seg, i, t, xr, yr, round(x, 8) as x, round(y, 8) as y from pr")
def prepared_pairs(spark, folder):
    return prepared(spark, folder).select("pair", "seg", "i", "t", "xr", "yr", F.round("x", 8).alias("x"), F.round("y", 8).alias("y"))


@query("lag_corr_windows", PREP + "select pair, seg, win, lag, n, shape_corr, trend_corr from co")
def lag_corr_windows(spark, folder):
    return consistency.lag_correlations(prepared(spark, folder), GROUP, CONFIG)


FITTED = PREP + """,
bl as (select pair, seg, win, lag from (select *, row_number() over (partition by pair, seg, win order by shape_corr desc, lag) as rk from co where seg = 'train') where rk = 1),
lm as (select pair, median(lag::double) as med from bl group by 1),
ld as (select pair, any_value(med) as med, median(abs(lag - med)) as mad from bl join lm using (pair) group by 1),
lc as (select pair, cast(round_even(med, 0) as int) as lag_center, mad as lag_mad, cast(greatest(-3, round_even(med, 0) - greatest(1, ceil(3 * greatest(1, mad)))) as int) as lag_low,
         cast(least(3, round_even(med, 0) + greatest(1, ceil(3 * greatest(1, mad)))) as int) as lag_high from ld),
rs as (select a.pair, a.xr - c.yr as residual from pr a join lc using (pair) join pr c on c.pair = a.pair and c.seg = a.seg and c.i = a.i + lag_center where a.seg = 'train'),
rm as (select pair, median(residual) as residual_median from rs group by 1),
rt as (select pair, any_value(residual_median) as residual_median, quantile_cont(abs(residual - residual_median), 0.9) as residual_threshold from rs join rm using (pair) group by 1),
lim as (select * from lc join rt using (pair)),
ch as (select co.* from co join lim using (pair) where lag between lag_low and lag_high),
bs as (select pair, seg, win, lag, n, shape_corr, trend_corr from (select *, row_number() over (partition by pair, seg, win order by shape_corr desc, lag) as rk from ch) where rk = 1),
fl as (select bs.*, a.i, abs(a.xr - c.yr - residual_median) > greatest(1e-9, residual_threshold) as off from bs join lim using (pair)
       join pr a on a.pair = bs.pair and a.seg = bs.seg and a.i between win * 4 and win * 4 + 23
       join pr c on c.pair = bs.pair and c.seg = bs.seg and c.i = a.i + bs.lag and c.i between win * 4 and win * 4 + 23),
fg as (select *, row_number() over w - sum(off::int) over w as g from fl window w as (partition by pair, seg, win order by i)),
st as (select pair, seg, win, g, count(*) filter (off) as s, count(*) as c, any_value(lag) as lag, any_value(n) as n, any_value(shape_corr) as sc, any_value(trend_corr) as tc from fg group by 1, 2, 3, 4),
ps as (select pair, seg, win, max(s) as longest_streak, sum(s) / sum(c) as exceedance_ratio, any_value(lag) as best_lag, 1 - any_value(sc) as d_shape, 1 - any_value(tc) as d_trend, any_value(n) as n from st group by 1, 2, 3),
pz as (select *, case when longest_streak >= 2 then 1.0 else 0.0 end as d_res from ps where n >= 10),
pw as (select *, round((0.5 * d_shape + 0.35 * d_trend + 0.15 * d_res) / (0.5::double + 0.35::double + 0.15::double), 12) as pair_score from pz),
th as (select pair, max(pair_score) as pair_threshold, count(*) as training_windows from pw where seg = 'train' group by 1),
sy as (select seg, win, round(avg(pair_score), 12) as system_score, string_agg(pair, '|' order by pair_score desc, pair) as top_pairs, count(*) as available_pairs,
         count(*) filter (d_res > 0 or pair_score > pair_threshold) as pair_alarms from pw join th using (pair) group by 1, 2),
tt as (select max(system_score) as system_threshold from sy where seg = 'train')
"""


@query(
    "pair_calibration",
    FITTED + """select pair, lag_center, round(lag_mad, 7) as lag_mad, lag_low, lag_high, round(residual_median, 6) as residual_median, round(residual_threshold, 6) as residual_threshold,
    pair_threshold, training_windows from lim join th using (pair)""",
)
def pair_calibration(spark, folder):
    model = consistency.fit(prepared(spark, folder).where(F.col("seg") == "train"), GROUP, "pair", CONFIG)
    return model.pairs.select(
        "pair", "lag_center", F.round("lag_mad", 7).alias("lag_mad"), "lag_low", "lag_high", F.round("residual_median", 6).alias("residual_median"),
        F.round("residual_threshold", 6).alias("residual_threshold"), "pair_threshold", "training_windows",
    )


@query(
    "pair_scores",
    FITTED + "select pair, seg, win, best_lag, n, round(d_shape, 9) as d_shape, round(d_trend, 9) as d_trend, d_res::double as d_res, longest_streak, round(exceedance_ratio, 9) as exceedance_ratio, pair_score from pw",
)
def pair_scores(spark, folder):
    rows = prepared(spark, folder)
    model = consistency.fit(rows.where(F.col("seg") == "train"), GROUP, "pair", CONFIG)
    out = consistency.pair_windows(rows, GROUP, "pair", model.pairs, CONFIG)
    return out.select(
        "pair", "seg", "win", "best_lag", "n", "d_res", "longest_streak", "pair_score",
        *[F.round(c, 9).alias(c) for c in ("d_shape", "d_trend", "exceedance_ratio")],
    )


def _system(spark, folder):
    rows = prepared(spark, folder)
    model = consistency.fit(rows.where(F.col("seg") == "train"), GROUP, "pair", CONFIG)
    out = consistency.score(rows, GROUP, "pair", model)
    # The benign maximum is the published threshold; a lower one makes events visible.
    return out.withColumn("system_threshold", F.lit(model.system_threshold * 0.8))


ALARMS = FITTED + """,
gt as (select sy.*, system_threshold * 0.8 as lim, system_score > system_threshold * 0.8 as above from sy cross join tt),
gr as (select *, win - sum(above::int) over (partition by seg order by win) as g from gt),
gc as (select *, case when above then count(*) filter (above) over (partition by seg, g order by win) else 0 end as consecutive_count from gr),
ga as (select *, consecutive_count >= 2 as alarm_flag from gc)
"""


@query(
    "system_alarms",
    ALARMS + "select seg, win, system_score, top_pairs, available_pairs, pair_alarms, consecutive_count, alarm_flag from ga",
)
def system_alarms(spark, folder):
    gated = consistency.gate(_system(spark, folder), ["seg"], CONFIG)
    return gated.select(
        "seg", "win", "system_score", "top_pairs", "available_pairs", "pair_alarms", "consecutive_count", "alarm_flag"
    )


@query(
    "alarm_events",
    ALARMS + """, pv as (select *, lag(alarm_flag) over (partition by seg order by win) as pf from ga),
    ru as (select *, sum(case when alarm_flag and not coalesce(pf, false) then 1 else 0 end) over (partition by seg order by win) as run from pv),
    nm as (select seg, run, p, min(win * 10 + k) as f from (select seg, run, win, unnest(string_split(top_pairs, '|')) as p, unnest(range(len(string_split(top_pairs, '|')))) as k from ru where alarm_flag) group by 1, 2, 3),
    nl as (select seg, run, string_agg(p, '|' order by f) as contributing_pairs from nm group by 1, 2)
    select seg, min(win) as alarm_start, max(win + 1) as alarm_end, max(system_score) as max_score, count(*) as windows, any_value(contributing_pairs) as contributing_pairs
    from ru join nl using (seg, run) where alarm_flag group by seg, run""",
)
def alarm_events(spark, folder):
    gated = consistency.gate(_system(spark, folder), ["seg"], CONFIG).withColumn("next_win", F.col("win") + 1)
    return consistency.alarm_events(gated, ["seg"], "win", "win", "next_win")


@query(
    "longest_streaks",
    """with s as (select user_id, event_type in ('click', 'view') as f, row_number() over (partition by user_id order by ts, event_id) as rn from events),
    g as (select *, rn - sum(f::int) over (partition by user_id order by rn) as g from s),
    r as (select user_id, g, count(*) filter (f) as c from g group by 1, 2) select user_id, max(c) as longest from r group by 1""",
)
def longest_streaks(spark, folder):
    ev = events(spark, folder, "event_id", "user_id", "event_type").withColumn("f", F.col("event_type").isin("click", "view"))
    return consistency.longest_streaks(ev, ["user_id"], ["ts_us", "event_id"], "f")


INTERVALS = """
with iv as (select d as attack_id, (d * 5 + 2) * 86400000000 + 1704067200000000 as s, (d * 5 + 2) * 86400000000 + 1704067200000000 + 20000000000 + d * 1000000000 as e from (select distinct user_id % 6 as d from events)),
al as (select distinct epoch_us(ts) as t from events where event_type = 'error' and value > 300)
"""


def intervals(spark, folder):
    """Six labelled spans whose ids come from the user table."""
    ids = events(spark, folder, "user_id").select((F.col("user_id") % 6).alias("attack_id")).distinct()
    start = (F.col("attack_id") * 5 + 2) * DAY + 1704067200000000
    return ids.withColumn("s", start).withColumn("e", start + 20000000000 + F.col("attack_id") * 1000000000)


def alarm_points(spark, folder):
    ev = events(spark, folder, "event_id", "event_type", "value")
    return ev.where((F.col("event_type") == "error") & (F.col("value") > 300))


EXPOSURE = INTERVALS + ", ex as (select attack_id, s, e, min(t) as f from iv left join al on t >= s and t < e group by 1, 2, 3)"


@query("exposure_tte", EXPOSURE + "select attack_id, s, e, f is not null as exposed, f - s as tte from ex")
def exposure_tte(spark, folder):
    return metrics.exposure(alarm_points(spark, folder), intervals(spark, folder), "ts_us", ["attack_id"], "s", "e")


@query(
    "exposure_summary",
    EXPOSURE + "select count(*) as attacks, count(f) as exposed_count, round(avg((f is not null)::int), 9) as aer, round(avg(f - s), 3) as tte_mean, min(f - s) as tte_min, max(f - s) as tte_max, round(median(f - s), 3) as tte_median from ex",
)
def exposure_summary(spark, folder):
    out = metrics.exposure_summary(exposure_tte(spark, folder), [])
    return out.select(
        "attacks", "exposed_count", F.round("aer", 9).alias("aer"), F.round("tte_mean", 3).alias("tte_mean"), "tte_min", "tte_max", F.round("tte_median", 3).alias("tte_median")
    )


LABELLED = INTERVALS + """,
pt as (select event_id, user_id, epoch_us(ts) as t, value > 350 as p, event_type from events),
lb as (select pt.*, exists (select 1 from iv where t >= s and t < e) as a from pt)
"""


def labelled(spark, folder):
    ev = events(spark, folder).withColumn("p", F.col("value") > 350)
    return metrics.label_times(ev, "ts_us", intervals(spark, folder), "s", "e", "a")


CONF = "count(*) filter (p and a) as tp, count(*) filter (p and not a) as fp, count(*) filter (not p and not a) as tn, count(*) filter (not p and a) as fn"
RATES = """, precision, recall, (tp + tn) / (tp + fp + tn + fn) as accuracy, case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end as f1"""
RATED = """, r as (select *, case when tp + fp = 0 then 0 else tp / (tp + fp) end as precision, case when tp + fn = 0 then 0 else tp / (tp + fn) end as recall from c)"""


def _round_rates(df, *columns):
    return df.select(*columns, "tp", "fp", "tn", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "accuracy", "f1")])


ROUND_RATES = "tp, fp, tn, fn, round(precision, 9) as precision, round(recall, 9) as recall, round(accuracy, 9) as accuracy, round(f1, 9) as f1"


@query("point_confusion", LABELLED + f", c as (select event_type, {CONF} from lb group by 1)" + RATED + f", q as (select event_type, tp, fp, tn, fn {RATES} from r) select event_type, {ROUND_RATES} from q")
def point_confusion(spark, folder):
    return _round_rates(metrics.confusion(labelled(spark, folder), ["event_type"], F.col("p"), F.col("a")), "event_type")


@query(
    "confusion_rollup",
    LABELLED + f""", g as (select event_type, user_id % 3 as stage, {CONF} from lb group by 1, 2),
    c as (select event_type, stage, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(tn) as bigint) as tn, cast(sum(fn) as bigint) as fn,
           cast(grouping(event_type) * 2 + grouping(stage) as int) as level from g group by rollup (event_type, stage))""" + RATED
    + f", q as (select event_type, stage, level, tp, fp, tn, fn {RATES} from r) select event_type, stage, level, {ROUND_RATES} from q",
)
def confusion_rollup(spark, folder):
    rows = labelled(spark, folder).withColumn("stage", F.col("user_id") % 3)
    counts = metrics.confusion(rows, ["event_type", "stage"], F.col("p"), F.col("a")).select("event_type", "stage", "tp", "fp", "tn", "fn")
    return _round_rates(metrics.rollup_counts(counts, ["event_type", "stage"]), "event_type", "stage", "level")


@query(
    "label_confusion",
    """with c as (select source, count(*) filter (n_chars > 400 and quality = 1) as tp, count(*) filter (n_chars > 400 and quality = 0) as fp, count(*) filter (n_chars <= 400 and quality = 0) as tn,
      count(*) filter (n_chars <= 400 and quality = 1) as fn from documents join labels using (doc_id) group by 1)""" + RATED
    + f", q as (select source, tp, fp, tn, fn {RATES} from r) select source, {ROUND_RATES} from q",
)
def label_confusion(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "n_chars").join(table(spark, folder, "labels"), "doc_id")
    return _round_rates(metrics.confusion(docs, ["source"], F.col("n_chars") > 400, F.col("quality") == 1), "source")


TRACE = LABELLED + """,
tr as (select t // 1800000000 as window_id, bool_or(a) as has_attack, bool_or(not a and ig) as has_ignored, bool_or(not a and not ig) as has_clean, bool_or(p) as has_alert,
        bool_or(p and a) as has_attack_alert, bool_or(p and not a and not ig) as has_clean_alert, min(case when p then t end) as first_alert, min(case when p and a then t end) as first_attack_alert
       from (select *, t >= 1706400000000000 as ig from lb) group by 1)
"""


def _trace(spark, folder):
    ignored = F.col("ts_us") >= 1706400000000000
    return metrics.window_trace(labelled(spark, folder), [], "ts_us", 1800000000, F.col("p"), F.col("a"), ignored)


@query("window_trace", TRACE + "select * from tr")
def window_trace(spark, folder):
    return _trace(spark, folder)


@query(
    "window_confusion",
    TRACE + """select count(*) as windows, count(*) filter (has_attack) as attack_windows, count(*) filter (not has_attack and has_ignored) as ignored_windows,
    count(*) filter (has_attack and has_attack_alert) as tp, count(*) filter (has_attack and not has_attack_alert) as fn, count(*) filter (not has_attack and not has_ignored and has_clean_alert) as fp,
    count(*) filter (not has_attack and not has_ignored and not has_clean_alert) as tn, count(*) filter (not has_attack and has_ignored and has_alert) as alerted_ignored from tr""",
)
def window_confusion(spark, folder):
    return metrics.window_counts(_trace(spark, folder), [])


@query(
    "window_merge",
    LABELLED + """, w as (select user_id % 4 as task, t // 21600000000 as win, bool_or(p) as alarm, case when bool_or(a) then 'attack' when min(t) >= 1706400000000000 then 'ignored' else 'clean' end as label from lb group by 1, 2)
    select win, bool_or(alarm) as alarm, count(*) as tasks, case max(case label when 'attack' then 2 when 'clean' then 1 else 0 end) when 2 then 'attack' when 1 then 'clean' else 'ignored' end as label from w group by 1""",
)
def window_merge(spark, folder):
    rows = labelled(spark, folder).groupBy((F.col("user_id") % 4).alias("task"), F.floor(F.col("ts_us") / 21600000000).alias("win"))
    per = rows.agg(
        F.bool_or("p").alias("alarm"),
        F.when(F.bool_or("a"), "attack").when(F.min("ts_us") >= 1706400000000000, "ignored").otherwise("clean").alias("label"),
    )
    return metrics.merge_windows(per, ["win"], "label", "alarm")


@query(
    "point_rising_edge",
    """with s as (select user_id, epoch_us(ts) as t, value > 300 as f, lag(value > 300) over (partition by user_id order by ts, event_id) as pf from events)
    select user_id, min(case when f and not coalesce(pf, false) and t >= 1704800000000000 and t < 1706000000000000 then t - 1704800000000000 end) as tte from s group by 1""",
)
def point_rising_edge(spark, folder):
    ev = events(spark, folder, "event_id", "user_id", "value").withColumn("f", F.col("value") > 300)
    return metrics.first_rising_edge(ev, ["user_id"], ["ts_us", "event_id"], "ts_us", "f", F.lit(1704800000000000), F.lit(1706000000000000))


@query(
    "sample_rates",
    """with c as (select event_type, count(*) filter (user_id % 2 = 0 and value <= 350) as train_normal, count(*) filter (user_id % 2 = 0 and value > 350) as train_alarm,
      count(*) filter (user_id % 2 = 1 and value > 350 and event_id % 5 = 0) as tp, count(*) filter (user_id % 2 = 1 and value > 350 and event_id % 5 <> 0) as fp,
      count(*) filter (user_id % 2 = 1 and value <= 350 and event_id % 5 <> 0) as tn, count(*) filter (user_id % 2 = 1 and value <= 350 and event_id % 5 = 0) as fn from events group by 1),
    v as (select *, train_normal / (train_normal + train_alarm) as tacc, 0.5 * (tn / (tn + fp) + tp / (tp + fn)) as vacc from c)
    select event_type, tp, fp, tn, fn, round(tacc, 9) as tacc, round(vacc, 9) as vacc, round(0.5 * (tacc + vacc), 9) as bacc from v""",
)
def sample_rates(spark, folder):
    ev = events(spark, folder)
    hit, attack, train = F.col("value") > 350, F.col("event_id") % 5 == 0, F.col("user_id") % 2 == 0
    counts = ev.groupBy("event_type").agg(
        F.count_if(train & ~hit).alias("train_normal"), F.count_if(train & hit).alias("train_alarm"), F.count_if(~train & hit & attack).alias("tp"),
        F.count_if(~train & hit & ~attack).alias("fp"), F.count_if(~train & ~hit & ~attack).alias("tn"), F.count_if(~train & ~hit & attack).alias("fn"),
    )
    out = metrics.balanced(counts, "train_normal", "train_alarm")
    return out.select("event_type", "tp", "fp", "tn", "fn", *[F.round(c, 9).alias(c) for c in ("tacc", "vacc", "bacc")])


@query(
    "best_parameters",
    """with c as (select event_type, th, count(*) filter (value > th and event_id % 5 = 0) as tp, count(*) filter (value > th and event_id % 5 <> 0) as fp,
      count(*) filter (value <= th and event_id % 5 <> 0) as tn, count(*) filter (value <= th and event_id % 5 = 0) as fn from events cross join (select unnest([100, 200, 300, 400]) as th) group by 1, 2),
    v as (select *, round(0.5 * (tn / (tn + fp) + tp / (tp + fn)), 9) as bacc from c)
    select event_type, cast(th as int) as th, tp, fp, tn, fn, bacc from (select *, row_number() over (partition by event_type order by bacc desc, th) as rk from v) where rk = 1""",
)
def best_parameters(spark, folder):
    ev = events(spark, folder, "event_id", "event_type", "value").withColumn("th", F.explode(F.array(*[F.lit(t) for t in (100, 200, 300, 400)])))
    counts = metrics.confusion(ev, ["event_type", "th"], F.col("value") > F.col("th"), F.col("event_id") % 5 == 0)
    vacc = 0.5 * (metrics.ratio(F.col("tn"), F.col("tn") + F.col("fp")) + metrics.ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    rows = counts.select("event_type", "th", "tp", "fp", "tn", "fn", F.round(vacc, 9).alias("bacc"))
    return metrics.best_parameters(rows, ["event_type"], "th")


@query(
    "duration_sweep",
    INTERVALS + """, sc as (select attack_id, s, e, x.scale, cast(least(e, floor(s + (e - s) * x.scale)) as bigint) as effective_end from iv cross join (select unnest([0.25, 0.5, 1.0, 2.0]::double[]) as scale) x)
    select attack_id, s, e, scale, effective_end, count(epoch_us(ts)) as points from sc left join events on epoch_us(ts) >= s and epoch_us(ts) < effective_end group by 1, 2, 3, 4, 5""",
)
def duration_sweep(spark, folder):
    rows = metrics.scaled_windows(intervals(spark, folder), "s", "e", [0.25, 0.5, 1.0, 2.0])
    return sweep.totals_in_windows(events(spark, folder, "event_id"), rows, [], "ts_us", "s", "effective_end", {"points": F.lit(1)})


@query(
    "fit_metrics",
    """with p as (select l_returnflag, l_linestatus, l_quantity as p, l_tax * 100 as t from lineitem),
    m as (select l_returnflag, l_linestatus, count(*) as n, avg((p - t) * (p - t)) as mse, avg(abs(p - t)) as mae, sum((p - t) * (p - t)) as res, var_pop(t) * count(*) as tot,
      avg(abs((t - p) / t)) filter (t <> 0) * 100 as mape from p group by 1, 2)
    select l_returnflag, l_linestatus, n, round(mse, 6) as mse, round(sqrt(mse), 6) as rmse, round(mae, 6) as mae, round(1 - res / tot, 6) as r2, round(mape, 6) as mape from m""",
)
def fit_metrics(spark, folder):
    rows = table(spark, folder, "lineitem").withColumn("t", F.col("l_tax") * 100)
    out = metrics.fit_metrics(rows, ["l_returnflag", "l_linestatus"], "l_quantity", "t")
    return out.select("l_returnflag", "l_linestatus", "n", *[F.round(c, 6).alias(c) for c in ("mse", "rmse", "mae", "r2", "mape")])


@query(
    "alarm_hold",
    """with s as (select event_id, user_id, epoch_us(ts) as t, value > 400 as f from events),
    h as (select event_id, t, max(case when f then t end) over (partition by user_id order by t, event_id) as last from s)
    select event_id, coalesce(t - last <= 172800000000, false) as held from h""",
)
def alarm_hold(spark, folder):
    ev = events(spark, folder, "event_id", "user_id", "value").withColumn("f", F.col("value") > 400)
    return fusion.hold(ev, ["user_id"], ["ts_us", "event_id"], "ts_us", "f", 172800000000).select("event_id", "held")


FUSE = """
with p as (select user_id, epoch_us(ts) as t, max(case when event_type = 'click' then value > 300 end) as a, max(case when event_type = 'view' then value > 300 end) as b, max(case when event_type = 'error' then value > 300 end) as c
   from events group by 1, 2),
f as (select user_id, t, last_value(a ignore nulls) over w as a, last_value(b ignore nulls) over w as b, last_value(c ignore nulls) over w as c from p window w as (partition by user_id order by t)),
v as (select user_id, t as ts_us, a::int + b::int + c::int as votes from f where a is not null and b is not null and c is not null)
"""


def _fused(spark, folder, votes):
    ev = events(spark, folder, "event_id", "user_id", "event_type", "value").withColumn("alarm", F.col("value") > 300)
    return fusion.fuse(ev, ["user_id"], "ts_us", "event_type", "alarm", ["click", "view", "error"], votes, "event_id")


@query("or_fusion", FUSE + "select user_id, ts_us, votes, votes >= 1 as fused from v")
def or_fusion(spark, folder):
    return _fused(spark, folder, 1)


@query("vote_fusion", FUSE + "select user_id, ts_us, votes, votes >= 2 as fused from v")
def vote_fusion(spark, folder):
    return _fused(spark, folder, 2)


EVIDENCE = """
with e as (select epoch_us(ts) // 21600000000 * 21600000000 as window_start, event_type, value > 470 as alarm, value / 440 as r from events),
w as (select window_start, count(distinct case when alarm then event_type end) as channels, max(case when r >= 1 then r end) as max_ratio from e group by 1),
o as (select epoch_us(ts) // 21600000000 * 21600000000 as window_start, bool_or(event_type = 'signup' and value > 480) as other from events group by 1)
"""


def _evidence(spark, folder):
    ev = events(spark, folder, "event_type", "value").withColumn("alarm", F.col("value") > 470).withColumn("r", F.col("value") / 440)
    found = fusion.window_evidence(ev, [], "ts_us", 21600000000, "event_type", "alarm", "r")
    other = ev.groupBy((F.floor(F.col("ts_us") / 21600000000) * 21600000000).alias("window_start")).agg(
        F.bool_or((F.col("event_type") == "signup") & (F.col("value") > 480)).alias("other")
    )
    return found.join(other, "window_start")


@query(
    "hybrid_rules",
    EVIDENCE + """select window_start, channels, round(max_ratio, 9) as max_ratio, channels > 0 or other as rule_or, other or channels >= 3 as rule_gated, other or coalesce(max_ratio, 0) >= 1.1 as rule_confident,
    coalesce(max_ratio, 0) >= 1.1 or (coalesce(max_ratio, 0) >= 1.05 and (other or channels >= 3)) as rule_vote from w join o using (window_start)""",
)
def hybrid_rules(spark, folder):
    out = fusion.hybrid(_evidence(spark, folder), "other", 1.05, 1.1, 3).drop("other")
    return out.withColumn("max_ratio", F.round("max_ratio", 9))


@query(
    "asymmetric_votes",
    """with r as (select epoch_us(ts) // 21600000000 as win, max(value) filter (event_type = 'click') / 460 as sup, max(value) filter (event_type = 'view') / 460 as ctrl, max(value) filter (event_type = 'error') / 470 as joint,
      bool_or(event_type = 'signup' and value > 480) as other from events group by 1),
    v as (select win, other, coalesce(sup, 0) as s, coalesce(ctrl, 0) as c, coalesce(joint, 0) as j from r),
    k as (select *, (s >= 0.95)::int + (c >= 0.95)::int + 2 * (j >= 0.95)::int as votes, greatest(s, c, j, 0) as top from v)
    select win, votes, top >= 1.05 or (top >= 0.95 and (other or votes >= 3)) as predicted from k""",
)
def asymmetric_votes(spark, folder):
    ev = events(spark, folder, "event_type", "value")
    kind, value = F.col("event_type"), F.col("value")
    rows = ev.groupBy(F.floor(F.col("ts_us") / 21600000000).alias("win")).agg(
        (F.max(F.when(kind == "click", value)) / 460).alias("sup"), (F.max(F.when(kind == "view", value)) / 460).alias("ctrl"),
        (F.max(F.when(kind == "error", value)) / 470).alias("joint"), F.bool_or((kind == "signup") & (value > 480)).alias("other"),
    )
    return fusion.asymmetric(rows, "other", 0.95, 1.05, 3, 2).select("win", "votes", "predicted")


@query(
    "subset_vote_search",
    """with h as (select user_id, event_type, min(case when value > 430 and epoch_us(ts) < 1704500000000000 then epoch_us(ts) end) as pre,
       min(case when value > 430 and epoch_us(ts) >= 1704500000000000 and epoch_us(ts) < 1705500000000000 then epoch_us(ts) end) as atk from events where event_type in ('click', 'view', 'error') group by 1, 2),
    mk as (select unnest(range(1, 8)) as mask), vt as (select mask, unnest(range(1, bit_count(cast(mask as int)) + 1)) as vote from mk),
    i as (select user_id, mask, vote, count(pre) >= vote as early, count(atk) >= vote as hit, list_sort(list(atk) filter (atk is not null)) as l
          from h join vt on (case event_type when 'click' then 1 when 'view' then 2 else 4 end & mask) <> 0 group by 1, 2, 3),
    al as (select u.user_id, vt.mask, vt.vote from (select distinct user_id from h) u cross join vt),
    z as (select al.*, coalesce(early, false) as early, coalesce(hit, false) as hit, l[cast(al.vote as int)] - 1704500000000000 as tte from al left join i using (user_id, mask, vote)),
    c as (select mask, vote, count(*) filter (hit) as tp, count(*) filter (early) as fp, count(*) filter (not early) as tn, count(*) filter (not hit) as fn, count(*) filter (hit and not early) as strict_tp,
            avg(tte) filter (hit) as tte_mean, count(*) as instances from z group by 1, 2),
    r as (select *, case when tp + fp = 0 then 0 else tp / (tp + fp) end as pr, case when tp + fn = 0 then 0 else tp / (tp + fn) end as rc from c)
    select cast(mask as int) as mask, cast(vote as int) as vote, tp, fp, tn, fn, strict_tp, instances, round(tte_mean, 3) as tte_mean, round(case when pr + rc = 0 then 0 else 2 * pr * rc / (pr + rc) end, 9) as f1,
      round(strict_tp / instances, 9) as strict_aer from r""",
)
def subset_vote_search(spark, folder):
    channels = ["click", "view", "error"]
    ev = events(spark, folder, "user_id", "event_type", "value").where(F.col("event_type").isin(channels))
    start, end, t = 1704500000000000, 1705500000000000, F.col("ts_us")
    high = F.col("value") > 430
    hits = ev.groupBy("user_id", "event_type").agg(
        F.min(F.when(high & (t < start), t)).alias("pre"), F.min(F.when(high & (t >= start) & (t < end), t)).alias("attack")
    ).withColumn("t0", F.lit(start))
    out = fusion.subset_votes(hits, "user_id", "event_type", "pre", "attack", "t0", channels)
    return out.withColumn("tte_mean", F.round("tte_mean", 3)).withColumn("f1", F.round("f1", 9)).withColumn("strict_aer", F.round("strict_aer", 9))


@query(
    "alarm_seconds",
    """with a as (select epoch_us(ts) // 3600000000 as h, count(distinct event_type) as channels from events where value > 400 group by 1) select channels, count(*) as seconds from a group by 1""",
)
def alarm_seconds(spark, folder):
    ev = events(spark, folder, "event_type", "value").where(F.col("value") > 400)
    return fusion.clean_alarm_seconds(ev, "event_type", "ts_us", 3_600_000_000)


FLOW_COLUMNS = [f"{side}_{s}" for side in ("all", "fwd", "bwd") for s in features.STATS]


def _flow_sql():
    out = []
    for name, flag in (("all", "true"), ("fwd", "fwd"), ("bwd", "not fwd")):
        gap = f"(t - g_{name}) / 1000.0"
        size, f = "q", f"filter ({flag})"
        vals = [
            f"(max(t) {f} - min(t) {f}) / 1000.0", f"count(*) {f}", f"sum({size}) {f}", f"min({size}) {f}", f"avg({size}) {f}", f"max({size}) {f}", f"stddev_pop({size}) {f}",
            f"min({gap}) {f}", f"avg({gap}) {f}", f"max({gap}) {f}", f"stddev_pop({gap}) {f}",
        ]
        out += [f"round(coalesce({v}, 0)::double, 2) as {name}_{s}" for s, v in zip(features.STATS, vals)]
    return ", ".join(out)


@query(
    "flow_features33",
    f"""with p as (select least(l_partkey % 40, l_suppkey % 40) as a, greatest(l_partkey % 40, l_suppkey % 40) as b, l_partkey % 40 <= l_suppkey % 40 as fwd, epoch_us(l_shipdate) as t, l_quantity as q,
        l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount > 0.09 as lab from lineitem),
    g as (select *, lag(t) over (partition by a, b order by t, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as g_all,
        lag(t) over (partition by a, b, fwd order by t, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as g_fwd from p),
    h as (select *, g_fwd as g_bwd from g)
    select a, b, {_flow_sql()}, bool_or(lab) as label, round((min(t) + max(t)) / 2, 1) as mid_ts, coalesce(min(t) filter (lab), min(t)) as sample_ts from h group by a, b""",
)
def flow_features33(spark, folder):
    a, b = F.col("l_partkey") % 40, F.col("l_suppkey") % 40
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", micros("l_shipdate").alias("t"),
        F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), (a <= b).alias("fwd"),
    )
    order = ["t", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    out = features.flow_features(rows, ["a", "b"], order, "t", "l_quantity", F.col("fwd"), F.col("l_discount") > 0.09)
    return out.select("a", "b", *[F.round(c, 2).alias(c) for c in FLOW_COLUMNS], "label", F.round("mid_ts", 1).alias("mid_ts"), "sample_ts")


PACKET_SQL = """
with p as (select c_nationkey, c_custkey, c_acctbal > 5000 as lab, [c_custkey, c_nationkey, length(c_name), 3, 2048, length(c_name), c_custkey % 97]::double[] as head,
   list_concat([ascii(c_name[i])::double for i in range(1, length(c_name) + 1)], [0::double for i in range(100)]) as body from customer)
"""


def packets(spark, folder):
    return table(spark, folder, "customer").select(
        "c_nationkey", "c_custkey", (F.col("c_acctbal") > 5000).alias("lab"), F.col("c_name").cast("binary").alias("payload"), F.length("c_name").alias("size")
    )


def packet_header():
    return [F.col("c_custkey"), F.col("c_nationkey"), F.col("size"), F.lit(3), F.lit(2048), F.col("size"), F.col("c_custkey") % 97]


@query("packet_features64", PACKET_SQL + "select c_custkey, array_to_string([cast(x as int) for x in list_concat(head, body[1:57])], ',') as features from p")
def packet_features64(spark, folder):
    vector = features.packet_vector(packet_header(), F.col("payload"))
    return packets(spark, folder).select("c_custkey", F.array_join(F.transform(vector, lambda x: x.cast("int").cast("string")), ",").alias("features"))


@query(
    "sequence3_features",
    PACKET_SQL + """, v as (select c_nationkey, c_custkey, lab, list_concat(head, body[1:14]) as f from p),
    w as (select c_nationkey, row_number() over w - 1 as pos, list_concat(list_concat(f, lead(f) over w), lead(f, 2) over w) as f, lead(c_custkey, 2) over w as ts, lab or lead(lab) over w or lead(lab, 2) over w as label
          from v window w as (partition by c_nationkey order by c_custkey))
    select c_nationkey, pos, ts, array_to_string([cast(x as int) for x in f], ',') as features, label from w where ts is not null""",
)
def sequence3_features(spark, folder):
    out = features.sequence_vectors(packets(spark, folder), ["c_nationkey"], ["c_custkey"], packet_header(), F.col("payload"), "c_custkey", F.col("lab"))
    joined = F.array_join(F.transform("features", lambda x: x.cast("int").cast("string")), ",")
    return out.select("c_nationkey", "pos", "ts", joined.alias("features"), "label")


CENTER, RADIUS, COARSE, NEAR, FINE, TOLERANCE = 2_450_000, 3_000_000, 10_000, 50_000, 1_000, 3_600_000_000  # microseconds

OFFSET_SQL = """with h as (select event_type as pv, epoch_us(ts) as t, value as v from events where user_id % 2 = 0), r as (select event_type as pv, epoch_us(ts) as t, value as v from events where user_id % 2 = 1),
    sc as (select pv, greatest(stddev_samp(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.349, 1e-6) as s from h group by 1)"""


def _offset_sql(name: str, offsets: str) -> str:
    """Scores of the offsets that ``offsets`` selects, every row at every offset."""
    return f""", {name}_x as (select h.pv, h.t + "offset" as tgt, v as want, "offset", row_number() over () as id from h cross join ({offsets})),
    {name}_b as (select x.id, x.pv, x.want, x."offset", x.tgt, r.v as bv, r.t as bt from {name}_x x asof left join r on x.pv = r.pv and x.tgt >= r.t),
    {name}_f as (select x.id, r.v as fv, r.t as ft from {name}_x x asof left join r on x.pv = r.pv and x.tgt < r.t),
    {name}_m as (select b.pv, want, "offset", case when bt is null then fv when ft is null or tgt - bt <= ft - tgt then bv else fv end as got, case when bt is null then ft - tgt when ft is null or tgt - bt <= ft - tgt then tgt - bt else ft - tgt end as d
          from {name}_b b join {name}_f using (id)),
    {name}_s as (select "offset", pv, median(abs(got - want) / s) as score from {name}_m join sc using (pv) where d <= {TOLERANCE} group by 1, 2),
    {name} as (select "offset", list_avg(list(score order by pv)) as joint_score, count(*) as pvs from {name}_s group by 1)"""


COARSE_SQL = OFFSET_SQL + _offset_sql("coarse", f'select unnest(range({CENTER - RADIUS}, {CENTER + RADIUS + 1}, {COARSE})) as "offset"')
BEST_SQL = f'order by joint_score, abs("offset" - {CENTER}), "offset" limit 1'


def _offset_tables(spark, folder):
    ev = events(spark, folder).withColumnRenamed("event_type", "pv")
    even = F.col("user_id") % 2 == 0
    return ev.where(even), ev.where(~even), "pv", "ts_us", "value", "event_id"


def _offset_scores(tables, center, radius, step, prepared=None):
    return calibration.offset_scores(*tables, *calibration.grid(center, radius, step), TOLERANCE, prepared)


@query("offset_calibration", COARSE_SQL + ' select "offset", round(joint_score, 8) as joint_score, pvs from coarse')
def offset_calibration(spark, folder):
    """The coarse grid: 601 offsets in steps of a hundredth of a second."""
    return _offset_scores(_offset_tables(spark, folder), CENTER, RADIUS, COARSE).withColumn("joint_score", F.round("joint_score", 8))


@query(
    "offset_choice",
    COARSE_SQL
    + f', best as (select "offset" as c from coarse {BEST_SQL})'
    + _offset_sql("fine", f'select unnest(range(c - {NEAR}, c + {NEAR + 1}, {FINE})) as "offset" from best')
    + f' select "offset", round(joint_score, 8) as joint_score from fine {BEST_SQL}',
)
def offset_choice(spark, folder):
    """Coarse search, then one in steps of a thousandth of a second around its best offset."""
    tables = _offset_tables(spark, folder)
    prepared = calibration.prepare(*tables, TOLERANCE, CENTER - RADIUS - NEAR, CENTER + RADIUS + NEAR)  # once for both searches
    coarse = calibration.best_offset(_offset_scores(tables, CENTER, RADIUS, COARSE, prepared), CENTER).first()
    center = coarse["offset"] if coarse["offset"] is not None else CENTER
    fine = calibration.best_offset(_offset_scores(tables, center, NEAR, FINE, prepared), CENTER)
    return fine.withColumn("joint_score", F.round("joint_score", 8))


PERTURB = """
with p as (select event_type, epoch_us(ts) // 86400000000 as d, avg(value) as v from events group by 1, 2),
w as (select row_number() over (order by d) - 1 as i, d, round(max(v) filter (event_type = 'click'), 6) as level, round(max(v) filter (event_type = 'view'), 6) as valve from p group by d),
st as (select i as start, row_number() over (order by i) as n from w where i in (12, 18)),
x as (select 'test_' || lpad(n::varchar, 2, '0') as split, start, i, d, case when i >= start then [10.0, 20.5, 30.25][cast(least(i - start, 2) + 1 as int)] else level end::double as level,
   case when i >= start then round_even([1.4, 0.2, 1.6][cast(least(i - start, 2) + 1 as int)]::double, 0) else valve end::double as valve, i >= start as malicious from w cross join st)
"""


def _perturbed(spark, folder):
    ev = events(spark, folder, "event_type", "value").withColumn("d", F.floor(F.col("ts_us") / DAY))
    daily = ev.groupBy("event_type", "d").agg(F.avg("value").alias("v"))
    kind = F.col("event_type")
    wide = daily.groupBy("d").agg(
        F.round(F.max(F.when(kind == "click", F.col("v"))), 6).alias("level"), F.round(F.max(F.when(kind == "view", F.col("v"))), 6).alias("valve")
    )
    rows = Ordered(wide, [], ["d"]).with_row_number("i").frame()
    starts = rows.where(F.col("i").isin(12, 18)).select(F.col("i").alias("start"))
    tails = {"level": perturb.tail_template([10.0, 20.5, 30.25]), "valve": perturb.tail_template([1.4, 0.2, 1.6])}
    return perturb.overwrite_tails(rows, starts, "i", tails, ["valve"])


@query("label_perturbation", PERTURB + "select * from x")
def label_perturbation(spark, folder):
    return _perturbed(spark, folder)


@query(
    "injection_log",
    PERTURB + "select split, start, min(d) filter (malicious) as start_ts, max(d) filter (malicious) as last_ts, max(i) filter (malicious) + 1 as end_exclusive, count(*) filter (malicious) as rows, 'level|valve' as injected from x group by 1, 2",
)
def injection_log(spark, folder):
    return perturb.label_log(_perturbed(spark, folder), "i", "d", ["level", "valve"])


@query("sampled_starts")
def sampled_starts(spark, folder):
    ev = Ordered(events(spark, folder, "event_id"), [], ["ts_us", "event_id"]).with_row_number("i").frame()
    return perturb.sample_starts(ev, "i", 100, 900, 5, 7)


def channel_series(spark, folder):
    ev = events(spark, folder, "event_type", "value")
    hourly = resample.resample(ev, ["event_type"], "ts_us", "value", HOURS3, "mean", "linear")
    rows = Ordered(hourly, ["event_type"], ["t"]).with_row_number("i").frame()
    return rows.select(F.col("event_type").alias("channel"), "i", "t", "v")


@query("subspace_scores")
def subspace_scores(spark, folder):
    out = subspace.detect(channel_series(spark, folder), "channel", 24, 3, ["t"])
    return out.select("channel", "i", "t", "part", F.round("score", 5).alias("score"), F.round("threshold", 5).alias("threshold"), "alarm")


@query("subspace_first_alarms")
def subspace_first_alarms(spark, folder):
    flagged = subspace.detect(channel_series(spark, folder), "channel", 24, 3, ["t"], weighted=True)
    return subspace.first_alarms(flagged, "channel", "t", 1705000000000000, 1706400000000000)


# The squared distance is the sum of squared residuals of each column after those before it, over their variances.
ENVELOPE = """with l as (select l_quantity as a, l_extendedprice as b, l_discount as c, l_tax as e, l_returnflag as f from lineitem),
m as (select avg(a) as ma, avg(b) as mb, avg(c) as mc, avg(e) as me from l where f = 'A'),
y1 as (select f, a - ma as z1, b - mb as b0, c - mc as c0, e - me as e0 from l, m),
p1 as (select avg(z1 * z1) as v1, avg(b0 * z1) as sb, avg(c0 * z1) as sc, avg(e0 * z1) as se from y1 where f = 'A'),
y2 as (select f, z1, v1, b0 - sb / v1 * z1 as z2, c0 - sc / v1 * z1 as c1, e0 - se / v1 * z1 as e1 from y1, p1),
p2 as (select avg(z2 * z2) as v2, avg(c1 * z2) as sc, avg(e1 * z2) as se from y2 where f = 'A'),
y3 as (select f, z1, v1, z2, v2, c1 - sc / v2 * z2 as z3, e1 - se / v2 * z2 as e2 from y2, p2),
p3 as (select avg(z3 * z3) as v3, avg(e2 * z3) as se from y3 where f = 'A'),
y4 as (select f, z1, v1, z2, v2, z3, v3, e2 - se / v3 * z3 as z4 from y3, p3),
p4 as (select avg(z4 * z4) as v4 from y4 where f = 'A'),
d as (select f, z1 * z1 / v1 + z2 * z2 / v2 + z3 * z3 / v3 + z4 * z4 / v4 as d from y4, p4),
t as (select quantile_cont(d, 0.99) as t from d where f = 'A')
select f as l_returnflag, count(*) as n, count(*) filter (d > t) as outliers from d, t group by 1"""


@query("envelope_outliers", ENVELOPE)
def envelope_outliers(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    distance, limit = oneclass.envelope(lines.where(F.col("l_returnflag") == "A"), columns)
    return lines.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(distance > limit).alias("outliers"))


@query("isolation_outliers")
def isolation_outliers(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("cust"), "o_orderstatus")
    columns = ["o_totalprice", "cust"]
    stats = oneclass.scaled(rows, columns)
    ready = oneclass.standardize(rows, stats)
    forest = oneclass.isolation_trees(ready, "o_orderkey", ["z_o_totalprice", "z_cust"])
    scored = oneclass.isolation_scores(ready, forest, ["z_o_totalprice", "z_cust"])
    return scored.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("anomaly"), 6).alias("mean_anomaly"), F.count_if(F.col("anomaly") > 0.6).alias("outliers"))
