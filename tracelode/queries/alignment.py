"""As-of, nearest, interpolating and window matches; resampling and normalization."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode.operators import alignment, resample
from tracelode.plans import quantiles
from tracelode.plans.ordered import Ordered
from tracelode.queries.registry import query
from tracelode.sources.tables import events, micros, table

KEYS = ["user_id"]
DAY = 86_400_000_000
HOUR = 3_600_000_000

SIDES = """
with ev as (select event_id, user_id, event_type, value, epoch_us(ts) as ts_us from events),
l as (select * from ev where event_type = 'purchase'), r as (select * from ev where event_type in ('view', 'click'))
"""


def sides(spark, folder):
    ev = events(spark, folder)
    return ev.where(F.col("event_type") == "purchase"), ev.where(F.col("event_type").isin("view", "click"))


def _found(spark, folder):
    left, right = sides(spark, folder)
    return alignment.neighbours(left, right, KEYS, "ts_us", "ts_us", "event_id", ["event_id", "value"])


def _matched(df):
    return df.select(
        "event_id", F.col("match")["event_id"].alias("match_id"), F.col("match")["value"].alias("match_value"),
        (F.col("match")["t"] - F.col("ts_us")).alias("diff_us"),
    )


ASOF = "select l.event_id, r.event_id as match_id, r.value as match_value, r.ts_us - l.ts_us as diff_us from l asof left join r on l.user_id = r.user_id and "


@query("asof_backward", SIDES + ASOF + "l.ts_us >= r.ts_us")
def asof_backward(spark, folder):
    return _matched(alignment.asof(_found(spark, folder), "ts_us", "backward"))


@query("asof_forward", SIDES + ASOF + "l.ts_us <= r.ts_us")
def asof_forward(spark, folder):
    return _matched(alignment.asof(_found(spark, folder), "ts_us", "forward"))


NEAREST = SIDES + """, b as (select l.event_id, r.event_id as bid, r.value as bv, r.ts_us as bt from l asof left join r on l.user_id = r.user_id and l.ts_us >= r.ts_us),
f as (select l.event_id, r.event_id as fid, r.value as fv, r.ts_us as ft from l asof left join r on l.user_id = r.user_id and l.ts_us < r.ts_us),
n as (select l.event_id, l.ts_us, l.value, bid, bv, bt, fid, fv, ft, l.ts_us - bt as db, ft - l.ts_us as df from l join b using (event_id) join f using (event_id)),
m as (select *, case when bid is null then fid when fid is null or db <= df then bid else fid end as mid,
             case when bid is null then fv when fid is null or db <= df then bv else fv end as mv,
             case when bid is null then df when fid is null or db <= df then -db else df end as d from n)
"""


@query("asof_nearest", NEAREST + "select event_id, mid as match_id, mv as match_value, d as diff_us from m")
def asof_nearest(spark, folder):
    return _matched(alignment.asof(_found(spark, folder), "ts_us", "nearest"))


@query(
    "nearest_threshold",
    NEAREST + f"select event_id, case when abs(d) < {HOUR * 6} then mid end as match_id, case when abs(d) < {HOUR * 6} then mv end as match_value, case when abs(d) < {HOUR * 6} then d end as diff_us from m",
)
def nearest_threshold(spark, folder):
    return _matched(alignment.nearest_within(_found(spark, folder), "ts_us", HOUR * 6))


@query(
    "asof_global_stream",
    """with ev as (select event_id, event_type, value, epoch_us(ts) as ts_us, 1 as one from events)
    select l.event_id, r.event_id as match_id, r.value as match_value, r.ts_us - l.ts_us as diff_us
    from (select * from ev where event_type = 'error') l asof left join (select * from ev where event_type = 'view') r on l.one = r.one and l.ts_us >= r.ts_us""",
)
def asof_global_stream(spark, folder):
    """No key at all: both sides belong to one group."""
    ev = events(spark, folder, "event_id", "event_type", "value")
    left, right = ev.where(F.col("event_type") == "error"), ev.where(F.col("event_type") == "view")
    found = alignment.neighbours(left, right, [], "ts_us", "ts_us", "event_id", ["event_id", "value"])
    return _matched(alignment.asof(found, "ts_us", "backward"))


@query(
    "interp_match",
    NEAREST
    + f"""select event_id, round(case when db = 0 then bv when db <= {DAY} and df <= {DAY} then bv + db / (ft - bt) * (fv - bv)
       when abs(d) <= {DAY} then mv end, 6) as matched from m""",
)
def interp_match(spark, folder):
    out = alignment.interpolated(_found(spark, folder), "ts_us", "value", float(DAY))
    return out.select("event_id", F.round("matched", 6).alias("matched"))


def _window_sql(lo, hi, order, prefix=""):
    return (
        SIDES
        + f""", p as (select l.event_id, l.user_id, l.value as lv, l.ts_us as lt, r.event_id as rid, r.value as rv, r.ts_us as rt,
      abs(l.value - r.value) as dv, abs(r.ts_us - l.ts_us) as dt, abs(l.value - r.value) < 1e-4 as ex
      from l left join r on l.user_id = r.user_id and r.ts_us between l.ts_us - {lo} and l.ts_us + {hi}),
    q as (select *, row_number() over (partition by event_id order by {order}) as rk from p)
    """
    )


VALUE_TIME = "case when ex then 0 else 1 end, case when ex then 0 else dv end, dt, rt"


def _window(spark, folder, before, after, rank):
    left, right = sides(spark, folder)
    return alignment.best_in_window(
        left, right.select("user_id", "event_id", "ts_us", "value"), KEYS, "ts_us", "event_id", "ts_us", "event_id", before, after, rank
    )


RANK = alignment.value_then_time("ts_us", "value", "ts_us", "value")


def _picked(df):
    return df.select(
        "event_id", F.col("best")["event_id"].alias("match_id"), F.col("best")["value"].alias("match_value"),
        (F.col("best")["ts_us"] - F.col("ts_us")).alias("diff_us"),
    )


@query(
    "window_value_match",
    _window_sql(3 * DAY, 0, VALUE_TIME) + "select event_id, rid as match_id, rv as match_value, rt - lt as diff_us from q where rk = 1",
)
def window_value_match(spark, folder):
    return _picked(_window(spark, folder, 3 * DAY, 0, RANK))


@query(
    "value_nearest_tol",
    _window_sql(2 * DAY, 2 * DAY, "dv, dt, rt") + "select event_id, rid as match_id, rv as match_value, rt - lt as diff_us from q where rk = 1",
)
def value_nearest_tol(spark, folder):
    rank = alignment.closest_value("ts_us", "value", "ts_us", "value")
    return _picked(_window(spark, folder, 2 * DAY, 2 * DAY, rank))


@query(
    "direction_choice",
    _window_sql(3 * DAY, 0, VALUE_TIME)
    + f""", b as (select user_id, count(*) as total, count(rid) as before_matches, count(*) filter (rid is not null and ex) as before_exact from q where rk = 1 group by 1),
    pa as (select l.event_id, l.user_id, r.event_id as rid, abs(l.value - r.value) as dv, abs(r.ts_us - l.ts_us) as dt, abs(l.value - r.value) < 1e-4 as ex, r.ts_us as rt
      from l left join r on l.user_id = r.user_id and r.ts_us between l.ts_us and l.ts_us + {3 * DAY}),
    qa as (select *, row_number() over (partition by event_id order by {VALUE_TIME}) as rk from pa),
    a as (select user_id, count(rid) as after_matches, count(*) filter (rid is not null and ex) as after_exact from qa where rk = 1 group by 1)
    select user_id, total, before_matches, before_exact, after_matches, after_exact,
           case when before_exact > after_exact then 'before' else 'after' end as direction from b join a using (user_id)""",
)
def direction_choice(spark, folder):
    before = _window(spark, folder, 3 * DAY, 0, RANK)
    after = _window(spark, folder, 0, 3 * DAY, RANK)
    return alignment.direction_summary(before, after, KEYS, "value", "value")


@query(
    "row_group_match",
    SIDES
    + f""", l2 as (select *, floor(value) as a, floor(value / 10) as b from l), r2 as (select *, floor(value) as a, floor(value / 10) as b from r),
    p as (select l2.event_id, r2.event_id as rid, r2.ts_us as rt, abs(r2.ts_us - l2.ts_us) as dt,
        (abs(l2.a - r2.a) < 1e-4)::int + (abs(l2.b - r2.b) < 1e-4)::int as hits,
        (case when abs(l2.a - r2.a) < 1e-4 then 0 else abs(l2.a - r2.a) end) + (case when abs(l2.b - r2.b) < 1e-4 then 0 else abs(l2.b - r2.b) end) as agg
      from l2 join r2 on l2.user_id = r2.user_id and r2.ts_us between l2.ts_us and l2.ts_us + {4 * DAY}),
    q as (select *, row_number() over (partition by event_id order by hits desc, agg, dt, rt) as rk from p)
    select event_id, rid as match_id, cast(hits as int) as exact_columns, agg as total_diff, hits = 2 as row_equal from q where rk = 1""",
)
def row_group_match(spark, folder):
    left, right = sides(spark, folder)

    def shape(df):
        return df.withColumn("a", F.floor("value").cast("double")).withColumn("b", F.floor(F.col("value") / 10).cast("double"))

    mapping = {"a": "a", "b": "b"}
    rank = alignment.row_match("ts_us", "ts_us", mapping)
    out = alignment.best_in_window(
        shape(left), shape(right).select("user_id", "event_id", "ts_us", "a", "b"), KEYS, "ts_us", "event_id", "ts_us", "event_id", 0, 4 * DAY, rank
    ).where(F.col("best").isNotNull())
    hits = [alignment.values_equal(F.col(c), F.col("best")[c]) for c in mapping]
    count = sum((F.when(h, 1).otherwise(0) for h in hits), F.lit(0))
    gap = sum((F.when(h, F.lit(0.0)).otherwise(F.abs(F.col("best")[c] - F.col(c))) for h, c in zip(hits, mapping)), F.lit(0.0))
    return out.select(
        "event_id", F.col("best")["event_id"].alias("match_id"), count.alias("exact_columns"), gap.alias("total_diff"), (count == 2).alias("row_equal")
    )


EXPAND = SIDES + """, s as (select user_id, ts_us as t0, value as v0, lead(ts_us) over w as t1, lead(value) over w as v1 from r window w as (partition by user_id order by ts_us)),
    j as (select l.event_id, l.user_id, l.ts_us, s.* exclude (user_id) from l asof left join s on l.user_id = s.user_id and l.ts_us >= s.t0),
    k as (select *, t0 is not null and t1 is not null as assigned, row_number() over (partition by user_id, t0 order by ts_us) as kk, count(*) over (partition by user_id, t0) as m from j)
"""


def _expanded(spark, folder, mode, out_of_range="skip"):
    left, right = sides(spark, folder)
    packets = left.select("user_id", "event_id", "ts_us")
    out = alignment.expand_intervals(packets, right.select("user_id", "ts_us", "value"), KEYS, "ts_us", "ts_us", "value", mode, out_of_range)
    return out.select("event_id", "assigned", "interval_start", F.round("expanded", 6).alias("expanded"))


@query(
    "packet_bin_expand",
    EXPAND + "select event_id, assigned, case when assigned then t0 end as interval_start, round(case when assigned then case when abs(v1 - v0) <= 1e-9 then v0 else v0 + kk / (m + 1) * (v1 - v0) end end, 6) as expanded from k",
)
def packet_bin_expand(spark, folder):
    return _expanded(spark, folder, "packet_bins")


@query(
    "time_interp_expand",
    EXPAND + "select event_id, assigned, case when assigned then t0 end as interval_start, round(case when assigned then case when abs(v1 - v0) <= 1e-9 then v0 else v0 + (ts_us - t0) / (t1 - t0) * (v1 - v0) end end, 6) as expanded from k",
)
def time_interp_expand(spark, folder):
    return _expanded(spark, folder, "time_interp")


@query(
    "hold_expand",
    EXPAND.replace("from r window", "from r window")
    + """, fst as (select user_id, arg_min(value, ts_us) as fv from r group by 1)
    select event_id, true as assigned, case when assigned then t0 end as interval_start, round(case when t0 is not null then v0 else fv end, 6) as expanded from k left join fst using (user_id)""",
)
def hold_expand(spark, folder):
    return _expanded(spark, folder, "hold", "hold")


RES = f"""
with b as (select user_id, epoch_us(ts) // {DAY} * {DAY} as t, value, epoch_us(ts) as u from events),
agg as (select user_id, t, avg(value) as mean, arg_max(value, u) as last from b group by 1, 2),
bd as (select user_id, min(t) as lo, max(t) as hi from agg group by 1),
g as (select user_id, unnest(generate_series(lo, hi, {DAY})) as t from bd),
d as (select g.user_id, g.t, mean, last, case when mean is not null then g.t end as kt from g left join agg using (user_id, t)),
"""


@query(
    "resample_ffill",
    RES + "f as (select user_id, t, last_value(last ignore nulls) over (partition by user_id order by t) as v from d) select user_id, t, v from f",
)
def resample_ffill(spark, folder):
    ev = events(spark, folder, "user_id", "value")
    return resample.resample(ev, KEYS, "ts_us", "value", DAY, "last", "ffill").select("user_id", "t", "v")


@query(
    "resample_interp",
    RES
    + """n as (select user_id, t, mean, last_value(mean ignore nulls) over w as pv, last_value(kt ignore nulls) over w as pt,
         first_value(mean ignore nulls) over x as nv, first_value(kt ignore nulls) over x as nt from d
         window w as (partition by user_id order by t), x as (partition by user_id order by t rows between current row and unbounded following))
    select user_id, t, round(coalesce(mean, pv + (t - pt) / (nt - pt) * (nv - pv)), 6) as v from n""",
)
def resample_interp(spark, folder):
    ev = events(spark, folder, "user_id", "value")
    out = resample.resample(ev, KEYS, "ts_us", "value", DAY, "mean", "linear")
    return out.select("user_id", "t", F.round("v", 6).alias("v"))


@query(
    "resample_mode",
    f"""with c as (select user_id, epoch_us(ts) // {DAY} * {DAY} as t, event_type as v, count(*) as n, max(epoch_us(ts)) as l from events group by 1, 2, 3)
    select user_id, t, v from (select *, row_number() over (partition by user_id, t order by n desc, l desc) as rk from c) where rk = 1""",
)
def resample_mode(spark, folder):
    return resample.bucketed(events(spark, folder, "user_id", "event_type"), KEYS, "ts_us", "event_type", DAY, "mode")


@query(
    "common_grid",
    SIDES
    + f""", a as (select user_id, min(ts_us) as lo, max(ts_us) as hi from l group by 1), b as (select user_id, min(ts_us) as lo, max(ts_us) as hi from r group by 1),
    c as (select user_id, greatest(a.lo, b.lo) as lo, least(a.hi, b.hi) as hi from a join b using (user_id))
    select user_id, unnest(generate_series((lo + {HOUR} - 1) // {HOUR} * {HOUR}, hi // {HOUR} * {HOUR}, {HOUR})) as t from c""",
)
def common_grid(spark, folder):
    left, right = sides(spark, folder)
    return resample.common_grid(left, right, KEYS, "ts_us", HOUR)


@query(
    "per_second_last",
    "select user_id, epoch_us(ts) // 1000000 as sec, arg_max(value, epoch_us(ts)) as value from events group by 1, 2",
)
def per_second_last(spark, folder):
    return resample.per_second_last(events(spark, folder, "event_id", "user_id", "value"), KEYS, "ts_us", "value", "event_id")


@query(
    "clean_series",
    "select o_custkey, epoch_us(o_orderdate) as ts_us, arg_max(o_totalprice, o_orderkey) as o_totalprice from orders group by 1, 2",
)
def clean_series(spark, folder):
    orders = table(spark, folder, "orders").withColumn("ts_us", micros("o_orderdate"))
    return resample.clean_series(orders, ["o_custkey"], "ts_us", "o_totalprice", "o_orderkey")


@query(
    "sampling_interval",
    "select user_id, count(*) as n, round((max(epoch_us(ts)) - min(epoch_us(ts))) / nullif(count(*) - 1, 0), 3) as interval from events group by 1",
)
def sampling_interval(spark, folder):
    out = resample.sampling_interval(events(spark, folder, "user_id"), KEYS, "ts_us")
    return out.select("user_id", "n", F.round("interval", 3).alias("interval"))


@query(
    "discrete_columns",
    """select event_type, count(distinct round(floor(value / 100), 9)) as uniques,
       count(distinct round(floor(value / 100), 9)) <= 8 as discrete from events group by 1""",
)
def discrete_columns(spark, folder):
    ev = events(spark, folder, "event_type", "value").withColumn("v", F.floor(F.col("value") / 100).cast("double"))
    return resample.is_discrete(ev, ["event_type"], "v")


@query(
    "normalize_zscore",
    """select event_id, round((value - m) / s, 8) as z, round((value - lo) / (hi - lo), 8) as u from events
    join (select user_id, avg(value) as m, stddev_pop(value) as s, min(value) as lo, max(value) as hi from events group by 1) using (user_id)""",
)
def normalize_zscore(spark, folder):
    ev = events(spark, folder, "event_id", "user_id", "value")
    out = resample.normalize(resample.normalize(ev, KEYS, "value", "zscore", "z"), KEYS, "value", "minmax", "u")
    return out.select("event_id", F.round("z", 8).alias("z"), F.round("u", 8).alias("u"))


MAD = """
with m as (select user_id, median(value) as med, stddev_pop(value) as sd, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) as iqr from events group by 1),
d as (select user_id, med, sd, iqr, median(abs(value - med)) as mad from events join m using (user_id) group by 1, 2, 3, 4),
s as (select *, case when 1.4826 * mad > 1e-9 then 1.4826 * mad when sd > 1e-9 then sd when iqr / 1.349 > 1e-9 then iqr / 1.349 else 1.0 end as scale from d)
"""


@query("robust_scale", MAD + "select user_id, round(med, 8) as median, round(mad, 8) as mad, round(scale, 8) as scale from s")
def robust_scale(spark, folder):
    out = quantiles.robust_scale(events(spark, folder, "user_id", "value"), KEYS, "value")
    return out.select("user_id", *[F.round(c, 8).alias(c) for c in ("median", "mad", "scale")])


@query("normalize_robust", MAD + "select event_id, round((value - med) / scale, 8) as rz from events join s using (user_id)")
def normalize_robust(spark, folder):
    ev = events(spark, folder, "event_id", "user_id", "value")
    return resample.normalize(ev, KEYS, "value", "robust_zscore", "rz").select("event_id", F.round("rz", 8).alias("rz"))


@query(
    "series_quantiles",
    "select event_type, round(quantile_cont(value, 0.25), 8) as q25, round(median(value), 8) as q50, round(quantile_cont(value, 0.75), 8) as q75, round(quantile_cont(value, 0.99), 8) as q99 from events group by 1",
)
def series_quantiles(spark, folder):
    ev = events(spark, folder, "event_type", "value")
    out = quantiles.quantiles(ev, ["event_type"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q99": 0.99})
    return out.select("event_type", *[F.round(c, 8).alias(c) for c in ("q25", "q50", "q75", "q99")])


STATE = """
with p as (select user_id, epoch_us(ts) as ts_us, arg_max(value, event_id) filter (event_type = 'click') as click, arg_max(value, event_id) filter (event_type = 'view') as view,
             arg_max(value, event_id) filter (event_type = 'error') as error from events group by 1, 2),
f as (select user_id, ts_us, last_value(click ignore nulls) over w as click, last_value(view ignore nulls) over w as view, last_value(error ignore nulls) over w as error
      from p window w as (partition by user_id order by ts_us))
"""


@query("state_rows", STATE + "select * from f where click is not null and view is not null and error is not null")
def state_rows(spark, folder):
    ev = events(spark, folder, "event_id", "user_id", "event_type", "value")
    return resample.state_rows(ev, KEYS, "ts_us", "event_type", "value", ["click", "view", "error"], "event_id")


@query(
    "group_time_merge",
    f"""with a as (select epoch_us(ts) // {HOUR} as h, arg_min(value, event_id) as click from events where event_type = 'click' group by 1),
    b as (select epoch_us(ts) // {HOUR} as h, arg_min(value, event_id) as view from events where event_type = 'view' group by 1)
    select h, click, view from a join b using (h)""",
)
def group_time_merge(spark, folder):
    ev = events(spark, folder, "event_id", "event_type", "value").withColumn("h", F.floor(F.col("ts_us") / HOUR))
    groups = [
        ev.where(F.col("event_type") == c).select("h", F.col("value").alias(c), F.col("event_id").alias("_tie")) for c in ("click", "view")
    ]
    return alignment.merge_on_time(groups, "h")


@query(
    "time_diff_table",
    f"""with a as (select epoch_us(ts) // {HOUR} as h, avg(value) as v from events where event_type = 'click' group by 1),
    b as (select epoch_us(ts) // {HOUR} as h, avg(value) as v from events where event_type = 'view' group by 1)
    select coalesce(a.h, b.h) as h, round(a.v, 6) as click, round(b.v, 6) as view from a full join b on a.h = b.h""",
)
def time_diff_table(spark, folder):
    ev = events(spark, folder, "event_type", "value").withColumn("h", F.floor(F.col("ts_us") / HOUR))
    per = ev.groupBy("event_type", "h").agg(F.round(F.avg("value"), 6).alias("v"))
    return alignment.full_outer_diffs({c: per.where(F.col("event_type") == c) for c in ("click", "view")}, "h", "v")


@query(
    "time_range_clip",
    f"""select event_id from events where event_type = 'purchase' and epoch_us(ts) between
      (select min(epoch_us(ts)) + {DAY} from events where event_type = 'view') and (select max(epoch_us(ts)) - {DAY} from events where event_type = 'view')""",
)
def time_range_clip(spark, folder):
    ev = events(spark, folder, "event_id", "event_type")
    left, right = ev.where(F.col("event_type") == "purchase"), ev.where(F.col("event_type") == "view")
    return alignment.clip_to_range(left, right, "ts_us", "ts_us", DAY).select("event_id")


@query(
    "time_diff_trim",
    """with s as (select l_shipdate, epoch_us(l_shipdate) as u, l_quantity as v, l_returnflag from lineitem),
    a as (select l_returnflag, avg(v) as m, stddev_pop(v) as sd, count(*) as n from s group by 1),
    b as (select l_returnflag, avg(v) as m2, stddev_pop(v) as sd2, count(*) as n2 from s join a using (l_returnflag) where abs(v - m) <= sd group by 1)
    select l_returnflag, round(m, 8) as mean_before, round(sd, 8) as std_before, n as n_before, round(m2, 8) as mean_after, round(sd2, 8) as std_after, n2 as n_after from a join b using (l_returnflag)""",
)
def time_diff_trim(spark, folder):
    out = alignment.trim_spread(table(spark, folder, "lineitem").select("l_returnflag", "l_quantity"), ["l_returnflag"], "l_quantity")
    return out.select(
        "l_returnflag", "n_before", "n_after", *[F.round(c, 8).alias(c) for c in ("mean_before", "std_before", "mean_after", "std_after")]
    )


@query(
    "value_equality",
    """with p as (select user_id, event_id, value as a, lag(value) over (partition by user_id order by ts, event_id) as b from events)
    select event_id, abs(a - b) < 1e-4 as fixed_equal,
      abs(a - b) < case when least(abs(a), abs(b)) > 100 then 0.01 when least(abs(a), abs(b)) > 1 then 0.005 else 0.001 end as dynamic_equal from p where b is not null""",
)
def value_equality(spark, folder):
    ev = events(spark, folder, "event_id", "user_id", "value")
    rows = Ordered(ev, KEYS, ["ts_us", "event_id"]).with_lag("b", F.col("value")).frame().where(F.col("b").isNotNull())
    return rows.select(
        "event_id",
        alignment.values_equal(F.col("value"), F.col("b")).alias("fixed_equal"),
        alignment.values_equal_dynamic(F.col("value"), F.col("b")).alias("dynamic_equal"),
    )


@query(
    "time_rounding",
    "select event_id, round_even(epoch_us(ts) / 1e6, 1) as tenth, round_even(epoch_us(ts) / 1e6 / 0.25, 0) * 0.25 as quarter from events",
)
def time_rounding(spark, folder):
    ev = events(spark, folder, "event_id")
    seconds = F.col("ts_us") / 1e6
    return ev.select("event_id", resample.round_time(seconds, 1).alias("tenth"), resample.round_time(seconds, step=0.25).alias("quarter"))
