"""Irregular windows, sessions by arrival, interpolation limits, payloads of periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode.operators import assembly, resample, sessions, sweep
from tracelode.queries.registry import query
from tracelode.sources.tables import events, micros, table

DAY = 86_400_000_000
HOUR = 3_600_000_000


def order_windows(spark, folder):
    """One window for each order: overlapping, of 1 to 240 hours, from 1995 dates moved to the year of the events."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", micros("o_orderdate").alias("d"))
    first = (F.lit(1_704_067_200_000_000) + F.pmod(F.col("d") + F.col("o_orderkey") * 7_919_000_000, F.lit(30 * DAY))).alias("start_us")
    rows = orders.select("o_orderkey", (F.col("o_custkey") % 5).alias("zone"), first)
    return rows.withColumn("end_us", F.col("start_us") + (F.col("o_orderkey") % 240 + 1) * HOUR)


WINDOWS = f"""wi as (select o_orderkey, o_custkey % 5 as zone, 1704067200000000 + (epoch_us(o_orderdate) + o_orderkey * 7919000000) % {30 * DAY} as start_us from orders),
wn as (select *, start_us + (o_orderkey % 240 + 1) * {HOUR} as end_us from wi),
pt as (select event_id, user_id % 5 as zone, epoch_us(ts) as t, cast(round(value * 100) as bigint) as cents, value from events)"""


def points(spark, folder):
    ev = events(spark, folder, "event_id", "user_id", "value")
    return ev.select("event_id", (F.col("user_id") % 5).alias("zone"), "ts_us", F.round(F.col("value") * 100).cast("long").alias("cents"), "value")


@query(
    "window_totals",
    f"""with {WINDOWS} select w.o_orderkey, w.zone, start_us, end_us, count(event_id) as points, coalesce(sum(cents), 0)::bigint as cents
    from wn w left join pt p on p.zone = w.zone and t >= start_us and t < end_us group by 1, 2, 3, 4""",
)
def window_totals(spark, folder):
    """Points and their sum in every window of its zone; windows overlap."""
    return sweep.totals_in_windows(points(spark, folder), order_windows(spark, folder), ["zone"], "ts_us", "start_us", "end_us", {"points": F.lit(1), "cents": F.col("cents")})


@query(
    "window_of_point",
    f"""with {WINDOWS}, st as (select zone, start_us, max(o_orderkey) as o_orderkey, arg_max(end_us, o_orderkey) as end_us from wn group by 1, 2)
    select event_id, p.zone, case when end_us > t then o_orderkey end as window_key from pt p asof left join st s on s.zone = p.zone and p.t >= s.start_us""",
)
def window_of_point(spark, folder):
    """The window that started last before each point, if it is still open."""
    found = sweep.latest_window(points(spark, folder), order_windows(spark, folder), ["zone"], "ts_us", "start_us", "end_us", "w", ["o_orderkey"])
    return found.select("event_id", "zone", F.col("w.o_orderkey").alias("window_key"))


@query(
    "windows_with_alarms",
    f"""with {WINDOWS}, on1 as (select zone, start_us, max(end_us) as end_us from wn group by 1, 2),
    hit as (select p.zone, start_us, count(*) as n from (select * from pt where value > 350) p asof join on1 s on s.zone = p.zone and p.t >= s.start_us where end_us > t group by 1, 2)
    select zone, start_us, end_us, coalesce(n, 0) as alarm_points, n is not null as predicted from on1 left join hit using (zone, start_us)""",
)
def windows_with_alarms(spark, folder):
    wide = order_windows(spark, folder).groupBy("zone", "start_us").agg(F.max("end_us").alias("end_us"))
    return sweep.windows_with_alarms(points(spark, folder), wide, ["zone"], "ts_us", "start_us", "end_us", F.col("value") > 350)


@query(
    "columns_changing_in_windows",
    f"""with {WINDOWS}, pv as (select zone, t, case when value > 300 then 2 when value > 40 then 1 end as level, case when t % 3 = 0 then 7 end as fixed from pt)
    select o_orderkey, w.zone, start_us, end_us, count(t) as points, coalesce(min(level) <> max(level), false) as level_changes, coalesce(min(fixed) <> max(fixed), false) as fixed_changes
    from wn w left join pv p on p.zone = w.zone and t >= start_us and t <= end_us group by 1, 2, 3, 4""",
)
def columns_changing_in_windows(spark, folder):
    rows = points(spark, folder).select(
        "zone", "ts_us", F.when(F.col("value") > 300, 2).when(F.col("value") > 40, 1).alias("level"), F.when(F.col("ts_us") % 3 == 0, 7).alias("fixed")
    )
    return sweep.changing_in_windows(rows, order_windows(spark, folder), ["zone"], "ts_us", "start_us", "end_us", ["level", "fixed"])


# ---- sessions by arrival -----------------------------------------------------------------------------------------------

ARRIVALS = 20 * HOUR


def arrivals(spark, folder):
    """Events by user; every fifth arrives some hours late: its time lies before those of earlier arrivals."""
    ev = events(spark, folder, "event_id", "user_id")
    late = F.when(F.col("event_id") % 5 == 0, (F.col("event_id") % 40) * 2 * HOUR).otherwise(0)
    return ev.select("event_id", "user_id", (F.col("ts_us") - late).alias("t"))


@query(
    "arrival_sessions",
    f"""with recursive ar as (select event_id, user_id, epoch_us(ts) - case when event_id % 5 = 0 then (event_id % 40) * 2 * {HOUR} else 0 end as t from events),
    nu as (select *, row_number() over (partition by user_id order by event_id) as rn from ar),
    w as (select user_id, rn, event_id, [t] as latest, 1::bigint as session_no from nu where rn = 1
      union all select n.user_id, n.rn, n.event_id,
        case when k.k is null then list_append(latest, n.t) else list_transform(latest, lambda x, i: case when i = k.k then n.t else x end) end, coalesce(k.k, len(latest) + 1)::bigint
      from w join nu n on n.user_id = w.user_id and n.rn = w.rn + 1, lateral (select list_position(list_transform(latest, lambda x: n.t - x <= {ARRIVALS}), true) as k) k)
    select event_id, user_id, session_no from w""",
)
def arrival_sessions(spark, folder):
    """Sessions when rows arrive out of order: the first one that is still within reach takes the row."""
    return sessions.arrival_sessions(arrivals(spark, folder), ["user_id"], "t", ["event_id"], ARRIVALS).select("event_id", "user_id", "session_no")


# ---- interpolation with a limit ------------------------------------------------------------------------------------------

DENSE = f"""with b as (select user_id, epoch_us(ts) // {DAY} * {DAY} as t, avg(value) as v from events group by 1, 2),
d as (select user_id, unnest(generate_series(min(t), max(t), {DAY})) as t from b group by 1),
g as (select user_id, d.t, v, case when v is not null then d.t end as kt from d left join b using (user_id, t)),
n as (select user_id, t, v, last_value(v ignore nulls) over w as pv, last_value(kt ignore nulls) over w as pt, first_value(v ignore nulls) over x as nv, first_value(kt ignore nulls) over x as nt
    from g window w as (partition by user_id order by t), x as (partition by user_id order by t rows between current row and unbounded following))"""


def _limited(spark, folder, beyond):
    ev = events(spark, folder, "user_id", "value")
    out = resample.resample(ev, ["user_id"], "ts_us", "value", DAY, "mean", "linear", 1, beyond)
    return out.select("user_id", "t", F.round("v", 6).alias("v"))


@query("resample_limit_hold", DENSE + f" select user_id, t, round(coalesce(v, pv + (least(t, pt + {DAY}) - pt) / (nt - pt) * (nv - pv)), 6) as v from n")
def resample_limit_hold(spark, folder):
    """One step of a gap is interpolated, the rest keeps its value."""
    return _limited(spark, folder, "hold")


@query("resample_limit_null", DENSE + f" select user_id, t, round(case when v is not null then v when nt - {DAY} - pt <= {DAY} then pv + (t - pt) / (nt - pt) * (nv - pv) end, 6) as v from n")
def resample_limit_null(spark, folder):
    """Gaps of more than one step stay open."""
    return _limited(spark, folder, "null")


# ---- payloads of periods ----------------------------------------------------------------------------------------------------

PERIOD = 6


def packets(spark, folder):
    """Orders as packets of five sessions; three of four are sent by a server port."""
    orders = table(spark, folder, "orders")
    port = F.element_at(F.array(F.lit(502), F.lit(44818), F.lit(5000), F.lit(102)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    data = F.when(F.col("o_orderkey") % 7 > 0, F.substring("o_orderpriority", 1, 5).cast("binary"))
    return orders.select((F.col("o_custkey") % 5).alias("session"), "o_orderkey", (F.col("o_orderkey") * 1000).alias("ms"), port.alias("source_port"), data.alias("data"))


PACKETS = """pk as (select o_custkey % 5 as session, o_orderkey, o_orderkey * 1000 as ms, [502, 44818, 5000, 102][o_orderkey % 4 + 1] as source_port,
    case when o_orderkey % 7 > 0 then o_orderpriority[1:5] end as data from orders),
ix as (select *, row_number() over (partition by session order by o_orderkey) - 1 as packet_index from pk)"""
PARTS = f"""gr as (select *, (row_number() over (partition by session order by o_orderkey) - 1) // {PERIOD} as period_no from ix),
pp as (select session, period_no, arg_min(ms, o_orderkey) as "timestamp", count(*) filter (source_port <> 5000 and data is not null) as parts,
    coalesce(string_agg(data, '' order by o_orderkey) filter (source_port <> 5000), '') as body from gr group by 1, 2)"""


@query("period_payloads", f"with {PACKETS}, {PARTS} select session, period_no, \"timestamp\", cast(parts as int) as parts, hex(body) as payload_hex from pp")
def period_payloads(spark, folder):
    """Server payloads of every period of a session, joined in order."""
    rows = assembly.period_payloads(packets(spark, folder), ["session"], ["o_orderkey"], "ms", PERIOD, sessions.is_protocol_port(F.col("source_port")))
    return rows.withColumn("payload_hex", F.hex("payload")).drop("payload")


@query(
    "pattern_payloads",
    f"with {PACKETS}, {PARTS.replace('from ix)', 'from ix where packet_index % 10 in (3, 4, 7))')} select session, period_no, \"timestamp\", cast(parts as int) as parts, hex(body) as payload_hex from pp where parts > 0",
)
def pattern_payloads(spark, folder):
    """The same for packets that a table of indices names, without empty periods."""
    every = assembly.indexed_packets(packets(spark, folder), ["session"], ["o_orderkey"])
    named = every.where((F.col("packet_index") % 10).isin(3, 4, 7)).select("session", "packet_index")
    picked = assembly.indexed_packets(packets(spark, folder), ["session"], ["o_orderkey"], named)
    rows = assembly.period_payloads(picked, ["session"], ["o_orderkey"], "ms", PERIOD, sessions.is_protocol_port(F.col("source_port")), drop_empty=True)
    return rows.withColumn("payload_hex", F.hex("payload")).drop("payload")


def _sampled_sql(every):
    return f"""with recursive {PACKETS}, {PARTS}, th as (select session, min("timestamp") as t from pp group by 1
      union all select t.session, (select min(p."timestamp") from pp p where p.session = t.session and p."timestamp" >= t.t + {every}) from th t
      where exists (select 1 from pp p where p.session = t.session and p."timestamp" >= t.t + {every}))
    select p.session, period_no, "timestamp", hex(body) as payload_hex from pp p join th on th.session = p.session and th.t = p."timestamp\""""


def _sampled(spark, folder, every):
    rows = assembly.period_payloads(packets(spark, folder), ["session"], ["o_orderkey"], "ms", PERIOD, sessions.is_protocol_port(F.col("source_port")))
    return assembly.sampled_payloads(rows, ["session"], every).select("session", "period_no", "timestamp", F.hex("payload").alias("payload_hex"))


@query("payloads_sampled_slowly", _sampled_sql(100_000))
def payloads_sampled_slowly(spark, folder):
    return _sampled(spark, folder, 100_000)


@query("payloads_sampled_fast", _sampled_sql(40_000))
def payloads_sampled_fast(spark, folder):
    return _sampled(spark, folder, 40_000)


@query(
    "consistent_payloads",
    f"""with {PACKETS}, {PARTS}, sh as (select session, period_no % 3 as part, period_no, case when period_no % 3 = 0 then body[1:1] else body end as body from pp)
    select session, part, period_no, payload_length, hex(body) as payload_hex from sh join (select session, part, min(length(body)) as payload_length from sh group by 1, 2 having min(length(body)) = max(length(body)))
    using (session, part)""",
)
def consistent_payloads(spark, folder):
    """Payloads of the sessions, here a session's thirds, in which all are of one length."""
    rows = assembly.period_payloads(packets(spark, folder), ["session"], ["o_orderkey"], "ms", PERIOD, sessions.is_protocol_port(F.col("source_port")))
    part = rows.withColumn("part", F.col("period_no") % 3)
    cut = part.withColumn("payload", F.when(F.col("part") == 0, F.substring("payload", 1, 1)).otherwise(F.col("payload")))
    out = assembly.consistent_sessions(cut, ["session", "part"])
    return out.select("session", "part", "period_no", F.col("payload_length").cast("long").alias("payload_length"), F.hex("payload").alias("payload_hex"))
