"""Sessions, tokens, autocorrelation, n-grams and periods over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode.operators import cycles, greedy, patterns, periods, sessions
from tracelode.plans.ordered import Ordered
from tracelode.queries.registry import query
from tracelode.sources.tables import events, table

KEYS = ["user_id"]
ORDER = ["ts_us", "event_id"]

# Rows in session order; tokens are direction-size-type as on the wire.
EV = """
with ev as (
  select event_id, user_id, event_type, value, epoch_us(ts) as ts_us,
         row_number() over (partition by user_id order by ts, event_id) - 1 as pos,
         (case when event_type in ('purchase','error') then 'S' else 'C' end)
           || '-' || cast(floor(value / 100) as int) || '-' || event_type as token
  from events)
"""


def tokens(spark, folder):
    ev = events(spark, folder)
    direction = F.when(F.col("event_type").isin("purchase", "error"), "S").otherwise("C")
    return ev.withColumn("token", sessions.token(direction, F.floor(F.col("value") / 100).cast("int"), F.col("event_type")))


@query(
    "port_filter",
    """
    select l_orderkey, l_linenumber, l_partkey as src_port, l_suppkey as dst_port, l_quantity,
           case when l_partkey = 44818 or l_suppkey = 44818 then 'enip'
                when l_partkey in (502, 503) or l_suppkey in (502, 503) then 'modbus' else 'mms' end as protocol,
           case when l_partkey in (502, 503, 44818, 102) then 'S' else 'C' end as direction
    from lineitem where l_partkey in (502, 503, 44818, 102) or l_suppkey in (502, 503, 44818, 102)
    """,
)
def port_filter(spark, folder):
    src, dst = F.col("l_partkey"), F.col("l_suppkey")
    rows = table(spark, folder, "lineitem").where(sessions.is_protocol_port(src) | sessions.is_protocol_port(dst))
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        src.alias("src_port"),
        dst.alias("dst_port"),
        "l_quantity",
        sessions.protocol_of(src, dst).alias("protocol"),
        F.when(sessions.is_protocol_port(src), "S").otherwise("C").alias("direction"),
    )


@query(
    "session_key_pairs",
    """
    select least(l_partkey, l_suppkey) as low, greatest(l_partkey, l_suppkey) as high, count(*) as n,
           cast(sum(l_quantity) as bigint) as total
    from lineitem group by 1, 2
    """,
)
def session_key_pairs(spark, folder):
    low, high = sessions.session_endpoints(F.col("l_partkey"), F.col("l_suppkey"))
    rows = table(spark, folder, "lineitem").groupBy(low.alias("low"), high.alias("high"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("total"))


SIX_HOURS = 6 * 3600 * 1_000_000
SESSION_SQL = (
    EV
    + """, gaps as (select *, ts_us - lag(ts_us) over (partition by user_id order by pos) as gap from ev),
    ses as (select *, cast(sum(case when gap is null or gap > 21600000000 then 1 else 0 end)
              over (partition by user_id order by pos) as bigint) as session_no from gaps)
    """
)


@query("sessionize_gap", SESSION_SQL + "select event_id, user_id, session_no from ses")
def sessionize_gap(spark, folder):
    ev = events(spark, folder, "event_id", "user_id")
    return sessions.sessionize(ev, KEYS, "ts_us", ORDER, SIX_HOURS).frame().select("event_id", "user_id", "session_no")


@query(
    "session_merge_stats",
    SESSION_SQL + "select user_id, session_no, count(*) as n, min(ts_us) as first_ts, max(ts_us) as last_ts from ses group by all",
)
def session_merge_stats(spark, folder):
    ev = events(spark, folder, "event_id", "user_id")
    return sessions.session_stats(sessions.sessionize(ev, KEYS, "ts_us", ORDER, SIX_HOURS).frame(), KEYS, "ts_us")


@query(
    "stream_sessions",
    """
    with g as (select epoch_us(ts) as ts_us, event_id, value,
                 epoch_us(ts) - lag(epoch_us(ts)) over (order by ts, event_id) as gap from events),
    s as (select *, cast(sum(case when gap is null or gap > 100000000 then 1 else 0 end) over (order by ts_us, event_id) as bigint) as session_no from g)
    select session_no, count(*) as n, min(ts_us) as first_ts, max(ts_us) as last_ts from s group by 1
    """,
)
def stream_sessions(spark, folder):
    """Whole stream as one session source: the hottest possible key."""
    ev = events(spark, folder, "event_id")
    return sessions.session_stats(sessions.sessionize(ev, [], "ts_us", ORDER, 100_000_000).frame(), [], "ts_us")


@query(
    "token_dictionary",
    EV + "select user_id, token, dense_rank() over (partition by user_id order by token) - 1 as token_id from (select distinct user_id, token from ev)",
)
def token_dictionary(spark, folder):
    return sessions.token_dictionary(tokens(spark, folder), KEYS, "token")


@query(
    "token_pack16",
    """
    with t as (select event_id, case when event_type in ('purchase','error') then 1 else 0 end as d,
                 length(event_type) as f, cast(floor(value) as int) as l from events)
    select event_id, d * 32768 + f * 1024 + l as packed, d as direction, f as func, l as len from t
    """,
)
def token_pack16(spark, folder):
    ev = events(spark, folder)
    direction = F.when(F.col("event_type").isin("purchase", "error"), 1).otherwise(0)
    packed = sessions.pack_token(direction, F.length("event_type"), F.floor("value").cast("int"))
    d, f, n = sessions.unpack_token(F.col("packed"))
    return ev.select("event_id", packed.alias("packed")).select(
        "event_id", "packed", d.alias("direction"), f.alias("func"), n.alias("len")
    )


ACF_SQL = (
    EV
    + """, ids as (select user_id, pos, dense_rank() over (partition by user_id order by event_type) - 1 as x from ev),
    st as (select user_id, cast(sum(x) as double) as t0, cast(sum(x*x) as double) as s0, count(*) as n from ids group by 1),
    prod as (select a.user_id, b.pos - a.pos as lag, cast(sum(a.x * b.x) as double) as sxy,
               cast(sum(a.x) as double) as sx, cast(sum(b.x) as double) as sy, count(*) as m
             from ids a join ids b on a.user_id = b.user_id and b.pos between a.pos and a.pos + 39 group by all),
    acf as (select user_id, lag, (sxy - t0/n*(sx+sy) + m*(t0/n)*(t0/n)) / (s0 - t0*(t0/n)) as r from prod join st using (user_id))
    """
)


def _acf(spark, folder):
    ev = events(spark, folder, "event_id", "user_id", "event_type")
    encoded = sessions.encode_tokens(ev, KEYS, "event_type")
    return periods.autocorrelation(patterns.positions(encoded, KEYS, ORDER), KEYS, "token_id", 40)


@query("acf_by_lag", ACF_SQL + "select user_id, cast(lag as int) as lag, round(r, 8) as r from acf")
def acf_by_lag(spark, folder):
    return _acf(spark, folder).select("user_id", "lag", F.round("r", 8).alias("r"))


@query(
    "acf_peaks",
    ACF_SQL
    + """, q as (select user_id, lag, round(r, 8) as r from acf),
    s as (select *, case when r = lag(r) over w then 0 else 1 end as st from q window w as (partition by user_id order by lag)),
    u as (select *, sum(st) over (partition by user_id order by lag) as run from s),
    t as (select user_id, run, floor((min(lag) + max(lag)) / 2) as lag, any_value(r) as r from u group by 1, 2),
    v as (select *, lag(r) over w as p, lead(r) over w as nx from t window w as (partition by user_id order by run))
    select user_id, cast(lag as int) as lag, r from v where r > p and r > nx and r >= 0.0
    """,
)
def acf_peaks(spark, folder):
    acf = _acf(spark, folder).withColumn("r", F.round("r", 8))
    return periods.peaks(acf, KEYS, 0.0)


def _gram_sql(sizes, token="token"):
    parts = []
    for n in sizes:
        parts.append(
            f"select user_id, pos, {n} as size, array_to_string(list({token}) over (partition by user_id order by pos rows between current row and {n - 1} following), ',') as gram, "
            f"count(*) over (partition by user_id order by pos rows between current row and {n - 1} following) as c from ev"
        )
    return (
        EV
        + ", raw as ("
        + " union all ".join(parts)
        + "), grams as (select user_id, pos, size, gram from raw where c = size), lens as (select user_id, max(pos) + 1 as n from ev group by 1)"
    )


CANDIDATE_SQL = (
    ", cand as (select user_id, size, gram, min(pos) as start_pos from grams join lens using (user_id) "
    "where gram like 'S%' and pos < floor(n * 0.2) group by 1, 2, 3)"
)


SIZES = list(range(1, 21))


@query("ngram_candidates", _gram_sql(SIZES) + CANDIDATE_SQL + "select * from cand")
def ngram_candidates(spark, folder):
    numbered = patterns.positions(tokens(spark, folder), KEYS, ORDER)
    grams = patterns.ngrams(numbered, KEYS, "token", SIZES, "S")
    return patterns.candidates(grams, patterns.session_lengths(numbered, KEYS), KEYS, 0.2, "S")


# Greedy selection in SQL: follow the first match that starts after the last one ends.
GREEDY_SQL = _gram_sql(SIZES, "event_type").replace("with ev as", "with recursive ev as") + """,
    cand as (select user_id, size, gram, min(pos) as start_pos from grams join lens using (user_id)
             where gram like 'e%' and pos < floor(n * 0.2) group by 1, 2, 3),
    hits as (select g.user_id, g.size, g.gram, g.pos, c.start_pos from grams g join cand c using (user_id, size, gram)),
    walk as (select user_id, size, gram, min(pos) as pos, any_value(start_pos) as start_pos from hits group by 1, 2, 3
             union all
             select w.user_id, w.size, w.gram, min(h.pos), any_value(w.start_pos) from walk w join hits h
               on h.user_id = w.user_id and h.size = w.size and h.gram = w.gram and h.pos >= w.pos + w.size
             group by w.user_id, w.size, w.gram, w.pos),
    cnt as (select user_id, size, gram, count(*) as matches, max(pos) as last_pos, min(start_pos) as start_pos from walk group by 1, 2, 3),
    rated as (select c.*, l.n, l.n - size + 1 - (matches - 1) * (size - 1) - least(size - 1, l.n - size - last_pos) as visited
              from cnt c join lens l using (user_id))
"""


def _rates(spark, folder):
    return patterns.frequent_patterns(
        events(spark, folder, "event_id", "user_id", "event_type"), KEYS, ORDER, "event_type", SIZES, 0.2, "e"
    )


@query(
    "ngram_greedy_rate",
    GREEDY_SQL + "select user_id, size, gram, start_pos, matches, visited, round(matches / visited, 9) as rate from rated",
)
def ngram_greedy_rate(spark, folder):
    return _rates(spark, folder).select(
        "user_id", "size", "gram", "start_pos", "matches", "visited", F.round("rate", 9).alias("rate")
    )


@query(
    "maximal_patterns",
    GREEDY_SQL
    + """, f as (select * from rated where matches / visited >= 0.03)
    select user_id, size, gram, matches from f a where not exists
      (select 1 from f b where b.user_id = a.user_id and b.size > a.size and contains(',' || b.gram || ',', ',' || a.gram || ','))""",
)
def maximal_patterns(spark, folder):
    frequent = _rates(spark, folder).where(F.col("rate") >= 0.03).select("user_id", "size", "gram", "matches")
    return patterns.maximal_patterns(frequent, KEYS)


@query(
    "pattern_choice",
    GREEDY_SQL
    + """ select user_id, size, gram, matches from (select *, row_number() over (partition by user_id
          order by size, matches / visited desc, matches desc, gram) as rk from rated where size >= 2) where rk = 1""",
)
def pattern_choice(spark, folder):
    return patterns.pick_pattern(_rates(spark, folder).where(F.col("size") >= 2), KEYS).select("user_id", "size", "gram", "matches")


WALK_SQL = EV.replace("with ev", "with recursive ev") + """,
    hits as (select user_id, pos from (select user_id, pos, event_type as a, lead(event_type) over (partition by user_id order by pos) as b from ev)
             where a = 'click' and b = 'click'),
    walk as (select user_id, min(pos) as pos from hits group by 1
             union all
             select w.user_id, min(h.pos) from walk w join hits h on h.user_id = w.user_id and h.pos >= w.pos + 2 group by w.user_id, w.pos)
"""


@query("pattern_occurrences", WALK_SQL + "select user_id, pos from walk")
def pattern_occurrences(spark, folder):
    ev = events(spark, folder, "event_id", "user_id", "event_type")
    return patterns.occurrences(ev, KEYS, ORDER, "event_type", ["click", "click"])


@query(
    "pattern_members",
    WALK_SQL + "select e.user_id, e.event_id, e.pos, w.pos as start_pos from walk w join ev e on e.user_id = w.user_id and e.pos between w.pos and w.pos + 1",
)
def pattern_members(spark, folder):
    ev = events(spark, folder, "event_id", "user_id", "event_type")
    rows = patterns.pattern_members(ev, KEYS, ORDER, "event_type", ["click", "click"])
    return rows.select("user_id", "event_id", "pos", "start_pos")


@query(
    "pattern_split_stats",
    WALK_SQL
    + """, m as (select w.user_id, w.pos, min(ts_us) as f, max(ts_us) as l, count(*) as len from walk w join ev e
                on e.user_id = w.user_id and e.pos between w.pos and w.pos + 1 group by 1, 2),
    g as (select *, (lead(f) over (partition by user_id order by pos) - l) / 1e6 as gap from m)
    select user_id, count(*) as segments, cast(sum(len) as bigint) as covered, round(avg(gap), 4) as interval_mean,
           round(stddev_samp(gap), 4) as interval_std from g group by 1""",
)
def pattern_split_stats(spark, folder):
    ev = events(spark, folder, "event_id", "user_id", "event_type")
    members = patterns.pattern_members(ev, KEYS, ORDER, "event_type", ["click", "click"])
    stats = patterns.split_by_pattern(members, KEYS, "ts_us")
    return stats.select(
        "user_id", "segments", "covered", F.round("interval_mean", 4).alias("interval_mean"), F.round("interval_std", 4).alias("interval_std")
    )


CHUNK_SQL = EV + """, ch as (select user_id, cast(floor(pos / 3) as bigint) as chunk_no, count(*) as n, min(ts_us) as first_ts,
    max(ts_us) as last_ts, string_agg(event_type, ',' order by pos) as segment from ev group by 1, 2)
"""


def _chunks(spark, folder):
    ev = events(spark, folder, "event_id", "user_id", "event_type")
    return patterns.fixed_chunks(patterns.positions(ev, KEYS, ORDER), KEYS, 3, "ts_us", "event_type")


@query("fixed_period_chunks", CHUNK_SQL + "select * from ch")
def fixed_period_chunks(spark, folder):
    return _chunks(spark, folder)


GROUPS_SQL = CHUNK_SQL + ", gr as (select user_id, segment, count(*) as member_count, min(chunk_no) as first_chunk from ch where n = 3 group by 1, 2)"


def _groups(spark, folder):
    return patterns.segment_groups(_chunks(spark, folder).where(F.col("n") == 3), KEYS)


@query(
    "segment_top_groups",
    GROUPS_SQL + """select user_id, segment, member_count, first_chunk, cast(rk as int) as rank from (select *, row_number() over
      (partition by user_id order by member_count desc, first_chunk, segment) as rk from gr) where rk <= 3""",
)
def segment_top_groups(spark, folder):
    return patterns.top_segments(_groups(spark, folder), KEYS, 3)


@query(
    "segment_ratio_groups",
    GROUPS_SQL + "select user_id, segment, member_count from gr join (select user_id, max(member_count) as peak from gr group by 1) using (user_id) where member_count >= peak * 0.6",
)
def segment_ratio_groups(spark, folder):
    return patterns.segments_over_ratio(_groups(spark, folder), KEYS, 0.6).select("user_id", "segment", "member_count")


@query(
    "segment_interval_stats",
    CHUNK_SQL
    + """, g as (select *, (lead(first_ts) over (partition by user_id order by chunk_no) - last_ts) / 1e6 as gap,
                (last_ts - first_ts) / 1e6 as dur from ch where n = 3)
    select user_id, count(*) as segments, round(avg(gap), 4) as interval_mean, round(stddev_samp(gap), 4) as interval_std,
           round(avg(dur), 4) as duration_mean, round(stddev_samp(dur), 4) as duration_std,
           stddev_samp(gap) <= avg(gap) * 1.2 as steady from g group by 1""",
)
def segment_interval_stats(spark, folder):
    full = _chunks(spark, folder).where(F.col("n") == 3)
    seq = Ordered(full, KEYS, ["chunk_no"]).with_lead("next_ts", F.col("first_ts")).frame()
    gap = (F.col("next_ts") - F.col("last_ts")) / 1e6
    dur = (F.col("last_ts") - F.col("first_ts")) / 1e6
    return seq.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("segments"),
        F.round(F.avg(gap), 4).alias("interval_mean"),
        F.round(F.stddev_samp(gap), 4).alias("interval_std"),
        F.round(F.avg(dur), 4).alias("duration_mean"),
        F.round(F.stddev_samp(dur), 4).alias("duration_std"),
        (F.stddev_samp(gap) <= F.avg(gap) * 1.2).alias("steady"),
    )


@query(
    "segment_similarity",
    CHUNK_SQL
    + """, p as (select user_id, chunk_no, segment as b, lag(segment) over (partition by user_id order by chunk_no) as a from ch where n = 3),
    s as (select *, string_split(a, ',') as x, string_split(b, ',') as y from p where a is not null)
    select user_id, chunk_no,
      round(((x[1] = y[1])::int + (x[2] = y[2])::int + (x[3] = y[3])::int) / 3, 9) as positional,
      round(1 - levenshtein(replace(a, ',', ''), replace(b, ',', '')) / greatest(length(replace(a, ',', '')), length(replace(b, ',', ''))), 9) as edit
    from s""",
)
def segment_similarity(spark, folder):
    full = _chunks(spark, folder).where(F.col("n") == 3)
    seq = Ordered(full, KEYS, ["chunk_no"]).with_lag("prev", F.col("segment")).frame().where(F.col("prev").isNotNull())
    return seq.select(
        "user_id",
        "chunk_no",
        F.round(patterns.token_similarity(F.split("prev", ","), F.split("segment", ",")), 9).alias("positional"),
        F.round(patterns.edit_similarity(F.col("prev"), F.col("segment")), 9).alias("edit"),
    )


@query(
    "pattern_consistency",
    """
    with d as (select user_id, cast(floor(epoch_us(ts) / 604800000000) as bigint) as capture, count(*) as n,
                 (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 / count(*) as iv,
                 sum(case when event_type in ('purchase','error') then cast(floor(value) as bigint) else 0 end) as ssum,
                 arg_min(event_type, event_id) as pat from events group by 1, 2)
    select user_id, count(distinct capture) as captures, count(distinct pat) as patterns, count(distinct ssum) as length_sums,
           round(avg(iv), 4) as interval_mean, round(stddev_pop(iv), 4) as interval_std,
           round(stddev_pop(iv) / avg(iv), 8) as interval_cv, stddev_pop(iv) / avg(iv) <= 0.1 as interval_stable
    from d group by 1 having count(distinct capture) >= 2
    """,
)
def pattern_consistency(spark, folder):
    ev = events(spark, folder).withColumn("capture", F.floor(F.col("ts_us") / 604800000000))
    per = ev.groupBy("user_id", "capture").agg(
        ((F.max("ts_us") - F.min("ts_us")) / 1e6 / F.count(F.lit(1))).alias("iv"),
        F.sum(F.when(F.col("event_type").isin("purchase", "error"), F.floor("value")).otherwise(0)).alias("ssum"),
        F.min_by("event_type", "event_id").alias("pat"),
    )
    out = periods.consistency(per, "user_id", "capture", "pat", F.col("iv"), F.col("ssum"))
    return out.select(
        "user_id", "captures", "patterns", "length_sums", F.round("interval_mean", 4).alias("interval_mean"),
        F.round("interval_std", 4).alias("interval_std"), F.round("interval_cv", 8).alias("interval_cv"), "interval_stable",
    )


@query(
    "pattern_length_sum",
    EV + """select user_id, count(*) as n, cast(sum(case when token like 'S-%' then cast(split_part(token, '-', 2) as bigint) else 0 end) as bigint) as s_sum from ev group by 1""",
)
def pattern_length_sum(spark, folder):
    rows = tokens(spark, folder).withColumn("s", patterns.server_length_sum(F.col("token")))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("s_sum"))


@query(
    "downsample_rate",
    """
    with recursive ev as (select user_id, event_id, epoch_us(ts) as t from events),
    walk as (select user_id, min(t) as t from ev group by 1
             union all select w.user_id, min(e.t) from walk w join ev e on e.user_id = w.user_id and e.t >= w.t + 86400000000 group by w.user_id, w.t)
    select e.user_id, e.event_id, e.t as ts_us from ev e join walk w on e.user_id = w.user_id and e.t = w.t
    """,
)
def downsample_rate(spark, folder):
    ev = events(spark, folder, "event_id", "user_id")
    return greedy.greedy_select(ev, KEYS, "ts_us", F.lit(86_400_000_000), ORDER).select("user_id", "event_id", "ts_us")


@query(
    "cycle_segments",
    WALK_SQL.replace("walk as", "w1 as").replace("from walk w join", "from w1 w join")
    + """, hits2 as (select user_id, pos from (select user_id, pos, event_type as a, lead(event_type) over (partition by user_id order by pos) as b from ev)
             where a = 'view' and b = 'error'),
    md as (select user_id, case when coalesce(c1, 0) >= 2 then 1 when coalesce(c2, 0) >= 2 then 2 else 3 end as mode from
           (select distinct user_id from ev) left join (select user_id, count(*) as c1 from w1 group by 1) using (user_id)
           left join (select user_id, count(*) as c2 from hits2 group by 1) using (user_id)),
    fl as (select ev.user_id, ev.event_id, ev.pos, mode, case mode when 3 then ev.pos % 5 = 0
             when 1 then exists (select 1 from w1 where w1.user_id = ev.user_id and w1.pos = ev.pos)
             else exists (select 1 from hits2 where hits2.user_id = ev.user_id and hits2.pos = ev.pos) end as st
           from ev join md using (user_id)),
    cy as (select *, cast(sum(case when st then 1 else 0 end) over (partition by user_id order by pos) as bigint) as cycle from fl)
    select user_id, cycle, mode, count(*) as n, min(event_id) as first_event from cy where cycle > 0 group by 1, 2, 3""",
)
def cycle_segments(spark, folder):
    ev = events(spark, folder, "event_id", "user_id", "event_type")
    frequent = cycles.pattern_starts(ev, KEYS, ORDER, "event_type", ["click", "click"])
    periodic = cycles.pattern_starts(ev, KEYS, ORDER, "event_type", ["view", "error"])
    rows = cycles.cycles(patterns.positions(ev, KEYS, ORDER), KEYS, frequent, periodic, 5)
    return rows.groupBy("user_id", "cycle", "mode").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query(
    "payload_volume",
    """select source, lang, count(*) as payloads, cast(sum(strlen(text)) as bigint) as bytes, min(strlen(text)) as min_len,
       max(strlen(text)) as max_len, round(avg(strlen(text)), 6) as avg_len from documents group by 1, 2""",
)
def payload_volume(spark, folder):
    docs = table(spark, folder, "documents")
    out = cycles.volume(docs, ["source", "lang"], F.col("text").cast("binary"))
    return out.withColumn("avg_len", F.round("avg_len", 6))


@query(
    "merge_renumber",
    "select event_id, event_type, row_number() over (order by event_type, ts, event_id) - 1 as merged_index from events",
)
def merge_renumber(spark, folder):
    ev = events(spark, folder, "event_id", "event_type")
    return cycles.merge_captures(ev, "event_type", ORDER).select("event_id", "event_type", "merged_index")


@query(
    "capture_offsets",
    """with g as (select event_type, count(*) as n, min(epoch_us(ts)) as first_ts, max(epoch_us(ts)) as last_ts from events group by 1)
       select *, cast(sum(n) over (order by event_type) - n as bigint) as start_index from g""",
)
def capture_offsets(spark, folder):
    return cycles.capture_offsets(events(spark, folder, "event_type"), "event_type", "ts_us")


@query(
    "split_by_count",
    """select part_no, count(*) as n, min(event_id) as first_event, max(event_id) as last_event from
       (select event_id, cast(floor((row_number() over (order by ts, event_id) - 1) / 700) as bigint) as part_no from events) group by 1""",
)
def split_by_count(spark, folder):
    rows = cycles.split_by_count(events(spark, folder, "event_id"), ORDER, 700)
    return rows.groupBy("part_no").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event")
    )


# The event order is random, so the published thresholds find nothing here; the
# relaxed ones exercise the whole search.
LOOSE = periods.PeriodConfig(
    autocorr_threshold=0.05, max_lag=40, min_segments=3, similarity_threshold=0.5, time_jitter_ratio=5.0,
    coverage_threshold=0.2, start_prefix="C",
)


@query("period_identification")
def period_identification(spark, folder):
    ev = events(spark, folder, "event_id", "user_id", "event_type")
    direction = F.when(F.col("event_type").isin("purchase", "error"), "S").otherwise("C")
    rows = ev.withColumn("token", F.concat_ws("-", direction, "event_type"))
    return periods.identify_periods(rows, KEYS, ORDER, "ts_us", "token", LOOSE)


@query("period_lengths")
def period_lengths(spark, folder):
    return periods.periods_by_length(period_identification(spark, folder))
