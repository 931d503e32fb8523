"""Column profiles and constraints, series similarity, assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode.operators import matching, profiling, similarity
from tracelode.plans.ordered import Ordered
from tracelode.queries.registry import query
from tracelode.sources.tables import events, micros, table

KEYS = ["user_id"]
LINE = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def _profile_sql(table_name, columns):
    parts = []
    for c in columns:
        parts.append(f"select '{c}' as \"column\", cast({c} as varchar) as text, try_cast({c} as double) as number from {table_name}")
    return (
        "with v as (" + " union all ".join(parts) + """),
    c as (select "column", text, any_value(number) as number, count(*) as n from v group by 1, 2),
    b as (select "column", cast(sum(n) as bigint) as rows, cast(sum(case when text is null then n else 0 end) as bigint) as nulls, count(text) as distinct_values,
            max(n) filter (text is not null) as most_common, count(*) filter (n > 1 and text is not null) as repeated_values from c group by 1),
    m as (select "column", count(number) as numeric_rows, min(number) as min_value, max(number) as max_value, avg(number) as mean_value, stddev_samp(number) as std_value,
            bool_and(number = round(number)) filter (number is not null) as whole from v group by 1),
    p as (select *, rows - nulls as filled from b join m using ("column")),
    prof as (select *, case when numeric_rows > 0 and whole then 'int' when numeric_rows > 0 then 'float' else 'string' end as data_type,
       distinct_values = 1 as is_constant, most_common / filled as repetition_ratio,
       filled >= 3 and distinct_values > 1 and distinct_values <= 10 and distinct_values <= filled * 0.3 and filled > distinct_values and repeated_values >= distinct_values * 0.5 as is_enumeration from p)
    """
    )


PROFILE_COLUMNS = [
    "column", "rows", "nulls", "distinct_values", "most_common", "repeated_values", "min_value", "max_value", "data_type", "is_constant", "is_enumeration",
]
NUMERIC = """, case when numeric_rows > 0 then numeric_rows end as numeric_rows, round(mean_value, 6) as mean_value, round(std_value, 6) as std_value, round(repetition_ratio, 9) as repetition_ratio"""


def _shape(profiles):
    return profiles.select(
        *PROFILE_COLUMNS, "numeric_rows", F.round("mean_value", 6).alias("mean_value"), F.round("std_value", 6).alias("std_value"),
        F.round("repetition_ratio", 9).alias("repetition_ratio"),
    )


def _line_profile(spark, folder):
    return profiling.profile(profiling.value_counts(table(spark, folder, "lineitem").select(*LINE), LINE))


@query("column_profile", _profile_sql("lineitem", LINE) + "select " + ", ".join(f'"{c}"' for c in PROFILE_COLUMNS) + NUMERIC + " from prof")
def column_profile(spark, folder):
    return _shape(_line_profile(spark, folder))


PART = ["p_size", "p_retailprice", "p_brand", "p_type"]


@query("part_profile", _profile_sql("part", PART) + "select " + ", ".join(f'"{c}"' for c in PROFILE_COLUMNS) + NUMERIC + " from prof")
def part_profile(spark, folder):
    return _shape(profiling.profile(profiling.value_counts(table(spark, folder, "part").select(*PART), PART)))


TYPES = """, ty as (select "column", 'UINT8' as field_type from prof where data_type = 'int' and min_value >= 0 and max_value <= 255
  union all select "column", 'INT8' from prof where data_type = 'int' and min_value >= -128 and max_value <= 127
  union all select "column", 'UINT16' from prof where data_type = 'int' and min_value >= 0 and max_value <= 65535
  union all select "column", 'INT16' from prof where data_type = 'int' and min_value >= -32768 and max_value <= 32767
  union all select "column", 'UINT32' from prof where data_type = 'int' and min_value >= 0 and max_value <= 4294967295
  union all select "column", 'INT32' from prof where data_type = 'int' and min_value >= -2147483648 and max_value <= 2147483647
  union all select "column", unnest(['UINT64', 'INT64']) from prof where data_type = 'int'
  union all select "column", unnest(['FLOAT32', 'FLOAT64']) from prof where data_type = 'float'
  union all select "column", unnest(['ASCII_STRING', 'UTF8_STRING']) from prof where data_type = 'string')
"""


@query("type_candidates", _profile_sql("lineitem", LINE) + TYPES + 'select "column", field_type from ty')
def type_candidates(spark, folder):
    return profiling.field_types(_line_profile(spark, folder))


CONSTRAINTS = """, co as (select "column", 'constant' as kind, null::double as low, null::double as high, 0.85::double as confidence from prof where is_constant
  union all select "column", 'enumeration', null, null, 0.85 from prof where is_enumeration
  union all select "column", 'range', min_value, max_value, 0.85 from prof where data_type in ('int', 'float'))
"""


@query("column_constraints", _profile_sql("lineitem", LINE) + CONSTRAINTS + "select * from co")
def column_constraints(spark, folder):
    return profiling.constraints(_line_profile(spark, folder))


@query(
    "constraint_groups",
    _profile_sql("lineitem", LINE) + TYPES + CONSTRAINTS
    + """select "column", array_to_string(list_sort(list(distinct field_type)), ',') as field_types, any_value(nc) as constraint_count, any_value(coalesce(mc, 0.3)) as overall_confidence
    from ty left join (select "column", count(*) as nc, max(confidence) as mc from co group by 1) using ("column") group by 1""",
)
def constraint_groups(spark, folder):
    profiles = _line_profile(spark, folder)
    groups = profiling.constraint_groups(profiling.constraints(profiles), profiling.field_types(profiles))
    return groups.select(
        "column", F.array_join("field_types", ",").alias("field_types"), F.size("constraints").cast("long").alias("constraint_count"), "overall_confidence"
    )


@query(
    "constraint_evaluation",
    """with cols as (select 'l_linenumber' as "column", min(l_linenumber)::double as lo, max(l_linenumber)::double as hi, count(distinct l_linenumber) as d from lineitem
      union all select 'l_quantity', min(l_quantity), max(l_quantity), count(distinct l_quantity) from lineitem),
    f as (select p_brand as field, min(p_size)::double as mn, max(p_size)::double as mx, count(distinct p_size) as d from part group by 1),
    miss as (select p_brand as field, 'l_linenumber' as "column", count(*) filter (p_size not in (select distinct l_linenumber from lineitem)) as misses from part group by 1),
    e as (select field, "column", mn >= lo and mx <= hi as r, "column" = 'l_linenumber' as has_enum, f.d <= 10 and misses = 0 as en from f cross join cols left join miss using (field, "column")),
    s as (select field, "column", (case when r then 1 else 0 end) + (case when has_enum and en then 1 else 0 end) as matched, 1 + has_enum::int as total from e),
    k as (select *, least(1.0, matched * 0.85 / total + case when matched > 1 then least(0.2, (matched - 1) * 0.05) else 0 end) as confidence from s where matched > 0)
    select field, "column" as matched_column, round(confidence, 9) as confidence from (select *, row_number() over (partition by field order by confidence desc, "column") as rk from k) where rk = 1""",
)
def constraint_evaluation(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_linenumber", "l_quantity")
    rows = profiling.constraints(profiling.profile(profiling.value_counts(lines, ["l_linenumber", "l_quantity"])))
    parts = table(spark, folder, "part").select(F.col("p_brand").alias("field"), F.col("p_size").cast("double").alias("v"))
    values = parts.groupBy("field").agg(F.min("v").alias("min_value"), F.max("v").alias("max_value"), F.countDistinct("v").alias("distinct_values"))
    values = values.withColumn("increasing", F.lit(False)).withColumn("decreasing", F.lit(False))
    known = lines.select(F.col("l_linenumber").cast("double").alias("v")).distinct().withColumn("_k", F.lit(1))
    allowed = parts.join(F.broadcast(known), "v", "left").groupBy("field").agg(F.count_if(F.col("_k").isNull()).alias("misses"))
    out = profiling.evaluate_constraints(values, rows, allowed.withColumn("column", F.lit("l_linenumber")))
    return out.withColumn("confidence", F.round("confidence", 9))


@query(
    "monotonic_flags",
    """with s as (select o_custkey, o_orderkey, o_totalprice, epoch_us(o_orderdate) as t from orders),
    p as (select *, lag(o_totalprice) over (partition by o_custkey order by t, o_orderkey) as prev from s),
    c as (select o_custkey, count(prev) as steps, count(*) filter (o_totalprice >= prev) as ge, count(*) filter (o_totalprice > prev) as gt,
            count(*) filter (o_totalprice <= prev) as le, count(*) filter (o_totalprice < prev) as lt from p group by 1)
    select o_custkey, coalesce(steps >= 2 and ge / steps > 0.8 and gt / steps > 0.3, false) as increasing,
           coalesce(steps >= 2 and le / steps > 0.8 and lt / steps > 0.3, false) as decreasing, steps + 1 as n from c""",
)
def monotonic_flags(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice", micros("o_orderdate").alias("t"))
    return profiling.monotonic(orders, ["o_custkey"], ["t", "o_orderkey"], "o_totalprice")


@query(
    "enum_flags",
    """with c as (select c_nationkey, c_mktsegment, count(*) as n from customer group by 1, 2)
    select c_nationkey, cast(sum(n) as bigint) as total, count(*) as uniques,
      sum(n) >= 3 and count(*) > 1 and count(*) <= 10 and count(*) <= sum(n) * 0.3 and sum(n) > count(*) and count(*) filter (n > 1) >= count(*) * 0.5 as is_enumeration,
      round(max(n) / sum(n), 9) as max_repetition from c group by 1""",
)
def enum_flags(spark, folder):
    counts = table(spark, folder, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    total, uniques, repeated = F.sum("n"), F.count(F.lit(1)), F.count_if(F.col("n") > 1)
    return counts.groupBy("c_nationkey").agg(
        total.alias("total"), uniques.alias("uniques"), profiling.enumeration(total, uniques, repeated).alias("is_enumeration"),
        F.round(F.max("n") / total, 9).alias("max_repetition"),
    )


@query(
    "dynamic_columns",
    _profile_sql("lineitem", LINE) + """select "column" from prof where not is_constant and most_common < rows * 0.3 and numeric_rows = filled""",
)
def dynamic_columns(spark, folder):
    names = profiling.dynamic_columns(_line_profile(spark, folder), 0.3)
    return _line_profile(spark, folder).where(F.col("column").isin(names)).select("column")


@query(
    "dynamic_in_ranges",
    """with r as (select l_returnflag as range_id, min(epoch_us(l_shipdate)) as s, min(epoch_us(l_shipdate)) + 864000000000 as e from lineitem group by 1),
    x as (select range_id, l_linenumber as a, l_discount as b, l_tax * 0 as c from lineitem join r on epoch_us(l_shipdate) between s and e),
    d as (select range_id, min(a) <> max(a) as a, min(b) <> max(b) as b, min(c) <> max(c) as c from x group by 1),
    l as (select 'l_linenumber' as "column", a as d from d union all select 'l_discount', b from d union all select 'zero', c from d)
    select "column", bool_or(d) as dynamic_any, bool_and(d) as dynamic_all from l group by 1""",
)
def dynamic_in_ranges(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_returnflag", micros("l_shipdate").alias("t"), "l_linenumber", "l_discount", (F.col("l_tax") * 0).alias("zero")
    )
    ranges = lines.groupBy(F.col("l_returnflag").alias("range_id")).agg(F.min("t").alias("start"), (F.min("t") + 864000000000).alias("end"))
    return profiling.dynamic_in_ranges(lines, "t", ["l_linenumber", "l_discount", "zero"], ranges)


@query(
    "fill_majority",
    """with ev as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as pos,
        case when event_id % 7 in (0, 1, 2) then null else event_type end as v from events),
    votes as (select m.user_id, m.event_id, k.v, count(*) as c, min(k.pos) as f from ev m join ev k on k.user_id = m.user_id and k.pos between m.pos - 5 and m.pos + 5 and k.v is not null
              where m.v is null group by 1, 2, 3),
    best as (select user_id, event_id, v from (select *, row_number() over (partition by user_id, event_id order by c desc, f) as rk from votes) where rk = 1),
    gm as (select user_id, v from (select *, row_number() over (partition by user_id order by c desc, f) as rk from
           (select user_id, v, count(*) as c, min(pos) as f from ev where v is not null group by 1, 2)) where rk = 1)
    select ev.event_id, coalesce(ev.v, best.v, gm.v) as v from ev left join best using (user_id, event_id) left join gm on gm.user_id = ev.user_id""",
)
def fill_majority(spark, folder):
    ev = events(spark, folder, "event_id", "user_id", "event_type")
    holes = ev.withColumn("v", F.when(~(F.col("event_id") % 7).isin(0, 1, 2), F.col("event_type")))
    return profiling.fill_majority(holes, KEYS, ["ts_us", "event_id"], "v").select("event_id", "v")


@query(
    "whole_numbers",
    "select l_orderkey, l_linenumber, cast(l_quantity as bigint) as l_quantity, l_discount, cast(l_extendedprice * 100 as double) as cents from lineitem",
)
def whole_numbers(spark, folder):
    rows = table(spark, folder, "lineitem")
    fixed = profiling.whole_numbers(rows.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice"), ["l_quantity", "l_discount"])
    return fixed.withColumn("cents", F.col("l_extendedprice") * 100).drop("l_extendedprice")


@query(
    "column_groups",
    """with c as (select distinct p_brand, p_size from part), n as (select 'P' || p_size || '_STATE' as name, 'swat' as ds from c
      union all select 'LIT' || (100 + p_size) || '.Pv', 'swat' from c union all select p_brand || '.Pv', 'swat' from c
      union all select 'HMI_' || p_size || '_PV', 'wadi' from c union all select p_brand || '.TIED' || p_size || '.V', 'epic' from c union all select p_brand || '.X.V', 'epic' from c),
    k as (select distinct name, ds from n),
    g as (select name, ds, case ds when 'wadi' then regexp_extract(name, '^(HMI_[0-9]+)', 1) when 'epic' then case when split_part(name, '.', 2) like '%IED%' then split_part(name, '.', 1) end
      else case when regexp_matches(name, '^P[0-9]') then name[2] else case when regexp_matches(split_part(name, '.', 1)[-3], '^[0-9]$') then split_part(name, '.', 1)[-3] end end end as group_id from k)
    select ds, group_id, count(*) as columns from g where group_id is not null group by 1, 2""",
)
def column_groups(spark, folder):
    c = table(spark, folder, "part").select("p_brand", F.col("p_size").cast("string").alias("s")).distinct()
    hundred = (F.col("s").cast("int") + 100).cast("string")
    names = {
        "swat": [F.concat(F.lit("P"), "s", F.lit("_STATE")), F.concat(F.lit("LIT"), hundred, F.lit(".Pv")), F.concat("p_brand", F.lit(".Pv"))],
        "wadi": [F.concat(F.lit("HMI_"), "s", F.lit("_PV"))],
        "epic": [F.concat("p_brand", F.lit(".TIED"), "s", F.lit(".V")), F.concat("p_brand", F.lit(".X.V"))],
    }
    parts = []
    for ds, exprs in names.items():
        rows = c.select(F.lit(ds).alias("ds"), F.explode(F.array(*exprs)).alias("name")).distinct()
        parts.append(rows.withColumn("group_id", profiling.column_group(F.col("name"), ds)))
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return union.where(F.col("group_id").isNotNull()).groupBy("ds", "group_id").agg(F.count(F.lit(1)).alias("columns"))


PAIR = """
with a0 as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value as v from events where event_type = 'click'),
b0 as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value as v from events where event_type = 'view'),
sa as (select user_id, count(*) as a_n, avg(v) as a_mean, stddev_pop(v) as a_std, min(v) as a_min, max(v) as a_max from a0 group by 1),
sb as (select user_id, count(*) as b_n, avg(v) as b_mean, stddev_pop(v) as b_std, min(v) as b_min, max(v) as b_max from b0 group by 1),
pr as (select * from sa join sb using (user_id))
"""


def pair(spark, folder):
    ev = events(spark, folder, "event_id", "user_id", "event_type", "value")

    def side(kind):
        rows = Ordered(ev.where(F.col("event_type") == kind), KEYS, ["ts_us", "event_id"]).with_row_number("i").frame()
        return rows.select("user_id", "i", F.col("value").alias("v"))

    return side("click"), side("view")


@query(
    "similarity_positional",
    PAIR + """, j as (select user_id, a0.v as x, b0.v as y from a0 join b0 using (user_id, i))
    select user_id, count(*) as m, round(case when stddev_pop(x) < 1e-10 or stddev_pop(y) < 1e-10 then 0 else covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) end, 7) as pearson,
      round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 7) as cosine from j group by 1""",
)
def similarity_positional(spark, folder):
    sums = similarity.positional(*pair(spark, folder), KEYS)
    return sums.select("user_id", "m", F.round(similarity.pearson(sums), 7).alias("pearson"), F.round(similarity.cosine(sums), 7).alias("cosine"))


@query(
    "similarity_ranges",
    PAIR + """select user_id, round(greatest(0, least(a_max, b_max) - greatest(a_min, b_min)) / (greatest(a_max, b_max) - least(a_min, b_min)), 7) as overlap,
      round(exp(-abs(a_std / a_mean - b_std / b_mean)), 7) as cv from pr""",
)
def similarity_ranges(spark, folder):
    rows = similarity.both(*pair(spark, folder), KEYS)
    return rows.select("user_id", F.round(similarity.range_overlap(), 7).alias("overlap"), F.round(similarity.cv_similarity(), 7).alias("cv"))


@query(
    "similarity_kl",
    PAIR + """, bi as (select *, least(20, greatest(5, cast(floor(sqrt(a_n)) as int))) as bins from pr),
    ha as (select user_id, least(cast(floor((v - a_min) / (a_max - a_min) * bins) as int), bins - 1) as bin, count(*) as c from a0 join bi using (user_id) group by 1, 2),
    hb as (select user_id, least(cast(floor((v - b_min) / (b_max - b_min) * bins) as int), bins - 1) as bin, count(*) as c from b0 join bi using (user_id) group by 1, 2),
    g as (select user_id, bins, a_n, b_n, unnest(range(bins)) as bin from bi),
    c as (select g.*, (coalesce(ha.c, 0) + 1e-10) / (a_n + bins * 1e-10) as p, (coalesce(hb.c, 0) + 1e-10) / (b_n + bins * 1e-10) as q
          from g left join ha using (user_id, bin) left join hb using (user_id, bin))
    select user_id, round(exp(-sum(p * ln(p / q))), 7) as kl_similarity from c group by 1""",
)
def similarity_kl(spark, folder):
    left, right = pair(spark, folder)
    out = similarity.kl_similarity(left, right, similarity.both(left, right, KEYS), KEYS)
    return out.withColumn("kl_similarity", F.round("kl_similarity", 7))


@query(
    "similarity_quantiles",
    PAIR + """, o as (select user_id, greatest(a_min, b_min) as lo, least(a_max, b_max) as hi, least(0.1 * a_mean, 0.1 * b_mean) as eps from pr),
    qa as (select user_id, quantile_cont(v, [0.25, 0.5, 0.75]) as q from a0 join o using (user_id) where v between lo and hi group by 1),
    qb as (select user_id, quantile_cont(v, [0.25, 0.5, 0.75]) as r from b0 join o using (user_id) where v between lo and hi group by 1)
    select user_id, case when lo < hi then round((coalesce((abs(q[1] - r[1]) <= eps)::int, 0) + coalesce((abs(q[2] - r[2]) <= eps)::int, 0) + coalesce((abs(q[3] - r[3]) <= eps)::int, 0)) / 3, 9) else 0 end as quantile_similarity
    from o left join qa using (user_id) left join qb using (user_id)""",
)
def similarity_quantiles(spark, folder):
    left, right = pair(spark, folder)
    out = similarity.quantile_similarity(left, right, similarity.both(left, right, KEYS), KEYS)
    return out.withColumn("quantile_similarity", F.round("quantile_similarity", 9))


@query(
    "similarity_precision3",
    PAIR + """, d as (select a0.user_id, a0.i, abs(a0.v - b0.v) as d, row_number() over (partition by a0.user_id, a0.i order by abs(a0.v - b0.v)) as rk from a0 join b0 using (user_id)),
    m as (select user_id, i, avg(d) as d from d where rk <= 3 group by 1, 2)
    select user_id, round(count(*) filter (d <= least(0.1 * a_mean, 0.1 * b_mean)) / count(*), 9) as precision_k from m join pr using (user_id) group by 1""",
)
def similarity_precision3(spark, folder):
    left, right = pair(spark, folder)
    out = similarity.precision_k(left, right, similarity.both(left, right, KEYS), KEYS)
    return out.withColumn("precision_k", F.round("precision_k", 9))


@query("similarity_weighted")
def similarity_weighted(spark, folder):
    left, right = pair(spark, folder)
    return similarity.weighted_scores(left, right, KEYS)


@query(
    "similarity_windows",
    """with a0 as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value as v from events where event_type = 'click'),
    b0 as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value as v from events where event_type <> 'click'),
    n as (select user_id, la, lb from (select user_id, count(*) as la from a0 group by 1) join (select user_id, count(*) as lb from b0 group by 1) using (user_id)),
    p as (select *, least(la, lb) as w, greatest(la, lb) as g, greatest(1, (greatest(la, lb) - least(la, lb) + 1) // least(10, greatest(la, lb) - least(la, lb) + 1)) as st from n),
    k as (select *, unnest(range(case when g > w * 2 then (g - w) // st + 1 else 1 end)) as win from p),
    j as (select k.user_id, win as "window", a0.v as x, b0.v as y from k join a0 on a0.user_id = k.user_id join b0 on b0.user_id = k.user_id
          and a0.i - (case when g > w * 2 and la > lb then win * st else 0 end) = b0.i - (case when g > w * 2 and lb > la then win * st else 0 end)
          and (g <= w * 2 or (a0.i - (case when la > lb then win * st else 0 end) between 0 and w - 1 and b0.i - (case when lb > la then win * st else 0 end) between 0 and w - 1)))
    select user_id, "window", count(*) as m, round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 7) as cosine from j group by 1, 2""",
)
def similarity_windows(spark, folder):
    ev = events(spark, folder, "event_id", "user_id", "event_type", "value")

    def side(rows):
        return Ordered(rows, KEYS, ["ts_us", "event_id"]).with_row_number("i").frame().select("user_id", "i", F.col("value").alias("v"))

    left = side(ev.where(F.col("event_type") == "click"))
    right = side(ev.where(F.col("event_type") != "click"))
    a, b = similarity.sliding_pairs(left, right, KEYS)
    sums = similarity.positional(a, b, [*KEYS, "window"])
    return sums.select("user_id", "window", "m", F.round(similarity.cosine(sums), 7).alias("cosine"))


@query(
    "presence_ratio",
    """with a as (select c_nationkey as n, c_mktsegment as v from customer), s as (select distinct s_nationkey as n, case when s_acctbal > 3000 then 'BUILDING' when s_acctbal > 0 then 'MACHINERY' else 'HOUSEHOLD' end as v from supplier)
    select n, round(count(*) filter (exists (select 1 from s where s.n = a.n and s.v = a.v)) / count(*), 9) as presence from a group by 1""",
)
def presence_ratio(spark, folder):
    left = table(spark, folder, "customer").select(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("v"))
    bal = F.col("s_acctbal")
    kind = F.when(bal > 3000, "BUILDING").when(bal > 0, "MACHINERY").otherwise("HOUSEHOLD")
    right = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("n"), kind.alias("v"))
    return similarity.presence_ratio(left, right, ["n"]).withColumn("presence", F.round("presence", 9))


def mean_score():
    """Mean balance in millionths of 10,000, from whole cents, so that no tie depends on the order of a sum."""
    cents, n = F.sum(F.round(F.col("c_acctbal") * 100).cast("long")), F.count(F.lit(1))
    twice = 2 * cents + n
    return ((twice - F.pmod(twice, 2 * n)) / (2 * n) / 1_000_000.0).alias("score")


def scores(spark, folder):
    """Nation x segment score table, one row per pair."""
    cust = table(spark, folder, "customer").groupBy("c_nationkey", "c_mktsegment")
    return cust.agg(mean_score()).withColumnsRenamed({"c_nationkey": "group_id", "c_mktsegment": "session"})


# the mean balance in millionths of 10,000, from whole cents
CENTS = """(select c_nationkey, c_mktsegment, 2 * sum(cast(round(c_acctbal * 100) as bigint))::bigint + count(*) as t, 2 * count(*) as d from customer group by 1, 2)"""
SCORES = f"with s as (select c_nationkey as group_id, c_mktsegment as session, (t - ((t % d) + d) % d) / d / 1000000.0::double as score from {CENTS})"
GREEDY = SCORES.replace("with s", "with recursive s") + """,
o as (select *, row_number() over (order by score desc, group_id, session) as rk from s),
w as (select 0::bigint as rk, []::int[] as gs, []::varchar[] as ss
      union all select o.rk, case when list_contains(gs, group_id) or list_contains(ss, session) then gs else list_append(gs, group_id) end,
        case when list_contains(gs, group_id) or list_contains(ss, session) then ss else list_append(ss, session) end from w join o on o.rk = w.rk + 1),
f as (select gs, ss from w order by rk desc limit 1)
"""


@query(
    "greedy_assignment",
    GREEDY + "select p.group_id, p.session, score from (select unnest(gs) as group_id, unnest(ss) as session from f) p join s using (group_id, session)",
)
def greedy_assignment(spark, folder):
    return matching.greedy_assignment(scores(spark, folder), "group_id", "session", "score")


@query(
    "reusable_assignment",
    SCORES + " select group_id, session, score from (select *, row_number() over (partition by group_id order by score desc, session) as rk from s) where rk = 1",
)
def reusable_assignment(spark, folder):
    return matching.reusable_assignment(scores(spark, folder), "group_id", "session", "score")


def claim_table(spark, folder):
    rows = table(spark, folder, "customer").groupBy("c_nationkey", "c_mktsegment").agg(mean_score())
    return rows.select(
        (F.col("c_nationkey") % 5).alias("session"), F.concat(F.lit("col"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("column"),
        F.col("c_mktsegment").alias("field"), "score", F.lit(0.4).alias("threshold"),
    )


def _claims_sql(name: str, limit: float, rounds: int = 6) -> str:
    """Rounds of claims written out; every round settles a field, and there are five."""
    parts = [f"{name}_r0 as (select session, \"column\", field, score from base where score > {limit})"]
    for k in range(1, rounds + 1):
        w, v, r, before = f"{name}_w{k}", f"{name}_v{k}", f"{name}_r{k}", f"{name}_r{k - 1}"
        parts += [
            f"{w} as (select session, \"column\", arg_min(field, (-score, field)) as field, max(score) as score from {before} group by 1, 2)",
            f"{v} as (select session, arg_min(\"column\", (-score, \"column\")) as \"column\", field, max(score) as score, count(*) as n from {w} group by 1, 3)",
            f"""{r} as (select * from {before} b where session in (select session from {v} where n > 1)
                and not exists (select 1 from {v} v where v.session = b.session and (v."column" = b."column" or v.field = b.field)))""",
        ]
    union = " union all ".join(f"select session, \"column\", field, score from {name}_v{k}" for k in range(1, rounds + 1))
    return ", ".join([*parts, f"{name} as ({union})"])


CLAIM_BASE = """with base as (select c_nationkey % 5 as session, 'col' || lpad(cast(c_nationkey as varchar), 2, '0') as "column", c_mktsegment as field,
    (t - ((t % d) + d) % d) / d / 1000000.0::double as score from """ + CENTS + """), """


@query("column_claims", CLAIM_BASE + _claims_sql("won", 0.4) + " select * from won")
def column_claims(spark, folder):
    return matching.column_claims(claim_table(spark, folder), ["session"], "column", "field", "score", "threshold")


@query(
    "solution_scores",
    CLAIM_BASE + _claims_sql("low", 0.4) + ", " + _claims_sql("high", 0.45)
    + """, t as (select session, count(distinct "column") as columns from base group by 1),
    m as (select session, solution, avg(score) as avg_score, count(*) as matched, any_value(reward) as reward
          from (select *, 0 as solution, 0.6 as reward from low union all select *, 1, 0.7 from high) group by 1, 2),
    s as (select m.*, columns, 0.7 * (avg_score * 0.7 + matched / columns * 0.3) + 0.3 * reward as total_score from m join t using (session))
    select session, solution, round(avg_score, 12) as avg_score, matched, cast(reward as double) as reward, columns, round(total_score, 12) as total_score
    from (select *, row_number() over (partition by session order by total_score desc, solution) as rk from s) where rk = 1""",
)
def solution_scores(spark, folder):
    """Best of two candidate thresholds ("solutions") per session by the blended score."""
    table_ = claim_table(spark, folder)
    parts = []
    for name, limit, reward in ((0, 0.4, 0.6), (1, 0.45, 0.7)):
        won = matching.column_claims(table_.withColumn("threshold", F.lit(limit)), ["session"], "column", "field", "score", "threshold")
        parts.append(won.withColumn("solution", F.lit(name)).withColumn("reward", F.lit(reward)))
    totals = table_.groupBy("session").agg(F.countDistinct("column").alias("columns"))
    best = matching.best_solutions(parts[0].unionByName(parts[1]), totals, ["session"], "solution", "score", "reward")
    return best.withColumns({c: F.round(c, 12) for c in ("avg_score", "total_score")})


@query(
    "unmatched_columns",
    CLAIM_BASE + _claims_sql("won", 0.4)
    + """ select session, "column", arg_max(field, (score, field)) as best_field, max(score) as best_score from base b
    where not exists (select 1 from won w where w.session = b.session and w."column" = b."column") group by 1, 2""",
)
def unmatched_columns(spark, folder):
    rows = claim_table(spark, folder)
    won = matching.column_claims(rows, ["session"], "column", "field", "score", "threshold")
    return matching.unmatched_best(rows, won, ["session"], "column", "field", "score")


@query(
    "top_matches",
    SCORES + " select group_id, session, score, cast(rk as int) as rank from (select *, row_number() over (partition by group_id order by score desc, session) as rk from s) where rk <= 2",
)
def top_matches(spark, folder):
    return matching.top_matches(scores(spark, folder), ["group_id"], "score", "session", 2)
