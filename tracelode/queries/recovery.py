"""Recovery of process values: decoding by spec tables, fields against columns, solutions of sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode.operators import recovery
from tracelode.plans.ordered import Ordered
from tracelode.queries.registry import query
from tracelode.session import materialize
from tracelode.sources.tables import table

KEYS = ["session"]
# name, start, length, type; the byte order of the longer integers follows the nation
FIELDS = [
    ("head", 0, 4, "UINT32"), ("wide", 10, 8, "UINT64"), ("word", 14, 4, "INT32"), ("stamp", 14, 4, "TIMESTAMP"), ("pair", 16, 2, "UINT16"), ("raw", 16, 2, "BINARY"),
    ("digit", 17, 1, "UINT8"), ("small", 17, 1, "INT8"), ("level", 18, 4, "FLOAT32"), ("segment", 22, 8, "ASCII_STRING"), ("address", 14, 4, "IPV4"), ("late", 28, 8, "UINT64"),
]
ORDERED = ("wide", "word", "pair", "late")
PERIOD = 40
THRESHOLD = 0.45
WEIGHTS = {"kl": 0.15, "cosine": 0.15, "range": 0.4, "cv": 0.15}


def payloads(spark, folder):
    text = F.concat("c_name", F.lit("B"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"), "c_mktsegment")
    return table(spark, folder, "customer").select(F.col("c_nationkey").alias("session"), F.col("c_custkey").alias("seq"), text.cast("binary").alias("payload"))


def specs(spark, folder, fields=FIELDS):
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("session"))
    order = F.when(F.col("session") % 2 == 0, "big").otherwise("little")

    def spec(name, start, length, kind):
        endian = order if name in ORDERED else F.lit("n/a" if length == 1 or kind in recovery.TEXTS else "big")
        return F.struct(F.lit(name).alias("field"), F.lit(start).alias("start"), F.lit(length).alias("length"), F.lit(kind).alias("type"), endian.alias("endian"))

    return nations.select("session", F.explode(F.array(*(spec(*f) for f in fields))).alias("f")).select("session", "f.*")


PAYLOADS = """pl as (select c_nationkey as session, c_custkey as seq, c_name || 'B' || lpad(cast(c_custkey % 1000 as varchar), 3, '0') || c_mktsegment as p from customer)"""


def _specs_sql(fields=FIELDS):
    rows = ", ".join(f"('{n}', {s}, {w}, '{t}', {'true' if n in ORDERED else 'false'}, '{'n/a' if w == 1 or t in recovery.TEXTS else 'big'}')" for n, s, w, t in fields)
    return f"""sp as (select n_nationkey as session, field, start, length, type, case when turns then case when n_nationkey % 2 = 0 then 'big' else 'little' end else e end as endian
      from nation, (values {rows}) f(field, start, length, type, turns, e))"""


# the unsigned value of every field byte by byte, then one rule for each type
DECODED = """
u as (select session, seq, field, type, length, p[start + 1 : start + length] as s,
    case when start + length <= length(p) then list_sum(list_transform(range(length), lambda i: ascii(p[start + 1 + i])::hugeint * (256::hugeint ** (case when endian = 'little' then i else length - 1 - i end))::hugeint))::hugeint end as n
    from pl join sp using (session)),
fb as (select *, case when type = 'FLOAT32' then n::bigint end as b from u),
de as (select session, seq, field, type,
    case when type like 'UINT%' then n::double
      when type like 'INT%' then case when n >= 128::hugeint * 256 ** (length - 1) then (n::double - 256.0 ** length) else n::double end
      when type = 'FLOAT32' then round((1 + (b % 8388608) / 8388608.0) * 2.0 ** ((b >> 23) - 127), 6)
      when type = 'TIMESTAMP' then case when n <= 2524608000 then n::double * 1000 when n >= 2208988800 then (n::double - 2208988800) * 1000 end end as number,
    case when n is null then null when type = 'ASCII_STRING' then s when type = 'BINARY' then lower(hex(s))
      when type = 'IPV4' then concat_ws('.', ascii(s[1]), ascii(s[2]), ascii(s[3]), ascii(s[4])) end as text
    from fb)"""
BASE = f"with {PAYLOADS}, {_specs_sql()}, {DECODED}"


@query("decoded_fields", BASE + " select * from de")
def decoded_fields(spark, folder):
    return recovery.decoded(payloads(spark, folder), specs(spark, folder), KEYS, ["seq"])


@query(
    "value_table",
    BASE + """ select session, seq, max(number) filter (field = 'word') as word, max(number) filter (field = 'level') as level, max(number) filter (field = 'late') as late,
      max(text) filter (field = 'segment') as segment, null::double as missing from de group by 1, 2""",
)
def value_table(spark, folder):
    columns = {"word": "number", "level": "number", "late": "number", "segment": "text", "missing": "number"}
    return recovery.value_table(payloads(spark, folder), specs(spark, folder), KEYS, ["seq"], columns)


def alignment(spark, folder):
    """Two solutions for each session; a group takes the session and solution of its number, and maps columns to fields."""
    fields = specs(spark, folder)
    shifted = fields.withColumn("start", F.when(F.col("field") == "pair", F.col("start") - 1).otherwise(F.col("start")))
    solutions = fields.withColumn("solution", F.lit(0)).unionByName(shifted.withColumn("solution", F.lit(1)))
    groups = table(spark, folder, "nation").select(F.concat(F.lit("g"), "n_regionkey").alias("group_id"), F.col("n_nationkey").alias("session"))
    selected = groups.withColumn("solution", (F.col("session") % 2).cast("int"))
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(f).alias("field")) for c, f in (("PV1.level", "level"), ("PV2.pair", "pair"), ("PV3.kind", "segment"))))
    both = selected.withColumn("solution", F.explode(F.array(F.lit(0), F.lit(1))))
    mapping = both.select("group_id", "session", "solution", F.explode(pairs).alias("m")).select("group_id", "session", "solution", "m.*")
    return selected, mapping, solutions


ALIGNED = f"""with {PAYLOADS}, {_specs_sql()}, al as (select 'g' || n_regionkey as group_id, s.session, 'PV' || case field when 'level' then '1.level' when 'pair' then '2.pair' else '3.kind' end as field,
    case when field = 'pair' and s.session % 2 = 1 then start - 1 else start end as start, length, type, endian
    from sp s join nation on n_nationkey = s.session where field in ('level', 'pair', 'segment'))"""


@query("alignment_field_specs", ALIGNED + " select * from al")
def alignment_field_specs(spark, folder):
    return recovery.alignment_specs(*alignment(spark, folder))


@query(
    "recovered_values",
    ALIGNED.replace(", al as", ", al0 as") + ", sq as (select session, field, start, length, type, endian from al0), "
    + DECODED.replace("join sp using", "join sq using")
    + """ select group_id, session, seq, max(number) filter (field = 'PV1.level') as "PV1.level", max(number) filter (field = 'PV2.pair') as "PV2.pair", max(text) filter (field = 'PV3.kind') as "PV3.kind"
      from de join (select distinct group_id, session from al0) using (session) group by 1, 2, 3""",
)
def recovered_values(spark, folder):
    """Process values of all payloads by the specs that the alignment result selects."""
    found = recovery.alignment_specs(*alignment(spark, folder))
    groups = found.select("group_id", "session").distinct()
    columns = {"PV1.level": "number", "PV2.pair": "number", "PV3.kind": "text"}
    return recovery.value_table(payloads(spark, folder), found.drop("group_id"), KEYS, ["seq"], columns).join(groups, "session")


# ---- fields against columns ------------------------------------------------------------------------------------------

SCORED = [f for f in FIELDS if f[0] in ("head", "word", "pair", "digit", "level", "segment")]
COLUMN_KINDS = {"unit": "int", "two": "int", "gauge": "float", "price": "float", "kind": "text", "priority": "text"}


def series_of_fields(spark, folder):
    return recovery.field_series(payloads(spark, folder), specs(spark, folder, SCORED), KEYS, ["seq"], PERIOD)


def series_of_columns(spark, folder):
    """Historian columns of a nation: values of its customers' orders."""
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("session"), F.substring("c_mktsegment", 1, 8).alias("kind"))
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority").join(customers, "o_custkey")
    one, ten = F.col("o_custkey") % 10, F.pmod(F.floor(F.col("o_custkey") / 10), F.lit(10))
    values = {
        "unit": (48 + one, None), "two": ((48 + ten) * 256 + 48 + one, None), "gauge": (44 + (F.col("o_custkey") % 1000) / 4000.0, None), "price": (F.col("o_totalprice"), None),
        "kind": (None, F.col("kind")), "priority": (None, F.col("o_orderpriority")),
    }
    number = lambda v: (F.lit(None) if v is None else v).cast("double").alias("v")
    text = lambda v: (F.lit(None) if v is None else v).cast("string").alias("text")
    numbered = Ordered(rows, KEYS, ["o_orderkey"]).with_row_number("i").frame()
    cells = F.array(*(F.struct(F.lit(n).alias("name"), number(v), text(t)) for n, (v, t) in values.items()))
    return numbered.select("session", "i", F.explode(cells).alias("c")).select("session", "c.name", "i", "c.v", "c.text")


def column_class():
    return F.when(F.col("name").isin("unit", "two"), "int").when(F.col("name").isin("gauge", "price"), "float").otherwise("text")


SERIES = f"""with recursive {PAYLOADS}, {_specs_sql(SCORED)},
thin as (select session, min(seq) as seq from pl group by 1
    union all select t.session, (select min(x.seq) from pl x where x.session = t.session and x.seq >= t.seq + {PERIOD}) from thin t
    where exists (select 1 from pl x where x.session = t.session and x.seq >= t.seq + {PERIOD})),
pt as (select pl.* from pl join thin using (session, seq)), {DECODED.replace('from pl join', 'from pt join')},
fs as (select session, field as name, case when type like '%INT%' then 'int' when type like 'FLOAT%' then 'float' else 'text' end as kind,
    row_number() over (partition by session, field order by seq) - 1 as i, number as v, text from de where number is not null or text is not null),
ho as (select c_nationkey as session, o_orderkey, o_custkey as k, o_totalprice, c_mktsegment[1:8] as seg, o_orderpriority as pri from orders join customer on o_custkey = c_custkey),
hi as (select *, row_number() over (partition by session order by o_orderkey) - 1 as i from ho),
cs as (select session, 'unit' as name, 'int' as kind, i, (48 + k % 10)::double as v, null as text from hi
    union all select session, 'two', 'int', i, ((48 + (k // 10) % 10) * 256 + 48 + k % 10)::double, null from hi
    union all select session, 'gauge', 'float', i, 44 + (k % 1000) / 4000.0::double, null from hi
    union all select session, 'price', 'float', i, o_totalprice, null from hi
    union all select session, 'kind', 'text', i, null, seg from hi union all select session, 'priority', 'text', i, null, pri from hi),
fp as (select session, name, kind, sum(c)::bigint as n, min(v) as low, max(v) as high, count(*) as values, max(c) / sum(c) as repetition from (select session, name, kind, v, text, count(*) as c from fs group by all) group by 1, 2, 3),
cp as (select session, name, kind, min(v) as low, max(v) as high from cs group by 1, 2, 3)"""


@query("field_profiles", SERIES + " select session, name, kind, n, low, high, values, round(repetition, 9) as repetition from fp")
def field_profiles(spark, folder):
    rows = recovery.series_profiles(series_of_fields(spark, folder), KEYS, recovery.value_class(F.col("type")))
    return rows.withColumn("repetition", F.round("repetition", 9))


PAIRS = """, op as (select * from fp where values > 1 and not (kind = 'float' and high < 1e-10)),
pr as (select o.session, o.name as field, cp.name as "column", kind from op o join cp using (session, kind))"""


@query(
    "field_column_pairs",
    SERIES + PAIRS.replace("from op o join cp using (session, kind))", "from op o join cp using (session, kind) where kind = 'text' or (o.low >= cp.low * 0.9 and o.high <= cp.high * 1.1))") + " select * from pr",
)
def field_column_pairs(spark, folder):
    """Pairs that the gates of class and range let through."""
    fields = recovery.series_profiles(series_of_fields(spark, folder), KEYS, recovery.value_class(F.col("type")))
    columns = recovery.series_profiles(series_of_columns(spark, folder), KEYS, column_class())
    return recovery.candidate_pairs(fields, columns, KEYS, 0.1)


MEASURES = """,
nn as (select pr.session, field, "column", la, lb, least(la, lb) as w, greatest(la, lb) as g from pr join (select session, name as field, count(*) as la from fs group by 1, 2) using (session, field)
    join (select session, name as "column", count(*) as lb from cs group by 1, 2) using (session, "column") where kind <> 'text'),
pw as (select *, g > 2 * w as slide, greatest(1, (g - w + 1) // least(10, g - w + 1)) as st from nn),
kw as (select *, unnest(range(case when slide then (g - w) // st + 1 else 1 end)) as win from pw),
wa as (select k.session, field, "column", win, fs.i - case when slide and la > lb then win * st else 0 end as i, v from kw k join fs on fs.session = k.session and fs.name = k.field
    where not (slide and la > lb) or fs.i - win * st between 0 and w - 1),
wb as (select k.session, field, "column", win, cs.i - case when slide and lb > la then win * st else 0 end as i, v from kw k join cs on cs.session = k.session and cs.name = k."column"
    where not (slide and lb > la) or cs.i - win * st between 0 and w - 1),
sa as (select session, field, "column", win, count(*) as a_n, avg(v) as a_mean, stddev_pop(v) as a_std, min(v) as a_min, max(v) as a_max from wa group by 1, 2, 3, 4),
sb as (select session, field, "column", win, count(*) as b_n, avg(v) as b_mean, stddev_pop(v) as b_std, min(v) as b_min, max(v) as b_max from wb group by 1, 2, 3, 4),
s2 as (select *, greatest(a_min, b_min) as lo, least(a_max, b_max) as hi, least(0.1 * a_mean, 0.1 * b_mean) as eps, least(20, greatest(5, cast(floor(sqrt(a_n)) as int))) as bins from sa join sb using (session, field, "column", win)),
mc as (select session, field, "column", win, greatest(0, least(1, sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))))) as cosine
    from (select session, field, "column", win, wa.v as x, wb.v as y from wa join wb using (session, field, "column", win, i)) group by 1, 2, 3, 4),
ha as (select session, field, "column", win, case when a_max = a_min then 0 else least(cast(floor((v - a_min) / (a_max - a_min) * bins) as int), bins - 1) end as bin, count(*) as c from wa join s2 using (session, field, "column", win) group by 1, 2, 3, 4, 5),
hb as (select session, field, "column", win, case when b_max = b_min then 0 else least(cast(floor((v - b_min) / (b_max - b_min) * bins) as int), bins - 1) end as bin, count(*) as c from wb join s2 using (session, field, "column", win) group by 1, 2, 3, 4, 5),
hg as (select session, field, "column", win, bins, a_n, b_n, unnest(range(bins)) as bin from s2),
hc as (select session, field, "column", win, (coalesce(ha.c, 0) + 1e-10) / (a_n + bins * 1e-10) as p, (coalesce(hb.c, 0) + 1e-10) / (b_n + bins * 1e-10) as q
    from hg left join ha using (session, field, "column", win, bin) left join hb using (session, field, "column", win, bin)),
mk as (select session, field, "column", win, case when kl > 50 then 0 else least(1, exp(-kl)) end as kl from (select session, field, "column", win, sum(p * ln(p / q)) as kl from hc group by 1, 2, 3, 4)),
qa as (select session, field, "column", win, quantile_cont(v, [0.25, 0.5, 0.75]) as q from wa join s2 using (session, field, "column", win) where v between lo and hi group by 1, 2, 3, 4),
qb as (select session, field, "column", win, quantile_cont(v, [0.25, 0.5, 0.75]) as r from wb join s2 using (session, field, "column", win) where v between lo and hi group by 1, 2, 3, 4),
mq as (select session, field, "column", win, case when lo < hi then (coalesce((abs(q[1] - r[1]) <= eps)::int, 0) + coalesce((abs(q[2] - r[2]) <= eps)::int, 0) + coalesce((abs(q[3] - r[3]) <= eps)::int, 0)) / 3 else 0 end as quant
    from s2 left join qa using (session, field, "column", win) left join qb using (session, field, "column", win)),
nd as (select session, field, "column", win, wa.i, abs(wa.v - wb.v) as d, row_number() over (partition by session, field, "column", win, wa.i order by abs(wa.v - wb.v)) as rk from wa join wb using (session, field, "column", win)),
mp as (select session, field, "column", win, count(*) filter (d <= eps) / count(*) as prec from (select session, field, "column", win, i, avg(d) as d from nd where rk <= 3 group by 1, 2, 3, 4, 5) join s2 using (session, field, "column", win) group by 1, 2, 3, 4),
ws as (select session, field, "column", win, 0.15 * kl + 0.15 * coalesce(cosine, 0) + 0.4 * (0.6 * prec + 0.2 * case when greatest(a_max, b_max) = least(a_min, b_min) then 1 else greatest(0, hi - lo) / (greatest(a_max, b_max) - least(a_min, b_min)) end + 0.2 * quant)
    + 0.15 * coalesce(case when abs(a_std / a_mean - b_std / b_mean) > 50 then 0 else exp(-abs(a_std / a_mean - b_std / b_mean)) end, 0) as s
    from s2 join mk using (session, field, "column", win) left join mc using (session, field, "column", win) join mq using (session, field, "column", win) join mp using (session, field, "column", win)),
w1 as (select *, min(win) filter (s > 0.95) over (partition by session, field, "column") as f from ws),
ts as (select session, field, "column", count(*) filter (exists (select 1 from cs where cs.session = pr.session and cs.name = pr."column" and cs.text = fs.text)) / count(*) as score
    from pr join fs using (session) where pr.kind = 'text' and fs.name = field group by 1, 2, 3),
sc as (select session, field, "column", 0.7 * max(s) + 0.3 * avg(s) as score from w1 where f is null or win <= f group by 1, 2, 3 union all select * from ts)"""


def scored(spark, folder, weights=WEIGHTS):
    fields, columns = materialize(series_of_fields(spark, folder)), materialize(series_of_columns(spark, folder))
    profiles = materialize(recovery.series_profiles(fields, KEYS, recovery.value_class(F.col("type"))))
    pairs = recovery.candidate_pairs(profiles, recovery.series_profiles(columns, KEYS, column_class()), KEYS)
    return recovery.pair_scores(pairs, fields, columns, KEYS, weights), profiles


@query("field_column_scores", SERIES + PAIRS + MEASURES + ' select session, field, "column", kind, round(score, 6) as score from sc join pr using (session, field, "column")')
def field_column_scores(spark, folder):
    """Every field against every column of its class, without warping, which SQL can't express."""
    return scored(spark, folder)[0].withColumn("score", F.round("score", 6))


@query("field_column_scores_warped")
def field_column_scores_warped(spark, folder):
    """The same with all weights."""
    return scored(spark, folder, recovery.similarity.WEIGHTS)[0].withColumn("score", F.round("score", 6))


REPORT = """, re as (select fp.session, fp.name as field, fp.repetition, values = 1 or (fp.kind = 'float' and high < 1e-10) as is_constant,
    arg_min("column", (-score, "column")) as bc, max(score) as bs from fp left join sc on sc.session = fp.session and sc.field = fp.name group by all),
rp as (select session, field, case when not is_constant then bc end as best_column, case when is_constant then 0 else coalesce(bs, 0) end as best_score, repetition, is_constant, not is_constant as is_intersect,
    case when is_constant then 0 else greatest(coalesce(bs, 0) - case when coalesce(bs, 0) > 0.45 and repetition > 0.8 then repetition - 0.8 else 0 end, 0.45) end as similarity from re)"""


@query(
    "field_reports",
    SERIES + PAIRS + MEASURES + REPORT + """ select session, field, best_column, round(best_score, 6) as best_score, best_score > 0.45 as is_matched, round(similarity, 6) as similarity,
      round(repetition, 6) as repetition, is_constant, is_intersect from rp""",
)
def field_reports(spark, folder):
    rows, profiles = scored(spark, folder)
    return recovery.field_report(rows, profiles, KEYS, THRESHOLD).withColumns({c: F.round(c, 6) for c in ("best_score", "similarity", "repetition")})


@query(
    "field_report_summary",
    SERIES + PAIRS + MEASURES + REPORT + """ select session, count(*) as total_fields, count(*) filter (is_intersect) as scored_fields, count(*) filter (is_intersect and similarity > 0.45) as matched_fields,
      round(coalesce(avg(similarity) filter (is_intersect), 0), 6) as average_similarity, round(count(*) filter (is_intersect and similarity > 0.45) / count(*), 6) as match_coverage,
      round(greatest(0, coalesce(avg(similarity) filter (is_intersect), 0)), 6) as total_reward from rp group by 1""",
)
def field_report_summary(spark, folder):
    rows, profiles = scored(spark, folder)
    out = recovery.report_summary(recovery.field_report(rows, profiles, KEYS, THRESHOLD), KEYS, THRESHOLD)
    return out.withColumns({c: F.round(c, 6) for c in ("average_similarity", "match_coverage", "total_reward")})


def _session_sql(rounds: int = 6) -> str:
    """Claims of columns inside each (session, solution), round by round, then the blended score."""
    parts = [
        """cb as (select sc.session, solution, "column", field, sc.score - case when sc.score > 0.45 and repetition > 0.8 then repetition - 0.8 else 0 end as score
            from sc join fp on fp.session = sc.session and fp.name = sc.field, (values (0), (1)) t(solution) where solution = 0 or field <> 'digit')""",
        "c0 as (select * from cb where score > 0.45)",
    ]
    for k in range(1, rounds + 1):
        parts += [
            f'cw{k} as (select session, solution, "column", arg_min(field, (-score, field)) as field, max(score) as score from c{k - 1} group by 1, 2, 3)',
            f'cv{k} as (select session, solution, arg_min("column", (-score, "column")) as "column", field, max(score) as score, count(*) as n from cw{k} group by 1, 2, 4)',
            f"""c{k} as (select * from c{k - 1} b where exists (select 1 from cv{k} v where v.session = b.session and v.solution = b.solution and n > 1)
                and not exists (select 1 from cv{k} v where v.session = b.session and v.solution = b.solution and (v."column" = b."column" or v.field = b.field)))""",
        ]
    won = " union all ".join(f'select session, solution, "column", field, score from cv{k}' for k in range(1, rounds + 1))
    return ", " + ", ".join(parts) + f""", cm as (select session, solution, avg(score) as avg_score, count(*) as matched from ({won}) group by 1, 2),
    ct as (select session, count(distinct name) as columns from cs group by 1),
    co as (select *, case solution when 0 then 0.6::double else 0.8::double end as reward from cm join ct using (session)),
    cz as (select *, 0.7 * (avg_score * 0.7 + matched / columns * 0.3) + 0.3 * reward as total_score from co)
    select session, solution, round(avg_score, 6) as avg_score, matched, reward, columns, round(total_score, 6) as total_score
    from (select *, row_number() over (partition by session order by total_score desc, solution) as rk from cz) where rk = 1"""


@query("session_solution_scores", SERIES + PAIRS + MEASURES + _session_sql())
def session_solution_scores(spark, folder):
    """Best of two solutions of every session: payloads decoded, fields scored, columns claimed, scores blended."""
    rows, profiles = scored(spark, folder)
    seen = recovery.column_side_scores(rows, profiles, KEYS, THRESHOLD).drop("kind")
    solutions = seen.withColumn("solution", F.explode(F.when(F.col("field") == "digit", F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    columns = series_of_columns(spark, folder).groupBy("session").agg(F.countDistinct("name").alias("columns"))
    rewards = profiles.select("session").distinct().select("session", F.explode(F.array(F.lit(0), F.lit(1))).alias("solution"))
    rewards = rewards.withColumn("reward", F.when(F.col("solution") == 0, 0.6).otherwise(0.8))
    best = recovery.best_solution_of_sessions(solutions, columns, KEYS, THRESHOLD, rewards)
    return best.withColumns({c: F.round(c, 6) for c in ("avg_score", "total_score")})


@query(
    "ranked_fields",
    SERIES + PAIRS + MEASURES + ' select session, "column", field, kind, round(score, 6) as score, cast(rk as int) as rank from (select *, row_number() over (partition by session, "column" order by score desc, field) as rk from sc join pr using (session, field, "column")) where rk <= 2',
)
def ranked_fields(spark, folder):
    return recovery.ranked_fields(scored(spark, folder)[0], KEYS, 2).withColumn("score", F.round("score", 6))
