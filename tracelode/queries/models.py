"""One-class models on lines, stored results, values located by many specs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracelode.operators import locate, oneclass
from tracelode.queries.recovery import PAYLOADS, payloads
from tracelode.queries.registry import query
from tracelode.session import shared_folder
from tracelode.sources.results import Results
from tracelode.sources.tables import table

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lines(spark, folder):
    key = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line")
    return table(spark, folder, "lineitem").select(key, *FEATURES)


@query(
    "standard_features",
    "with s as (select " + ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in FEATURES) + " from lineitem) select l_orderkey * 8 + l_linenumber as line, "
    + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) as z_{c}" for c in FEATURES) + " from lineitem, s",
)
def standard_features(spark, folder):
    rows = lines(spark, folder)
    scaled = oneclass.standardize(rows, oneclass.scaled(rows, FEATURES))
    return scaled.select("line", *(F.round(f"z_{c}", 6).alias(f"z_{c}") for c in FEATURES))


@query("robust_envelope_outliers")
def robust_envelope_outliers(spark, folder):
    """Lines outside the ellipse of least determinant; one in a hundred by definition of the threshold."""
    rows = lines(spark, folder)
    distance, limit = oneclass.robust_envelope(rows, "line", FEATURES, 0.01)
    return rows.select("line", F.round(distance, 4).alias("distance"), (distance > limit).alias("outlier"))


@query("kernel_outliers")
def kernel_outliers(spark, folder):
    """Decisions of a kernel machine fitted on a bounded sample of lines."""
    rows = lines(spark, folder)
    machine = oneclass.kernel_machine(rows, "line", FEATURES, nu=0.01, sample=1_000)
    out = oneclass.kernel_decisions(rows, machine)
    return out.select("line", F.round("decision", 4).alias("decision"), (F.col("decision") < 0).alias("outlier"))


# ---- stored results ---------------------------------------------------------------------------------------------------


@query(
    "stored_solutions",
    """with p as (select c_nationkey, c_custkey, c_mktsegment, row_number() over (partition by c_nationkey order by c_custkey) - 1 as rank from customer)
    select case when c_nationkey % 6 = 0 then null else 'nation ' || (c_nationkey % 6) end as session, count(*) as fields, sum(c_custkey)::bigint as keys,
      case when c_nationkey % 6 in (0, 2) then 'second' else 'first' end as version
    from p where c_nationkey % 6 not in (0, 2) or c_custkey % 2 = 0 group by all""",
)
def stored_solutions(spark, folder):
    """Nested solutions saved, two sessions replaced, all read back."""
    store = Results(spark, f"{shared_folder(spark)}/tracelode/results-{uuid.uuid4().hex}")
    session = F.when(F.col("c_nationkey") % 6 > 0, F.concat(F.lit("nation "), (F.col("c_nationkey") % 6).cast("string"))).alias("session")
    rows = table(spark, folder, "customer").select(session, "c_nationkey", F.col("c_custkey").alias("start"), F.col("c_mktsegment").alias("type"))

    def solutions(part, version):
        field = F.struct(F.struct("start", "type").alias("field"), F.array(F.lit(0.5), F.lit(None).cast("double")).alias("confidences"))
        nested = part.groupBy("session", "c_nationkey").agg(F.collect_list(field).alias("fields"))
        return nested.select("session", "fields", F.struct(F.lit(version).alias("version"), F.lit(None).cast("string").alias("note")).alias("about"))

    store.save("solutions", solutions(rows, "first"))
    again = rows.where((F.col("c_nationkey") % 6).isin(0, 2) & (F.col("start") % 2 == 0))
    store.save("solutions", solutions(again, "second"))
    back = store.load("solutions").select("session", F.col("about.version").alias("version"), F.explode("fields").alias("f"))
    return back.groupBy("session", "version").agg(F.count(F.lit(1)).alias("fields"), F.sum("f.field.start").alias("keys"))


# ---- values located by specs --------------------------------------------------------------------------------------------

SPECS = [  # name, length, type, byte order, values; "prefix" meets every payload
    ("prefix", 1, "UINT8", "n/a", [67.0]),
    ("pairs", 2, "UINT16", "big", [float(0x3030), float(0x3031), float(0x3132)]),
    ("swapped", 2, "INT16", "little", [float(0x3130), float(0x3030)]),
    ("word", 4, "UINT32", "big", [float(0x30303030), float(0x42303031)]),
]


def spec_rows(spark):
    rows = [(n, i, v, w, t, e) for n, w, t, e, values in SPECS for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "name string, position int, value double, length int, type string, endian string")


LOCATED = f"""with {PAYLOADS}, sp as (select * from (values {", ".join(f"('{n}', {i}, {v}::double, {w}, '{e}')" for n, w, t, e, values in SPECS for i, v in enumerate(values))}) t(name, pos, v, w, e)),
fm as (select distinct w, e from sp),
de as (select session, seq, o, w, e, list_sum(list_transform(range(w), lambda i: ascii(p[o + 1 + i])::bigint * (256 ** (case when e = 'little' then i else w - 1 - i end))::bigint))::double as found
    from (select *, unnest(range(length(p) - w + 1)) as o from pl, fm)),
hi as (select session, seq, name, o, pos, v, found, sp.w from de join sp on sp.w = de.w and sp.e = de.e and found = v),
ma as (select session, seq, name, o from hi group by all),
sq as (select session, seq, name, o - pos * w as s, w from hi group by 1, 2, 3, 4, 5 having count(distinct pos) = (select count(*) from sp where sp.name = hi.name) and s >= 0)"""


def located(spark, folder):
    specs = spec_rows(spark)
    return locate.locate_specs(payloads(spark, folder), ["session", "seq"], "payload", specs, hot=200), specs


@query("located_specs", LOCATED + ' select name, o::int as "offset", count(*) as matches from ma group by 1, 2')
def located_specs(spark, folder):
    """Matches of all specs by offset, decoded in one pass."""
    hits, _ = located(spark, folder)
    return locate.spec_matches(hits, ["session", "seq"]).groupBy("name", "offset").agg(F.count(F.lit(1)).alias("matches"))


@query("located_sequences", LOCATED + " select session, seq, name, s::int as sequence_start, (s + w * (select count(*) from sp where sp.name = sq.name) - 1)::bigint as sequence_end from sq where name <> 'prefix'")
def located_sequences(spark, folder):
    hits, specs = located(spark, folder)
    return locate.spec_sequences(hits, ["session", "seq"], specs).where(F.col("name") != "prefix")


@query("located_summary", LOCATED + " select name, (select count(*) from ma where ma.name = s.name) as individual_matches, (select count(*) from sq where sq.name = s.name) as sequence_matches from (select distinct name from sp) s")
def located_summary(spark, folder):
    hits, specs = located(spark, folder)
    return locate.spec_summary(locate.spec_matches(hits, ["session", "seq"]), locate.spec_sequences(hits, ["session", "seq"], specs), specs)
