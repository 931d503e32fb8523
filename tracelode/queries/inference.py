"""Field types, segmentations and text scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode.functions.binary import uint
from tracelode.operators import blocks, inference, segmentation
from tracelode.queries.payloads import HIST, KEYS, stats
from tracelode.queries.registry import query
from tracelode.session import materialize
from tracelode.sources.tables import payloads, table


def _scored(spark, folder, lengths=range(1, 9)):
    return inference.candidates(payloads(spark, folder), KEYS, "seq", lengths)


@query(
    "field_scores_uint8",
    HIST + """, v as (select session, pos as start, count(*) as c, sum(n) as n, sum(n) filter (byte <= 15) as b0, sum(n) filter (byte <= 63) as b1, count(*) > 1 as dyn from h group by 1, 2),
    g as (select v.*, low_entropy - high_entropy as gap from v join sh on sh.session = v.session and sh.pos = v.start join sl on sl.session = v.session and sl.pos = v.start),
    k as (select session, start, dyn, least(1, greatest(0, 0.3 + case when coalesce(b0, 0) >= n * 0.7 then 0.4 when coalesce(b1, 0) >= n * 0.8 then 0.3 else 0.2 end
          + case when n < 5 then 0 when gap > 1.0 then 0.3 when gap > 0.6 then 0.2 when gap > 0.3 then 0.1 when gap < -0.3 then -0.2 else 0 end)) as hc from g)
    select session, cast(start as int) as start, round(least(1.0, 0.35 + 0.65 * hc + case when dyn and hc > 0 then 0 else -0.15 end)::double, 6) as confidence, dyn as is_dynamic from k""",
)
def field_scores_uint8(spark, folder):
    rows = _scored(spark, folder, [1]).where(F.col("field_type") == "UINT8")
    return rows.select("session", "start", F.round("confidence", 6).alias("confidence"), "is_dynamic")


@query("field_candidates")
def field_candidates(spark, folder):
    return _scored(spark, folder)


@query("field_type_inference")
def field_type_inference(spark, folder):
    return inference.best_types(_scored(spark, folder), KEYS)


@query(
    "bit_stripes",
    """with b as (select c_nationkey as session, ascii(substr(c_name, 16, 1)) * 65536 + ascii(substr(c_name, 17, 1)) * 256 + ascii(substr(c_name, 18, 1)) as f from customer)
    select session, cast(bit_and(f) as bigint) as all_set, cast(bit_or(f) as bigint) as any_set, 24 - bit_count(xor(bit_and(f), bit_or(f))) as constant_bits from b group by 1""",
)
def bit_stripes(spark, folder):
    rows = payloads(spark, folder).select("session", uint(F.col("payload"), 15, 3).alias("f"))
    out = rows.groupBy("session").agg(F.bit_and("f").alias("all_set"), F.bit_or("f").alias("any_set"))
    return out.withColumn("constant_bits", 24 - F.bit_count(F.col("all_set").bitwiseXOR(F.col("any_set"))))


def _edges(spark, folder):
    found, sizes = stats(spark, folder)
    found = materialize(found)
    types = materialize(inference.best_types(_scored(spark, folder), KEYS))
    extended = blocks.extend_blocks(blocks.dynamic_blocks(found, KEYS), sizes, KEYS, 2)
    spans = segmentation.merged_spans(extended, KEYS)
    return types, found, sizes, extended, spans


@query("segmentation_dp")
def segmentation_dp(spark, folder):
    types, found, _, _, spans = _edges(spark, folder)
    return segmentation.segment(segmentation.block_edges(types, spans, found, KEYS), KEYS, 3)


@query("payload_solutions")
def payload_solutions(spark, folder):
    """Dynamic ranges and static spans assembled to whole payloads, then re-scored."""
    types, found, sizes, extended, spans = _edges(spark, folder)
    dynamic = segmentation.segment(segmentation.block_edges(types, spans, found, KEYS), KEYS, 1)
    static = segmentation.static_spans(blocks.static_gaps(extended, sizes, KEYS), KEYS)
    rest = segmentation.segment(segmentation.block_edges(types, static, found, KEYS), KEYS, 1)
    whole = segmentation.assemble(dynamic, rest, KEYS).withColumn("on_block", F.lit(True)).join(sizes.select("session", "min_len"), "session")
    rewards = segmentation.fields_reward(whole, [*KEYS, "run"], found, KEYS, "min_len")
    return segmentation.best_run(rewards, KEYS)


@query(
    "string_type_scores",
    r"""select source, lang, count(*) as n, count(*) filter (not regexp_matches(text, '[^\x00-\x7F]')) as ascii_values, cast(sum(length(text)) as bigint) as chars,
    cast(sum(length(regexp_replace(text, '[^A-Za-z0-9 .,!?;:()\[\]{}"''\-_]', '', 'g'))) as bigint) as common_chars,
    count(*) filter (1 - (length(regexp_replace(text, '[^\x01-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) * 0.5 + length(regexp_replace(text, '[^\x{7F}-\x{9F}]', '', 'g'))) / length(text) >= 0.9) as protocol_strings
    from documents group by 1, 2""",
)
def string_type_scores(spark, folder):
    return inference.text_scores(table(spark, folder, "documents"), ["source", "lang"], "text")
