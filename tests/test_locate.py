import random

from pyspark.sql import functions as F

from tracelode.functions.binary import is_finite
from tracelode.operators import locate, recovery

SPECS = [("a", 0, 67.0, 1, "UINT8", "n/a"), ("b", 0, float(0x3031), 2, "UINT16", "big"), ("b", 1, float(0x3130), 2, "UINT16", "big"), ("c", 0, float(0x3130), 2, "INT16", "little"), ("d", 0, 1.5, 4, "FLOAT32", "n/a")]
SPEC = "name string, position int, value double, length int, type string, endian string"


def payloads(spark, n=200):
    rng = random.Random(3)
    rows = [(k, bytes(rng.choice(b"C01\x00\xc0?") for _ in range(rng.choice([0, 1, 3, 18])))) for k in range(n)]
    return spark.createDataFrame(rows, "seq int, payload binary").coalesce(1)


def test_one_partition_is_decoded_by_many_tasks(spark):
    specs = spark.createDataFrame(SPECS, SPEC)
    found = locate.all_offsets(payloads(spark), ["seq"], "payload", specs)
    assert found.select(F.spark_partition_id()).distinct().count() > 1


def test_every_format_as_by_columns(spark):
    formats = [(w, t, e) for t, ws in locate.WIDTHS.items() for w in ws for e in ("big", "little", "n/a")] + [(3, "UINT24", "big"), (7, "INT56", "little"), (2, "BINARY", "n/a")]
    rows = payloads(spark, 60)
    table = spark.createDataFrame(formats, "length int, type string, endian string")
    number = recovery.typed_number(F.col("payload"), F.col("offset"), F.col("length"), F.col("type"), F.col("endian"))
    every = rows.where(F.length("payload") > 0).withColumn("offset", F.explode(F.sequence(F.lit(0), F.length("payload") - 1))).crossJoin(table)
    want = every.select("seq", "offset", "length", "type", "endian", number.alias("found")).where(is_finite(F.col("found")))
    got = locate.all_offsets(rows, ["seq"], "payload", table)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_specs_with_and_without_broadcast(spark):
    specs = spark.createDataFrame(SPECS, SPEC)
    got = sorted(map(tuple, locate.locate_specs(payloads(spark), ["seq"], "payload", specs, hot=5).collect()))
    spark.conf.set("spark.tracelode.maxBroadcastRows", "0")
    try:
        split = sorted(map(tuple, locate.locate_specs(payloads(spark), ["seq"], "payload", specs, hot=5).collect()))
    finally:
        spark.conf.unset("spark.tracelode.maxBroadcastRows")
    assert got == split and {r[1] for r in got} >= {"a", "b", "c"}
    assert not locate.locate_specs(payloads(spark), ["seq"], "payload", specs.limit(0)).collect()
