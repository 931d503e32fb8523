"""Captures read by many tasks equal a walk through the file, and come back byte for byte."""

import random
import struct

import pytest
from pyspark.sql import functions as F
from test_packets_and_streams import _packet

from tracelode.operators import filters
from tracelode.sources import records


def make(path, rng, count, order="<", magic=0xA1B2C3D4, longest=900, cut=0):
    body = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 262144, 1)
    walk = []
    for k in range(count):
        size = rng.choice([0, 1, 10, 10, 10, 13, rng.randrange(longest)])
        frame = bytes(rng.choice([10, 13, 0, 255, rng.randrange(256)]) for _ in range(size))
        if k % 5 == 0:
            frame = _packet("10.0.0.1", "10.0.0.2", 4000, 502, 0x18, k, 1, frame[:200])
        walk.append((k, 1_700_000_000 + k, rng.randrange(10**6), len(frame) + 7, frame))
        body += struct.pack(order + "IIII", walk[-1][1], walk[-1][2], len(frame), len(frame) + 7) + frame
    with open(path, "wb") as f:
        f.write(body[: len(body) - cut])
    return walk[:-1] if cut else walk


@pytest.mark.parametrize("split", [300, 4_000, 1_000_000])
def test_records_of_split_files(spark, tmp_path, split):
    rng = random.Random(split)
    want = {
        "one": make(tmp_path / "one.pcap", rng, 150), "two": make(tmp_path / "two.pcap", rng, 60, ">", 0xA1B23C4D), "none": make(tmp_path / "none.pcap", rng, 0),
        "torn": make(tmp_path / "torn.pcap", rng, 20, cut=3), "long": make(tmp_path / "long.pcap", rng, 30, longest=5_000),
    }
    (tmp_path / "other.pcap").write_bytes(b"no capture\n at all")
    (tmp_path / "empty.pcap").write_bytes(b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = records.read_records(spark, str(tmp_path)).collect()
        parts = records._lines(spark, str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert split > 4_000 or parts > 8
    got = {}
    for r in rows:
        got.setdefault(r["capture"], []).append((r["packet_index"], r["ts_sec"], r["ts_sub"], r["frame_len"], bytes(r["raw"])))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_round_trip_split_filter_and_pick(spark, tmp_path):
    rng = random.Random(4)
    walk = make(tmp_path / "one.pcap", rng, 90)
    make(tmp_path / "two.pcap", rng, 25, ">", 0xA1B23C4D)
    rows = records.read_records(spark, str(tmp_path))
    out = str(tmp_path / "out")
    assert [f[:2] for f in records.write_records(rows, out)] == [("one.pcap", 90), ("two.pcap", 25)]
    for name in ("one.pcap", "two.pcap"):
        assert (tmp_path / "out" / name).read_bytes() == (tmp_path / name).read_bytes()
    parts = records.split_captures(rows.where("capture = 'one'"), str(tmp_path / "parts"), 40)
    assert [p[:2] for p in parts] == [("one_part00000.pcap", 40), ("one_part00001.pcap", 40), ("one_part00002.pcap", 10)]
    again = records.read_records(spark, str(tmp_path / "parts")).orderBy("capture", "packet_index").collect()
    assert [bytes(r["raw"]) for r in again] == [w[4] for w in walk]
    # a filter chain on parsed packets picks raw records, which are written as a capture
    packets = records.with_layers(rows)
    kept = filters.protocol_packets(packets, "modbus")
    assert kept.where("layers not in (3, 4)").isEmpty() and kept.count() == packets.where((F.col("packet_index") % 5) == 0).count()
    picked = records.pick_records(rows, kept)
    assert [f[1] for f in records.write_records(picked, str(tmp_path / "kept"))] == [18, 5]
