"""Capture reading, packet filters and streaming jobs."""

import datetime
import struct

from pyspark.sql import functions as F

from tracelode.operators import filters
from tracelode.sources.captures import read_captures
from tracelode.streaming import jobs


def _packet(src, dst, sport, dport, flags, seq, ack, payload):
    tcp = struct.pack("!HHIIBBHHH", sport, dport, seq, ack, 5 << 4, flags, 0, 0, 0) + payload
    ip = struct.pack("!BBHHHBBH", 0x45, 0, 20 + len(tcp), 0, 0, 64, 6, 0) + bytes(map(int, src.split("."))) + bytes(map(int, dst.split(".")))
    return bytes(12) + b"\x08\x00" + ip + tcp


def _capture(path, frames):
    with open(path, "wb") as f:
        f.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
        for i, frame in enumerate(frames):
            f.write(struct.pack("<IIII", 1000 + i, 0, len(frame), len(frame)) + frame)


def test_capture_filters_and_tokens(spark, tmp_path):
    a, b = "10.0.0.1", "10.0.0.2"
    request = bytes.fromhex("000100000006010300000002")
    reply = bytes.fromhex("00010000000701030400010002")
    frames = [
        _packet(a, b, 4000, 502, filters.SYN, 1, 0, b""),
        _packet(b, a, 502, 4000, filters.SYN_ACK, 5, 2, b""),
        _packet(a, b, 4000, 502, filters.ACK, 2, 6, b""),
        _packet(a, b, 4000, 502, 0x18, 2, 6, request),
        _packet(a, b, 4000, 502, 0x18, 2, 6, request),
        _packet(b, a, 502, 4000, 0x18, 6, 14, reply),
        _packet(a, b, 4000, 502, filters.ACK, 14, 19, b""),
        _packet(a, b, 4000, 502, filters.RST, 14, 0, b""),
        _packet(a, b, 4000, 80, 0x18, 2, 6, b"plain"),
    ]
    _capture(tmp_path / "one.pcap", frames)
    packets = read_captures(spark, str(tmp_path))
    assert packets.count() == 9
    kept = filters.protocol_packets(packets)
    assert kept.count() == 8
    kept = filters.drop_handshakes(filters.drop_retransmissions(kept))
    assert sorted(r["packet_index"] for r in kept.collect()) == [3, 5, 6]
    tokens = filters.session_tokens(kept).orderBy("packet_index").collect()
    assert [t["dir_len_con"] for t in tokens] == ["C-66-3", "S-67-3"]
    assert tokens[1]["data_hex"] == "0400010002"


def _stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def _run(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return stream.sparkSession.table(name).collect()


def _at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def test_streaming_pattern_and_gate(spark, tmp_path):
    tokens = "A B A A B C A B C".split()
    rows = [("s", _at(i), t, i in (1, 2, 3, 6)) for i, t in enumerate(tokens)]
    stream = _stream(spark, tmp_path, rows, "k string, t timestamp, token string, alarm boolean")
    found = _run(jobs.pattern_matches(stream, "k", "t", "token", ["A", "B", "C"], "1 minute"), "found")
    assert [r["end_ts"] - r["start_ts"] for r in found] == [2.0, 2.0]
    gated = _run(jobs.gated_alarms(stream, "k", "t", "alarm", 3, "1 minute"), "gated")
    assert [r["streak"] for r in gated] == [3]


def test_streaming_sessions(spark, tmp_path):
    rows = [("s", _at(t)) for t in (0, 50, 150, 400, 10_000)]
    stream = _stream(spark, tmp_path, rows, "k string, t timestamp")
    out = _run(jobs.sessions(stream, ["k"], "t", "100 seconds", "10 seconds").select("n"), "ses", "complete")
    assert sorted(r["n"] for r in out) == [1, 1, 3]
    alarms = _run(jobs.window_alarms(stream, ["k"], "t", "30 seconds", F.lit(True), "10 seconds").select("n"), "win", "complete")
    assert sum(r["n"] for r in alarms) == 5
