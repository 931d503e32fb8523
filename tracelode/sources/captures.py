"""Packet captures and the file formats around them."""

from __future__ import annotations

import glob
import os
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PACKET_SCHEMA = (
    "capture string, packet_index long, timestamp double, frame_len int, src_mac string, dst_mac string, src_ip string, dst_ip string, "
    "protocol int, src_port int, dst_port int, flags int, seq long, ack long, payload binary"
)


class _Capture(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _frame(data: bytes):
    """Ethernet / IPv4 / TCP or UDP fields of one frame; None for missing layers."""
    macs = (data[6:12].hex(":"), data[0:6].hex(":")) if len(data) >= 14 else (None, None)
    none = (*macs, None, None, None, None, None, None, None, None, None)
    if len(data) < 34 or data[12:14] != b"\x08\x00":
        return none
    head = (data[14] & 15) * 4
    total = struct.unpack("!H", data[16:18])[0]
    proto, src, dst = data[23], ".".join(map(str, data[26:30])), ".".join(map(str, data[30:34]))
    segment = data[14 + head : 14 + total]
    if proto == 6 and len(segment) >= 20:
        sport, dport, seq, ack, offset, flags = struct.unpack("!HHIIBB", segment[:14])
        return (*macs, src, dst, proto, sport, dport, flags & 63, seq, ack, segment[(offset >> 4) * 4 :])
    if proto == 17 and len(segment) >= 8:
        sport, dport = struct.unpack("!HH", segment[:4])
        return (*macs, src, dst, proto, sport, dport, None, None, None, segment[8:])
    return (*macs, src, dst, proto, None, None, None, None, None, segment)


class _CaptureReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        paths = sorted(glob.glob(os.path.join(self.path, "*.pcap"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [_Capture(p) for p in paths]

    def read(self, partition):
        name = os.path.splitext(os.path.basename(partition.path))[0]
        with open(partition.path, "rb") as f:
            head = f.read(24)
            if len(head) < 24:
                return
            little = head[:4] in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1")
            nano = head[:4] in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d")
            layout = ("<" if little else ">") + "IIII"
            index = 0
            while len(record := f.read(16)) == 16:
                sec, sub, kept, size = struct.unpack(layout, record)
                data = f.read(kept)
                yield (name, index, sec + sub / (1e9 if nano else 1e6), size, *_frame(data))
                index += 1


class CaptureSource(DataSource):
    """``spark.read.format("capture").load(path)``: a file or folder of pcap files, one
    partition per file (long recordings are kept as many files)."""

    @classmethod
    def name(cls):
        return "capture"

    def schema(self):
        return PACKET_SCHEMA

    def reader(self, schema):
        return _CaptureReader(self.options)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(CaptureSource)
    return spark.read.format("capture").load(path)


def read_historian(spark: SparkSession, path: str, schema: str, time: str = "timestamp", pattern: str = "dd/MMM/yyyy HH:mm:ss") -> DataFrame:
    """Wide CSV with an explicit schema; the time column is parsed, null when malformed."""
    return spark.read.csv(path, schema=schema, header=True).withColumn(time, F.try_to_timestamp(F.col(time), F.lit(pattern)))


def read_sequence(spark: SparkSession, path: str) -> DataFrame:
    """Token CSV; tokens are rebuilt from their parts when missing."""
    schema = "index long, direction string, length int, control_code string, timestamp double, dir_len_con string"
    rows = spark.read.csv(path, schema=schema, header=True)
    return rows.withColumn("dir_len_con", F.coalesce("dir_len_con", F.concat_ws("-", "direction", F.col("length").cast("string"), "control_code")))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Payload JSON lines {session, timestamp, payloads: [hex]} to one binary per period."""
    rows = spark.read.json(path, schema="session string, timestamp double, payloads array<string>")
    return rows.withColumn("payload", F.unhex(F.array_join("payloads", "")))


def write_states(df: DataFrame, path: str) -> None:
    """State rows as gzip JSON lines."""
    df.write.mode("overwrite").json(path, compression="gzip")


def write_table(df: DataFrame, path: str, *partitions: str) -> None:
    """Solutions, constraints, scores and reports as (partitioned) parquet."""
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


