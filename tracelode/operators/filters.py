"""Packet filters: protocol, retransmissions, handshakes, session tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.functions.protocols import parse_all
from tracelode.operators.sessions import is_protocol_port, protocol_of, session_endpoints, token
from tracelode.plans.ordered import Ordered

# TCP flag sets the handshake filter looks at.
SYN, SYN_ACK, ACK, RST, RST_ACK = 0x02, 0x12, 0x10, 0x04, 0x14
CONNECTION = ["src_ip", "dst_ip", "src_port", "dst_port"]
ORDER = ["timestamp", "capture", "packet_index"]


def protocol_packets(packets: DataFrame, protocol: str | None = None) -> DataFrame:
    """TCP with a protocol port on either side."""
    port = is_protocol_port(F.col("src_port"), protocol) | is_protocol_port(F.col("dst_port"), protocol)
    return packets.where((F.col("protocol") == 6) & port)


def drop_retransmissions(packets: DataFrame) -> DataFrame:
    """Keep a packet unless a *kept* earlier one has the same (flags) or, with payload,
    the same (seq) identity.

    A dropped packet must not hide later ones, which makes the rule sequential, but
    only inside packets that share endpoints, ack and payload.  Those few copies are
    streamed past two small sets; packets without a twin never leave the JVM."""
    # 256 bits: unrelated packets do not fall together at any number of packets.
    identity = F.unhex(F.sha2(F.to_json(F.struct("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "ack", F.md5("payload").alias("body"))).cast("binary"), 256))
    rows = packets.withColumn("_id", identity)
    twins = rows.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_id")
    single = rows.join(twins, "_id", "left_anti").select(*packets.columns)
    columns = list(packets.columns)
    shared = rows.join(twins, "_id", "left_semi").repartition("_id").sortWithinPartitions("_id", *ORDER)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, flags_seen, seq_seen = None, set(), set()
        for batch in batches:
            chosen = []
            for group, flags, seq, payload in zip(batch["_id"], batch["flags"], batch["seq"], batch["payload"]):
                if group != current:
                    current, flags_seen, seq_seen = group, set(), set()
                copy = flags in flags_seen or (bool(payload) and seq in seq_seen)
                chosen.append(not copy)
                if not copy:
                    flags_seen.add(flags)
                    if payload:
                        seq_seen.add(seq)
            yield batch.loc[chosen, columns]

    return single.unionByName(shared.mapInPandas(keep, packets.schema))


def drop_handshakes(packets: DataFrame) -> DataFrame:
    """Drop SYN, SYN-ACK, the first ACK after a SYN-ACK, RST and RST-ACK.

    The ACK rule is a window: the last event of the connection before it that matters
    (SYN, SYN-ACK for it, or an ACK that consumed one) must be a SYN-ACK."""
    flags = F.col("flags")
    reply = flags == SYN_ACK
    # A SYN-ACK belongs to the connection of the side that opened it.
    conn = {c: F.when(reply, F.col(o)).otherwise(F.col(c)) for c, o in zip(CONNECTION, ("dst_ip", "src_ip", "dst_port", "src_port"))}
    keyed = packets.withColumns({f"_c_{c}": v for c, v in conn.items()})
    keys = [f"_c_{c}" for c in CONNECTION]
    opener = F.when(flags == SYN, F.lit(0)).when(reply, F.lit(1)).when(flags == ACK, F.lit(2))
    rows = Ordered(keyed.withColumn("_state", opener), keys, ORDER)
    # Between a SYN-ACK and its ACK only other packets may occur; they carry no state.
    rows = rows.with_last_known("_known", F.col("_state")).with_lag("_open", F.col("_known"))
    out = rows.frame()
    consumed = (flags == ACK) & (F.col("_open") == 1)
    drop = flags.isin(SYN, SYN_ACK, RST, RST_ACK) | consumed
    return out.where(~F.coalesce(drop, F.lit(False))).select(*packets.columns)


def session_tokens(packets: DataFrame, payload_over: int = 4) -> DataFrame:
    """Token rows per direction-free session, application payloads only."""
    named = packets.withColumn("app", protocol_of(F.col("src_port"), F.col("dst_port")))
    rows = parse_all(named.where(F.col("app").isNotNull() & (F.length("payload") > payload_over)), "app")
    low, high = session_endpoints(F.col("src_ip"), F.col("dst_ip"))
    direction = F.when(is_protocol_port(F.col("src_port")), "S").otherwise("C")
    return rows.select(
        F.concat_ws("-", low, high, "app").alias("session"), "capture", "packet_index", "timestamp", direction.alias("direction"),
        token(direction, F.col("frame_len"), F.col("control_code")).alias("dir_len_con"), "data_hex",
    )
