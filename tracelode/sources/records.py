"""Capture files of any size as records, read by many tasks from any path that Spark reads, and written back.

A capture is a chain: only a record's header tells where the next one starts.  Spark's text reader cuts a file into splits
and keeps all bytes between line feeds, so a split's bytes and its place in the file follow from the lengths of its lines.
Each split then follows the chain from every place where a record could start within its first record's reach and keeps
(entry, exit, records) of the chains that stay plausible to its end; going through the splits of a file once tells which
entry is the true one.  Records inside a split are cut out where they are; the pieces of one that crosses splits meet."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator, Sequence

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.session import materialize
from tracelode.sources.captures import PACKET_SCHEMA, _frame

# Magic numbers by byte order and resolution, header sizes, the largest record of common tools.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
FILE_HEADER, RECORD_HEADER, LARGEST = 24, 16, 262_144
END = 1 << 62  # behind every file
RECORDS = "capture string, file string, packet_index long, ts_sec long, ts_sub long, frame_len long, raw binary, file_header binary"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line): every line of every split in order; nothing is decoded."""
    rows = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.pcap").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("bytes"), F.col("value").cast("binary").alias("line"))


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, bytes]]:
    """(file, block, bytes) of the splits of a task; the line feed after the last line of a file may be one too many."""
    now, parts = None, []
    for frame in frames:
        for file, block, line in zip(frame["file"], frame["block"], frame["line"]):
            if (file, block) != now:
                if now is not None:
                    yield *now, b"\n".join(parts) + b"\n"
                now, parts = (file, block), []
            parts.append(bytes(line))
    if now is not None:
        yield *now, b"\n".join(parts) + b"\n"


def plausible(data: bytes, at: int, order: str, resolution: int) -> int | None:
    """Length of the record at a place, None if its header can't be one."""
    _, sub, kept, size = struct.unpack_from(order + "IIII", data, at)
    return RECORD_HEADER + kept if sub < resolution and kept <= LARGEST and size <= 1 << 24 else None


def chains(data: bytes, order: str, resolution: int, reach: int) -> list[tuple[int, int, int]]:
    """(entry, exit, records) of every chain that starts in the first ``reach`` bytes: records that start in the data, and where
    the one behind them starts, counted from the data's begin.  A header cut off at the end is taken as a start."""
    known: dict[int, tuple[int, int] | None] = {}
    found = []
    for entry in range(min(reach, len(data) + 1)):
        way, at = [], entry
        while at not in known:
            if at + RECORD_HEADER > len(data):
                known[at] = (at, 0)
                break
            step = plausible(data, at, order, resolution)
            if step is None:
                known[at] = None
                break
            way.append(at)
            at += step
        end = known[at]
        for k, place in enumerate(reversed(way)):
            known[place] = None if end is None else (end[0], end[1] + k + 1)
        if known[entry] is not None:
            found.append((entry, *known[entry]))
    return found


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(capture, file, packet_index, ts_sec, ts_sub, frame_len, raw, file_header) of every record of every capture.

    A record cut off at the end of a file is left out; files without a capture header give nothing.  Splits follow
    ``spark.sql.files.maxPartitionBytes``."""
    lines = _lines(spark, path)
    sizes = lines.groupBy("file", "block").agg(F.sum(F.length("line") + 1).alias("size"), F.max("bytes").alias("bytes"))
    # one row for each split: as many as Spark made, which it also keeps on the driver
    table = sorted(map(tuple, sizes.collect()))
    place: dict[tuple[str, int], int] = {}
    extra: dict[tuple[str, int], int] = {}
    at, last = 0, None
    for k, (file, block, size, total) in enumerate(table):
        at = 0 if file != last else at
        place[file, block], last = at, file
        at += size
        if k + 1 == len(table) or table[k + 1][0] != file:
            extra[file, block] = at - total  # 1 where the file does not end with a line feed
    headers = {r["file"]: bytes(r["head"]) for r in _first_bytes(lines).collect()}
    layout = {f: MAGIC[h[:4]] for f, h in headers.items() if len(h) == FILE_HEADER and h[:4] in MAGIC}
    shared = spark.sparkContext.broadcast((place, extra, layout))

    def follow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, extra, layout = shared.value
        for file, block, data in _blocks(frames):
            if file not in layout:
                continue
            data = data[: len(data) - extra.get((file, block), 0)]
            order, resolution = layout[file]
            first = place[file, block]
            # a split may lie inside one record, so an entry may lie behind its end
            ways = [(FILE_HEADER, *c[1:]) for c in chains(data, order, resolution, FILE_HEADER + 1)[-1:] if c[0] == FILE_HEADER] if not first else chains(data, order, resolution, LARGEST + RECORD_HEADER + 1)
            yield pd.DataFrame({
                "file": [file], "block": [block], "size": [len(data)], "head": [data[:RECORD_HEADER]], "tail": [data[-RECORD_HEADER:]],
                "chains": [[{"entry": e, "exit": x, "records": n} for e, x, n in ways]],
            })

    maps = lines.mapInPandas(follow, "file string, block long, size long, head binary, tail binary, chains array<struct<entry:long,exit:long,records:long>>")
    entries: dict[tuple[str, int], tuple[int, int]] = {}
    state: dict[str, tuple[int, int, bytes | None]] = {}  # where the next record starts, its index, its header while it is cut
    for row in sorted(maps.collect(), key=lambda r: (r["file"], place[r["file"], r["block"]])):
        file, begin, size = row["file"], place[row["file"], row["block"]], row["size"]
        start, index, header = state.get(file, (FILE_HEADER, 0, None))
        if header is not None:
            header = (header + bytes(row["head"]))[:RECORD_HEADER]
            if len(header) < RECORD_HEADER:  # a split of a few bytes
                entries[file, row["block"]], state[file] = (size + 1, index + 1), (start, index, header)
                continue
            step = plausible(header, 0, *layout[file])
            start, index = start + step if step is not None else END, index + 1
        entry = start - begin
        entries[file, row["block"]] = (entry, index)
        if entry > size:
            state[file] = (start, index, None)  # the whole split lies inside a record
            continue
        way = next((c for c in row["chains"] if c["entry"] == entry), None)
        if way is None:  # a damaged chain ends here
            state[file] = (END, index, None)
        elif way["exit"] > size:
            state[file] = (begin + way["exit"], index + way["records"], None)
        else:
            tail = bytes(row["tail"])
            state[file] = (begin + way["exit"], index + way["records"], tail[len(tail) - (size - way["exit"]) :])
    known = spark.sparkContext.broadcast(entries)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, extra, layout = shared.value
        for file, block, data in _blocks(frames):
            if (file, block) not in known.value:
                continue
            data = data[: len(data) - extra.get((file, block), 0)]
            order, resolution = layout[file]
            at, index = known.value[file, block]
            out = []
            if at and place[file, block]:
                out.append((file, index - 1, place[file, block], data[:at]))  # belongs to the record before
            while 0 <= at < len(data):
                step = plausible(data, at, order, resolution) if at + RECORD_HEADER <= len(data) else None
                whole = step is not None and at + step <= len(data)
                out.append((file, index, place[file, block] + at, data[at : at + step] if whole else data[at:]))
                if not whole:
                    break
                at, index = at + step, index + 1
            yield pd.DataFrame(out, columns=["file", "packet_index", "at", "piece"])

    pieces = materialize(lines.mapInPandas(cut, "file string, packet_index long, at long, piece binary"))
    order_of = {f: o for f, (o, _) in layout.items()}
    head = spark.sparkContext.broadcast((order_of, headers))

    def record(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order_of, headers = head.value
        for frame in frames:
            out = []
            for file, index, data in zip(frame["file"], frame["packet_index"], frame["piece"]):
                data = bytes(data)
                if len(data) < RECORD_HEADER:
                    continue
                sec, sub, kept, size = struct.unpack_from(order_of[file] + "IIII", data)
                if len(data) < RECORD_HEADER + kept:
                    continue
                name = os.path.splitext(os.path.basename(file))[0]
                out.append((name, file, index, sec, sub, size, data[RECORD_HEADER : RECORD_HEADER + kept], headers[file]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RECORDS.split(", ")])

    # only records in several pieces are moved: the first and last ones of a split
    own = ["file", "packet_index"]
    several = pieces.groupBy(*own).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(*own)
    whole = pieces.join(several, own, "left_anti").select(*own, "piece")
    joined = pieces.join(several, own, "left_semi").groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"))
    glued = joined.select(*own, F.unhex(F.array_join(F.transform("p", lambda p: F.hex(p["piece"])), "")).alias("piece"))
    return whole.unionByName(glued).mapInPandas(record, RECORDS)


def _first_bytes(lines: DataFrame) -> DataFrame:
    """The file header of every capture: the first bytes of its first split."""

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for file, _, data in _blocks(frames):
            yield pd.DataFrame({"file": [file], "head": [data[:FILE_HEADER]]})

    return lines.where(F.col("block") == 0).mapInPandas(first, "file string, head binary")


def with_layers(records: DataFrame) -> DataFrame:
    """Packet fields of raw records, with the number of layers and a digest of the payload."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PACKET_SCHEMA.split(", ")]
        for frame in frames:
            out = []
            for name, index, sec, sub, size, data, head in zip(*(frame[c] for c in ("capture", "packet_index", "ts_sec", "ts_sub", "frame_len", "raw", "file_header"))):
                out.append((name, index, sec + sub / MAGIC[bytes(head[:4])][1], size, *_frame(bytes(data))))
            yield pd.DataFrame(out, columns=names).astype({"protocol": "Int64", "src_port": "Int64", "dst_port": "Int64", "flags": "Int64", "seq": "Int64", "ack": "Int64"})

    rows = records.mapInPandas(parse, PACKET_SCHEMA)
    layers = F.when(F.col("src_mac").isNull(), 0).otherwise(1 + F.col("src_ip").isNotNull().cast("int") + F.col("src_port").isNotNull().cast("int") + (F.coalesce(F.length("payload"), F.lit(0)) > 0).cast("int"))
    return rows.withColumn("layers", layers).withColumn("payload_md5", F.md5("payload"))


def write_records(records: DataFrame, folder: str, name: str = "capture") -> list[tuple[str, int, int]]:
    """Write records to ``folder/<value of name>.pcap`` in order of ``packet_index``: (file, records, bytes) of each.

    A file is a chain, so one task writes it, row by row, under a name of its attempt, and then moves it into place: a task
    that runs again replaces it.  ``folder`` is a path or a URI that Arrow's file systems know."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(base, recursive=True)
        now, out, count, done = None, None, 0, []

        def close():
            out.close()
            system.move(f"{base}/.{now}.{os.getpid()}", f"{base}/{now}.pcap")
            done.append((f"{now}.pcap", count, system.get_file_info(f"{base}/{now}.pcap").size))

        for frame in frames:
            for own, sec, sub, size, raw, head in zip(*(frame[c] for c in ("_name", "ts_sec", "ts_sub", "frame_len", "raw", "file_header"))):
                if own != now:
                    if now is not None:
                        close()
                    now, count = own, 0
                    out = system.open_output_stream(f"{base}/.{now}.{os.getpid()}")
                    out.write(bytes(head))
                    order = MAGIC[bytes(head[:4])][0]
                out.write(struct.pack(order + "IIII", sec, sub, len(raw), size) + bytes(raw))
                count += 1
        if now is not None:
            close()
        yield pd.DataFrame(done, columns=["file", "records", "bytes"])

    rows = records.withColumn("_name", F.col(name).cast("string"))
    placed = rows.repartition("_name").sortWithinPartitions("_name", "packet_index").select("_name", "ts_sec", "ts_sub", "frame_len", "raw", "file_header")
    return sorted((r["file"], r["records"], r["bytes"]) for r in placed.mapInPandas(write, "file string, records long, bytes long").collect())


def split_captures(records: DataFrame, folder: str, size: int) -> list[tuple[str, int, int]]:
    """Captures cut into files of ``size`` records, named after the capture and the part."""
    part = F.format_string("%s_part%05d", F.col("capture"), F.floor(F.col("packet_index") / size).cast("int"))
    return write_records(records.withColumn("_part", part), folder, "_part")


def pick_records(records: DataFrame, indices: DataFrame, keys: Sequence[str] = ("capture", "packet_index")) -> DataFrame:
    """Only the records that a table of packet indices names."""
    return records.join(indices.select(*keys).distinct(), list(keys), "left_semi")
