"""Small helpers the operators of this package share."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

from tracelode.sources.tables import table


ARROW_ROWS = 1_000  # rows of whole texts a Python worker gets at a time


def load(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; texts are read whole."""
    small_batches(spark)
    return table(spark, folder, name).select(*columns)


def small_batches(spark: SparkSession) -> None:
    """Python workers get whole texts in small batches, so that memory does not depend on how long texts are on average."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def trim() -> None:
    """Give memory that a finished task no longer needs back to the machine; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(batches: Iterator) -> Iterator:
    """The batches, and :func:`trim` after the last."""
    yield from batches
    trim()


def over_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` over an iterator of batches as dicts of lists, giving batches of the ``schema``.  Values pass through Arrow as they
    are: long ids stay exact beside nulls."""
    fields = to_arrow_schema(DataType.fromDDL(schema))
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ({name: batch.column(k).to_pylist() for k, name in enumerate(names)} for batch in batches if batch.num_rows)
        for out in trimmed(fn(rows)):
            yield pa.RecordBatch.from_pydict(out, fields)

    return df.mapInArrow(run, schema)


def ddl(df: DataFrame, *more: str) -> str:
    """Schema text of all columns of ``df``, then ``more``."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *more])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def shuffle_width(df: DataFrame) -> int:
    """Partitions a shuffle of this session's size gets."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def held_out(key: str, folds: int, fold: int):
    """True where crc32 of the key, as text, leaves the remainder ``fold``; a null key counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary")) % folds == fold


def bounded_sample(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """About ``rows`` of ``total`` rows, chosen by a hash of the key, all of them when there are fewer.  For fitting only."""
    if total <= rows:
        return df
    share = math.ceil(rows / total * 1_000_000)
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(20_481)), F.lit(1_000_000)) < share)


def scatter(records: np.ndarray, bucket: np.ndarray) -> pd.DataFrame:
    """Records of each bucket as one binary row, so that a shuffle moves few rows: (bucket, packed)."""
    order = np.argsort(bucket, kind="stable")
    records, bucket = records[order], bucket[order]
    firsts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    ends = np.r_[firsts[1:], len(bucket)][: len(firsts)]  # no records give no rows
    return pd.DataFrame({"bucket": bucket[firsts].astype(np.int64), "packed": [records[a:b].tobytes() for a, b in zip(firsts, ends, strict=True)]})


def membership(keys: DataFrame, column: str, bits: int = 1 << 23):
    """A filter ``keys may hold this value``: a bitmap of ``bits`` hashed positions (1 MB), whatever the number of keys.  It lets
    through every key and few others; an exact join follows.

    The bitmap is a scalar subquery and its bits are read by column expressions, so a task that filters and then runs Python needs
    one Python worker, not two.  ``keys`` should be materialized: each query that filters reads them."""
    place = F.pmod(F.xxhash64(F.col(column)), F.lit(bits))
    parts = keys.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
    held = parts.agg(F.map_from_entries(F.collect_list(F.struct("part", "bitmap")))).scalar()

    def test(name: str) -> Column:
        at = F.pmod(F.xxhash64(F.col(name)), F.lit(bits))
        bit = F.bitmap_bit_position(at)
        byte = F.substr(F.try_element_at(held, F.bitmap_bucket_number(at)), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))
        return F.coalesce(F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), bit.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))

    return test
