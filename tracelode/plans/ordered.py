"""Ordered scans that do not depend on a group fitting into one task.

A plain window sends every row of a group to one task.  That is fine while the
largest group is known to be small, so the size is measured first (one
map-side combined count).  Beyond the limit the rows are range-partitioned on
(group, order): a hot group then spreads over many chunks, each scan runs inside
its chunk, and what must flow from one chunk to the next is a *carry* of at most
one row per chunk.  At most one group can continue across a chunk boundary, so
the carry table never has more rows than there are chunks and is safe to
broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.session import materialize

GROUP_ROWS_CONF = "spark.tracelode.maxGroupRows"
CHUNK_ROWS_CONF = "spark.tracelode.chunkRows"
DEFAULT_GROUP_ROWS = 2_000_000
DEFAULT_CHUNK_ROWS = 1_000_000
CHUNK = "_ord_chunk"
LEAD_LIMIT = 64


def _setting(df: DataFrame, name: str, default: int) -> int:
    return int(df.sparkSession.conf.get(name, str(default)))


class Ordered:
    """A DataFrame with a total order inside each group of ``keys``.

    Every ``with_*`` method returns a new ``Ordered`` whose ``df`` has one more
    column.  ``order`` must be a total order inside a group (ties spelled out).
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], bound: int | None = None):
        """``bound``: upper limit of the group size when the caller already knows
        one (rows derived from a measured frame); it saves the counting job."""
        self.keys = list(keys)
        self.order = list(order)
        limit = _setting(df, GROUP_ROWS_CONF, DEFAULT_GROUP_ROWS)
        if bound is not None and bound <= limit:
            total, self.largest, self.groups = 0, bound, None
        else:
            total, self.largest, self.groups = _group_sizes(df, self.keys)
        self.chunked = self.largest > limit
        if self.chunked:
            rows = _setting(df, CHUNK_ROWS_CONF, DEFAULT_CHUNK_ROWS)
            parts = max(2, math.ceil(total / rows))
            spread = df.withColumn("_ord_tie", F.monotonically_increasing_id())
            spread = spread.repartitionByRange(parts, *self.keys, *self.order, "_ord_tie")
            df = materialize(spread.withColumn(CHUNK, F.spark_partition_id()))
            self.order = self.order + ["_ord_tie"]
            self.parts = parts
        self.dealt = not self.chunked
        self.df = df

    def _with(self, df: DataFrame) -> "Ordered":
        other = object.__new__(Ordered)
        other.keys, other.order, other.chunked, other.largest = self.keys, self.order, self.chunked, self.largest
        other.groups = self.groups
        other.dealt = self.dealt
        if self.chunked:
            other.parts = self.parts
        other.df = df
        return other

    def _deal(self) -> "Ordered":
        """One chunk for each task before the first scan, so that a task's memory does not grow with the number of chunks."""
        if self.dealt:
            return self
        other = self._with(self.df.repartitionById(self.parts, F.col(CHUNK)))
        other.dealt = True
        return other

    def transform(self, fn) -> "Ordered":
        """Row-wise change that keeps the order columns."""
        return self._with(fn(self.df))

    def with_column(self, name: str, value: Column) -> "Ordered":
        return self._with(self.df.withColumn(name, value))

    def chunk_columns(self) -> list[str]:
        """Columns that a ``transform`` has to keep beside the keys and the order."""
        return [CHUNK, "_ord_tie"] if self.chunked else []

    def frame(self) -> DataFrame:
        return self.df.drop(CHUNK, "_ord_tie") if self.chunked else self.df

    # -- windows ---------------------------------------------------------
    def _group(self) -> list[str]:
        return ([CHUNK] if self.chunked else []) + self.keys

    def _window(self, reverse: bool = False):
        order = [F.col(c).desc() if reverse else F.col(c) for c in self.order]
        return Window.partitionBy(*self._group()).orderBy(*order)

    def _carry(self, summary: Column, over_chunks, reverse: bool) -> DataFrame:
        """One row per chunk that continues a group: what precedes it."""
        per_chunk = self.df.groupBy(*self._group()).agg(summary.alias("_ord_sum"))
        chunk_order = F.col(CHUNK).desc() if reverse else F.col(CHUNK)
        before = (
            Window.partitionBy(*self.keys)
            .orderBy(chunk_order)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        return (
            per_chunk.withColumn("_ord_carry", over_chunks(before))
            .withColumn("_ord_seen", F.count(F.lit(1)).over(before))
            .where(F.col("_ord_seen") > 0)
            .select(*self._group(), "_ord_carry")
        )

    def _join_carry(self, df: DataFrame, carry: DataFrame) -> DataFrame:
        group = self._group()
        small = carry.select(*[F.col(c).alias(f"_ord_key_{c}") for c in group], "_ord_carry")
        match = [F.col(c).eqNullSafe(F.col(f"_ord_key_{c}")) for c in group]
        condition = match[0]
        for part in match[1:]:
            condition = condition & part
        return df.join(F.broadcast(small), condition, "left").drop(*[f"_ord_key_{c}" for c in group])

    def _edge(self, value: Column, last: bool) -> Column:
        position = F.struct(*[F.col(c) for c in self.order])
        pick = F.max_by if last else F.min_by
        return pick(F.struct(value.alias("v")), position)

    # -- scans -----------------------------------------------------------
    def with_lag(self, name: str, value: Column, reverse: bool = False) -> "Ordered":
        """Value of the previous row (next row when ``reverse``)."""
        w = self._window(reverse)
        if not self.chunked:
            return self._with(self.df.withColumn(name, F.lag(value).over(w)))
        carry = self._carry(
            self._edge(value, last=not reverse), lambda b: F.last("_ord_sum").over(b), reverse
        )
        dealt = self._deal()
        df = dealt.df.withColumn(name, F.lag(F.struct(value.alias("v"))).over(w))
        df = self._join_carry(df, carry)
        return dealt._with(df.withColumn(name, F.coalesce(name, "_ord_carry")["v"]).drop("_ord_carry"))

    def with_lead(self, name: str, value: Column) -> "Ordered":
        return self.with_lag(name, value, reverse=True)

    def with_cumsum(self, name: str, value: Column) -> "Ordered":
        """Running sum up to and including the row."""
        w = self._window().rowsBetween(Window.unboundedPreceding, 0)
        if not self.chunked:
            return self._with(self.df.withColumn(name, F.sum(value).over(w)))
        carry = self._carry(F.sum(value), lambda b: F.sum("_ord_sum").over(b), False)
        dealt = self._deal()
        df = self._join_carry(dealt.df.withColumn(name, F.sum(value).over(w)), carry)
        total = F.coalesce(F.col(name) + F.col("_ord_carry"), F.col(name), F.col("_ord_carry"))
        return dealt._with(df.withColumn(name, total).drop("_ord_carry"))

    def with_cummax(self, name: str, value: Column) -> "Ordered":
        """Running maximum up to and including the row."""
        w = self._window().rowsBetween(Window.unboundedPreceding, 0)
        if not self.chunked:
            return self._with(self.df.withColumn(name, F.max(value).over(w)))
        carry = self._carry(F.max(value), lambda b: F.max("_ord_sum").over(b), False)
        dealt = self._deal()
        df = self._join_carry(dealt.df.withColumn(name, F.max(value).over(w)), carry)
        return dealt._with(df.withColumn(name, F.greatest(name, "_ord_carry")).drop("_ord_carry"))

    def with_maxima(self, values: dict[str, Column]) -> "Ordered":
        """Running maxima of several values up to and including the row, in one scan with one carry."""
        w = self._window().rowsBetween(Window.unboundedPreceding, 0)
        if not self.chunked:
            return self._with(self.df.withColumns({name: F.max(v).over(w) for name, v in values.items()}))
        per_chunk = self.df.groupBy(*self._group()).agg(*(F.max(v).alias(name) for name, v in values.items()))
        before = Window.partitionBy(*self.keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        carry = per_chunk.select(*self._group(), F.struct(*(F.max(name).over(before).alias(name) for name in values)).alias("_ord_carry"))
        dealt = self._deal()
        df = self._join_carry(dealt.df.withColumns({name: F.max(v).over(w) for name, v in values.items()}), carry)
        return dealt._with(df.withColumns({name: F.greatest(name, F.col("_ord_carry")[name]) for name in values}).drop("_ord_carry"))

    def with_row_number(self, name: str) -> "Ordered":
        """0-based position inside the group."""
        if not self.chunked:
            return self._with(self.df.withColumn(name, (F.row_number().over(self._window()) - 1).cast("long")))
        carry = self._carry(F.count(F.lit(1)), lambda b: F.sum("_ord_sum").over(b), False)
        dealt = self._deal()
        df = dealt.df.withColumn(name, (F.row_number().over(self._window()) - 1).cast("long"))
        df = self._join_carry(df, carry)
        return dealt._with(df.withColumn(name, F.col(name) + F.coalesce("_ord_carry", F.lit(0))).drop("_ord_carry"))

    def with_last_known(self, name: str, value: Column, reverse: bool = False) -> "Ordered":
        """Last non-null value up to and including the row (next one when ``reverse``)."""
        w = self._window(reverse).rowsBetween(Window.unboundedPreceding, 0)
        inner = F.last(value, ignorenulls=True).over(w)
        if not self.chunked:
            return self._with(self.df.withColumn(name, inner))
        present = F.when(value.isNotNull(), F.struct(*[F.col(c) for c in self.order]))
        pick = F.min_by if reverse else F.max_by
        carry = self._carry(
            pick(value, present), lambda b: F.last("_ord_sum", ignorenulls=True).over(b), reverse
        )
        dealt = self._deal()
        df = self._join_carry(dealt.df.withColumn(name, inner), carry)
        return dealt._with(df.withColumn(name, F.coalesce(name, "_ord_carry")).drop("_ord_carry"))

    def with_next_known(self, name: str, value: Column) -> "Ordered":
        return self.with_last_known(name, value, reverse=True)

    def with_islands(self, name: str, starts: Column) -> "Ordered":
        """Island id: number of rows so far at which ``starts`` held."""
        return self.with_cumsum(name, F.when(starts, F.lit(1)).otherwise(F.lit(0)).cast("long"))


def _group_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int, int]:
    """Rows, largest group and number of groups, from one map-side combined count."""
    if not keys:
        total = df.count()
        return total, total, 1
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.sum("n").alias("t"), F.max("n").alias("m"), F.count(F.lit(1)).alias("g")).first()
    return int(row["t"] or 0), int(row["m"] or 0), int(row["g"])


def ahead(
    df: DataFrame, keys: Sequence[str], position: str, reach: int, values: dict[str, Column], block: int | None = None
) -> DataFrame:
    """For each row the next ``reach`` values as arrays (shorter at the end).

    ``position`` is a dense 0-based row number inside ``keys``.  Rows are cut into
    blocks of equal size; the first ``reach - 1`` rows of a block are also given to
    the block before it, so a hot group is worked on by many tasks.
    """
    size = max(block or _setting(df, CHUNK_ROWS_CONF, DEFAULT_CHUNK_ROWS), reach)
    home = F.floor(F.col(position) / size)
    spill = (F.col(position) % size < reach - 1) & (F.col(position) >= size)
    both = F.when(spill, F.array(home, home - 1)).otherwise(F.array(home))
    rows = df.withColumn("_home", home).withColumn("_blk", F.explode(both))
    w = Window.partitionBy(*keys, "_blk").orderBy(position)
    for name, value in values.items():
        if reach <= LEAD_LIMIT:
            # Separate leads are much cheaper than re-collecting a sliding frame.
            leads = [value, *[F.lead(value, k).over(w) for k in range(1, reach)]]
            rows = rows.withColumn(name, F.array_compact(F.array(*leads)))
        else:
            rows = rows.withColumn(name, F.collect_list(value).over(w.rowsBetween(0, reach - 1)))
    return rows.where(F.col("_home") == F.col("_blk")).drop("_home", "_blk")


def halo(df: DataFrame, keys: Sequence[str], position: str, before: int, after: int, block: int | None = None) -> DataFrame:
    """Rows with ``_blk`` and ``_home``: blocks of equal size by position, each also given
    the ``before`` rows in front of it and the ``after`` rows behind it.

    Windows partitioned by (keys, _blk) then see every neighbour in reach; keep the
    rows with ``_home = _blk`` afterwards."""
    size = max(block or _setting(df, CHUNK_ROWS_CONF, DEFAULT_CHUNK_ROWS), before, after, 1)
    home = F.floor(F.col(position) / size)
    offset = F.col(position) % size
    near = F.array(
        home,
        F.when((offset < after) & (home > 0), home - 1),
        F.when(offset >= size - before, home + 1),
    )
    return df.withColumn("_home", home).withColumn("_blk", F.explode(F.array_compact(near)))
