"""Greedy left-to-right selection: keep a row when it lies at least ``span``
after the last kept row of its group.

This is the order-dependent core of non-overlapping pattern matching (positions,
span = pattern length) and of rate down-sampling (times, span = target period).
A row that lies ``span`` or more after its *direct* predecessor is kept whatever
happened before, so such rows cut a group into independent runs.  Runs of one row
never leave the JVM.  Longer runs are streamed through an Arrow kernel with
constant memory; runs longer than a chunk are first summarized chunk by chunk
(entry row -> last kept row), the summaries are chained, and every chunk is
then replayed on its own from its known entry state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelode.plans.ordered import CHUNK_ROWS_CONF, DEFAULT_CHUNK_ROWS, Ordered
from tracelode.session import materialize


def greedy_select(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    span: Column,
    order: Sequence[str] | None = None,
    bound: int | None = None,
) -> DataFrame:
    """Rows of ``df`` kept by the greedy rule; ``span`` is constant inside a group.

    The runs are written once: they are read by the size check, by the rows that
    stay in the JVM and by the kernel."""
    order = list(order or [position])
    rows = Ordered(df.withColumn("_span", span.cast("long")), keys, order, bound).with_lag("_prev", F.col(position))
    start = F.col("_prev").isNull() | (F.col(position) - F.col("_prev") >= F.col("_span"))
    rows = rows.with_column("_start", start).with_islands("_run", F.col("_start"))
    rows = rows.with_lead("_next_start", F.col("_start"))
    base = materialize(rows.frame().drop("_prev"))
    alone = F.col("_start") & F.coalesce("_next_start", F.lit(True))
    columns = [c for c in df.columns]
    single = base.where(alone).select(*columns)
    runs = base.where(~alone)

    limit = int(df.sparkSession.conf.get(CHUNK_ROWS_CONF, str(DEFAULT_CHUNK_ROWS)))
    group = [*keys, "_run"]
    sizes = runs.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    hot = sizes.where(F.col("n") > limit).drop("n")
    if hot.isEmpty():
        return single.unionByName(_stream(runs, group, order, position, columns))
    condition = [F.col(f"r.{c}").eqNullSafe(F.col(f"h.{c}")) for c in group]
    cold = runs.alias("r").join(hot.alias("h"), condition, "left_anti")
    large = runs.alias("r").join(hot.alias("h"), condition, "left_semi")
    kept = _stream(cold, group, order, position, columns).unionByName(
        _chained(large, group, order, position, columns, limit)
    )
    return single.unionByName(kept)


def _stream(runs: DataFrame, group: list[str], order: list[str], position: str, columns: list[str]) -> DataFrame:
    placed = runs.repartition(*group).sortWithinPartitions(*group, *order)
    schema = T.StructType([runs.schema[c] for c in columns])

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            flags = np.zeros(len(batch), dtype=bool)
            starts = batch["_start"].to_numpy()
            where = batch[position].to_numpy()
            spans = batch["_span"].to_numpy()
            for i in range(len(batch)):
                if starts[i] or last is None or where[i] - last >= spans[i]:
                    flags[i], last = True, where[i]
            yield batch.loc[flags, columns]

    return placed.mapInPandas(keep, schema)


def _first_reached(where: np.ndarray, span: int) -> np.ndarray:
    """Index of the first row at or after ``where[i] + span`` for every row."""
    return np.searchsorted(where, where + span, side="left")


def _chained(large: DataFrame, group: list[str], order: list[str], position: str, columns: list[str], limit: int) -> DataFrame:
    numbered = Ordered(large, group, order).with_row_number("_rn").frame()
    numbered = numbered.withColumn("_block", F.floor(F.col("_rn") / limit))
    where_type = large.schema[position].dataType
    key_fields = [large.schema[c] for c in group] + [T.StructField("_block", T.LongType())]
    summary = T.StructType(
        key_fields
        + [T.StructField("upto", where_type), T.StructField("entry", where_type), T.StructField("last", where_type)]
    )
    keyed = [*group, "_block"]

    def summarize(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        where, span = pdf[position].to_numpy(), int(pdf["_span"].iloc[0])
        follow = _first_reached(where, span)
        last = np.arange(len(where))
        for i in range(len(where) - 1, -1, -1):
            if follow[i] < len(where):
                last[i] = last[follow[i]]
        # Entry rows: only those the previous chunk can still block.
        reachable = np.searchsorted(where, where[0] + span, side="left") + 1
        ends = where[last[:reachable]]
        change = np.append(ends[1:] != ends[:-1], True)[: len(ends)]
        rows = pdf.iloc[: int(change.sum())][keyed].copy()
        for c in keyed:
            rows[c] = pdf[c].iloc[0]
        rows["upto"] = where[:reachable][change]
        rows["entry"] = where[0]
        rows["last"] = ends[change]
        return rows

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        out, last = [], None
        for block, part in pdf.sort_values(["_block", "upto"]).groupby("_block", sort=True):
            out.append((block, last))
            span = part["_span"].iloc[0]
            allowed = part["entry"].iloc[0] if last is None else last + span
            hit = part[part["upto"] >= allowed]
            if len(hit):
                last = hit["last"].iloc[0]
        result = pd.DataFrame(out, columns=["_block", "_last"])
        for c in group:
            result[c] = pdf[c].iloc[0]
        return result[[*keyed, "_last"]]

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        where, span, last = pdf[position].to_numpy(), pdf["_span"].iloc[0], pdf["_last"].iloc[0]
        flags = np.zeros(len(pdf), dtype=bool)
        i = 0 if pd.isna(last) else int(np.searchsorted(where, last + span, side="left"))
        while i < len(where):
            flags[i] = True
            i = int(np.searchsorted(where, where[i] + span, side="left"))
        return pdf.loc[flags, columns]

    tables = numbered.groupBy(*keyed).applyInPandas(summarize, summary)
    spans = numbered.groupBy(*group).agg(F.min("_span").alias("_span"))
    states = (
        tables.join(spans, group)
        .groupBy(*group)
        .applyInPandas(chain, T.StructType(key_fields + [T.StructField("_last", where_type)]))
    )
    schema = T.StructType([large.schema[c] for c in columns])
    return numbered.join(states, keyed).groupBy(*keyed).applyInPandas(replay, schema)
