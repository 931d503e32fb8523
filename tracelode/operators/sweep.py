"""Points and windows of any number, length and overlap, met by one sweep along the time axis.

Windows put a mark on the axis where they start and one where they end; running totals of the points, read at both marks,
give what lies between them.  Nothing is paired: rows are the points plus two for each window, and the ordered scan
spreads a hot group over many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.plans.ordered import Ordered

START, POINT, END = 0, 1, 2


def _axis(points: DataFrame, windows: DataFrame, keys: list[str], time: str, start: str, end: str, values: dict[str, Column], closed: bool) -> DataFrame:
    """Points and marks on one axis: ``_at``, ``_side``, the values of points, the window of marks.

    Starts stand before the points of their time.  Ends do too when windows are half-open, behind them when ``closed``."""
    body = F.struct(*[F.col(c) for c in windows.columns])
    marks = windows.select(*keys, F.explode(F.array(
        F.struct(F.col(start).alias("at"), F.lit(START).alias("side"), F.lit(True).alias("opens")),
        F.struct(F.col(end).alias("at"), F.lit(END if closed else START).alias("side"), F.lit(False).alias("opens")),
    )).alias("_m"), body.alias("_w")).select(*keys, F.col("_m.at").alias("_at"), F.col("_m.side").alias("_side"), F.col("_m.opens").alias("_opens"), "_w")
    named = points.select(*keys, F.col(time).alias("_at"), F.lit(POINT).alias("_side"), *(v.alias(f"_v_{n}") for n, v in values.items()))
    return named.unionByName(marks, allowMissingColumns=True)


def totals_in_windows(
    points: DataFrame, windows: DataFrame, keys: Sequence[str], time: str, start: str, end: str, values: dict[str, Column], closed: bool = False
) -> DataFrame:
    """Every window with the totals of the points of its keys that lie in [start, end), or [start, end] when ``closed``.

    Windows may overlap and repeat; one that is empty or reversed has the totals 0.  Null values count as 0."""
    keys = list(keys)
    axis = Ordered(_axis(points, windows, keys, time, start, end, values, closed), keys, ["_at", "_side"])
    for name in values:
        axis = axis.with_cumsum(f"_c_{name}", F.coalesce(F.col(f"_v_{name}"), F.lit(0)))
    marks = axis.frame().where(F.col("_side") != POINT)
    sign = F.when(F.col("_opens"), -1).otherwise(1)
    # equal windows have equal totals, so they may share a group: each has as many starts as there are copies
    own = marks.groupBy(*keys, "_w").agg(F.count_if("_opens").alias("_copies"), *(F.sum(sign * F.col(f"_c_{n}")).alias(f"_s_{n}") for n in values))
    reversed_ = F.col(f"_w.{start}") > F.col(f"_w.{end}")
    out = own.select(
        "_w.*", *(F.when(reversed_, 0).otherwise(F.col(f"_s_{n}") / F.col("_copies")).cast(_kind(points, v)).alias(n) for n, v in values.items()),
        F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy"),
    )
    return out.drop("_copy")


def _kind(points: DataFrame, value: Column) -> str:
    """Totals of whole numbers stay whole."""
    kind = points.select(value.alias("v")).schema["v"].dataType.simpleString()
    return "bigint" if kind in ("int", "bigint", "smallint", "tinyint") else "double"


def latest_window(points: DataFrame, windows: DataFrame, keys: Sequence[str], time: str, start: str, end: str, name: str, columns: Sequence[str]) -> DataFrame:
    """Points with ``name``, a struct of the ``columns`` of the window that started last before or at them, null if it is over.

    That is the place a search among the ascending starts gives, with half-open windows; among windows of one start the one
    with the greatest ``columns`` counts."""
    keys = list(keys)
    body = F.struct(*[F.col(c) for c in points.columns])
    held = F.struct(F.col(end).alias("_until"), F.struct(*columns).alias("w"))
    rows = points.select(*keys, F.col(time).alias("_at"), F.lit(POINT).alias("_side"), body.alias("_row"))
    marks = windows.groupBy(*keys, F.col(start).alias("_at")).agg(F.max_by(held, F.struct(*columns)).alias("_open")).withColumn("_side", F.lit(START))
    axis = Ordered(rows.unionByName(marks, allowMissingColumns=True), keys, ["_at", "_side"]).with_last_known("_last", F.col("_open")).frame()
    inside = F.when(F.col("_last._until") > F.col("_at"), F.col("_last.w"))
    return axis.where(F.col("_side") == POINT).select("_row.*", inside.alias(name))


def windows_with_alarms(points: DataFrame, windows: DataFrame, keys: Sequence[str], time: str, start: str, end: str, alarm: Column) -> DataFrame:
    """Every window, and whether an alarm point lies in it by :func:`latest_window`.  Windows of equal keys and start are one."""
    keys = list(keys)
    own = [*keys, start]
    hit = latest_window(points.where(alarm), windows, keys, time, start, end, "_hit", [start]).where(F.col("_hit").isNotNull())
    hits = hit.groupBy(*keys, F.col(f"_hit.{start}").alias(start)).agg(F.count(F.lit(1)).alias("alarm_points"))
    return windows.join(hits, own, "left").withColumn("alarm_points", F.coalesce("alarm_points", F.lit(0))).withColumn("predicted", F.col("alarm_points") > 0)


def changing_in_few(points: DataFrame, windows: DataFrame, keys: Sequence[str], time: str, start: str, end: str, columns: Sequence[str]) -> DataFrame:
    """:func:`changing_in_windows` for a broadcast of windows: counts, least and greatest values are combined in the scan."""
    held = windows.select(F.struct(*windows.columns).alias("_w"))
    same = [F.col(f"_w.{k}").eqNullSafe(F.col(k)) for k in keys]
    inside = F.col(time).between(F.col(f"_w.{start}"), F.col(f"_w.{end}"))
    met = points.select(*keys, time, *columns)
    for c in same:
        inside = inside & c
    found = met.join(F.broadcast(held), inside).groupBy("_w").agg(F.count(F.lit(1)).alias("points"), *((F.min(c) != F.max(c)).alias(f"{c}_changes") for c in columns))
    every = held.join(found.withColumnRenamed("_w", "_own"), F.col("_w").eqNullSafe(F.col("_own")), "left")
    return every.select("_w.*", F.coalesce("points", F.lit(0)).alias("points"), *(F.coalesce(f"{c}_changes", F.lit(False)).alias(f"{c}_changes") for c in columns))


def changing_in_windows(
    points: DataFrame, windows: DataFrame, keys: Sequence[str], time: str, start: str, end: str, columns: Sequence[str], few: int = 64
) -> DataFrame:
    """Every window with the number of its points and one flag a column: whether its values in [start, end] are not all the
    same; nulls do not count.

    Up to ``few`` windows travel to the points.  Of more, the points of one time are combined first; where a column's value
    differs from the known one before it, the time of that one is noted.  A window holds more than one value when the last
    time noted up to its end is not before its start.  Counts and noted times only grow along the axis, so the marks read
    them from one scan of running maxima."""
    keys = list(keys)
    head = windows.distinct().limit(few + 1).collect()
    if len(head) <= few:
        return changing_in_few(points, windows.sparkSession.createDataFrame(head, windows.schema), keys, time, start, end, columns)
    bounds = [f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("a", F.min), ("b", F.max))]
    steps = points.where(F.col(time).isNotNull()).groupBy(*keys, F.col(time).alias("_at")).agg(F.count(F.lit(1)).alias("_n"), *bounds)
    scan = Ordered(steps, keys, ["_at"]).with_cumsum("_v_n", F.col("_n"))
    for c in columns:
        known = F.when(F.col(f"_a_{c}").isNotNull(), F.struct(F.col("_at").alias("t"), F.col(f"_a_{c}").alias("a"), F.col(f"_b_{c}").alias("b")))
        scan = scan.with_last_known(f"_k_{c}", known)
    for c in columns:
        scan = scan.with_lag(f"_p_{c}", F.col(f"_k_{c}"))

    def noted(c: str) -> Column:
        low, high, before = F.col(f"_a_{c}"), F.col(f"_b_{c}"), F.col(f"_p_{c}")
        return F.when(low != high, F.col("_at")).when((before["a"] != low) | (before["b"] != high), before["t"]).alias(f"_v_{c}")

    read = scan.frame().select(*keys, "_at", "_v_n", *(noted(c) for c in columns))
    totals = {"n": F.col("_v_n")} | {f"q_{c}": F.col(f"_v_{c}") for c in columns}
    rows = _axis(read, windows, keys, "_at", start, end, totals, True)
    axis = Ordered(rows, keys, ["_at", "_side"]).with_maxima({f"_c_{n}": F.col(f"_v_{n}") for n in totals})
    marks = axis.frame().where(F.col("_side") != POINT).select(*keys, "_w", "_opens", *(f"_c_{n}" for n in totals))
    if axis.chunked:  # as many tasks as the axis has
        marks = marks.repartition(axis.parts, *keys, "_w")
    # equal windows read equal totals, so they may share a group
    opens, closes = F.col("_opens"), ~F.col("_opens")
    own = marks.groupBy(*keys, "_w").agg(
        F.max(F.when(opens, F.col("_c_n"))).alias("_before"), F.max(F.when(closes, F.col("_c_n"))).alias("_upto"),
        *(F.max(F.when(closes, F.col(f"_c_q_{c}"))).alias(f"_q_{c}") for c in columns),
    )
    first, last = F.col(f"_w.{start}"), F.col(f"_w.{end}")
    count = F.when(first <= last, F.coalesce("_upto", F.lit(0)) - F.coalesce("_before", F.lit(0))).otherwise(0).cast("long").alias("points")
    changes = (F.coalesce((first <= last) & (F.col(f"_q_{c}") >= first), F.lit(False)).alias(f"{c}_changes") for c in columns)
    return own.select("_w.*", count, *changes)
