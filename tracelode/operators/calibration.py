"""Clock offset search between a historian and recorded traffic."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelode.plans.ordered import CHUNK_ROWS_CONF, Ordered
from tracelode.plans.quantiles import quantiles
from tracelode.plans.sizing import small_side
from tracelode.session import materialize

# All of these decide speed and memory only.
CUTS = 256  # value ranges a median is located in, again and again
SKETCH = 4_096  # historian rows of a pv whose errors give its first ranges
BLOCK = 250_000  # rows and samples that one task works on
PAIRS = 1_000_000  # pairs that it holds at once
NEAR = 1_000_000  # errors near its medians that are written out for a pv
SERIES = 500  # pvs that are searched at a time
MOST = 0x7FF8000000000000  # the bits of a missing number, which sorts above infinity


def finite(value: Column) -> Column:
    return F.coalesce(F.abs(value) < F.lit(float("inf")), F.lit(False))  # NaN sorts above infinity


def spread_scale(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """max(sample deviation, IQR / 1.349), at least 1e-6."""
    q = quantiles(df, keys, value, {"_a": 0.25, "_b": 0.75})
    std = df.groupBy(*keys).agg(F.stddev_samp(value).alias("_s"))
    scale = F.greatest(F.coalesce("_s", F.lit(0.0)), (F.col("_b") - F.col("_a")) / 1.349, F.lit(1e-6))
    return q.join(std, list(keys)).select(*keys, scale.alias("scale"))


def nearest_cells(traffic: DataFrame, pv: str, time: str, value: str, tie: str, tolerance: int) -> DataFrame:
    """(pv, low, at, high, first, last): a sample's time and the times whose nearest sample within the tolerance it is.

    Times are whole numbers, so a cell is a closed range; a time halfway between two samples takes the earlier one.  Samples
    of one time share it: the last in tie order serves this time and later ones, the first serves earlier ones."""
    held = traffic.where(F.col(time).isNotNull()).groupBy(pv, F.col(time).alias("at")).agg(
        F.min_by(value, tie).cast("double").alias("first"), F.max_by(value, tie).cast("double").alias("last")
    )
    scan = Ordered(materialize(held), [pv], ["at"]).with_lag("_before", F.col("at")).with_lead("_next", F.col("at"))
    t = F.col("at")
    # x is nearest to t from below if x - before > t - x, that is from half of t + before, rounded down, plus 1 on.
    low = F.greatest(t - tolerance, F.coalesce(F.shiftright(t + F.col("_before"), 1) + 1, t - tolerance))
    high = F.least(t + tolerance, F.coalesce(F.shiftright(t + F.col("_next"), 1), t + tolerance))
    return scan.frame().select(pv, low.alias("low"), t.alias("at"), high.alias("high"), "first", "last")


@dataclass
class Prepared:
    """Historian and traffic of one search, in blocks of bounded size; every grid of offsets reads the same ones."""

    names: DataFrame  # (_pv, p)
    rows: DataFrame  # (unit, t, want)
    cells: DataFrame  # (unit, low, at, high, first, last)
    units: pd.DataFrame  # (p, block, low, high, n) of each unit, the rows of a pv in a block, in the order of pv and time
    scales: np.ndarray  # of each p


def prepare(
    historian: DataFrame, traffic: DataFrame, pv: str, time: str, value: str, tie: str, tolerance: int, earliest: int, latest: int
) -> Prepared:
    """For offsets between ``earliest`` and ``latest``.  Rows without pv, time or finite value take no part."""
    spark = historian.sparkSession
    named = [F.col(pv).alias("_pv"), F.col(time).cast("long").alias("t"), F.col(value).cast("double").alias("want")]
    historian = historian.select(*named).where(F.col("_pv").isNotNull() & finite(F.col("want")))
    traffic = traffic.select(*named, F.col(tie).alias("_order")).where(F.col("_pv").isNotNull())
    rows = historian.where(F.col("t").isNotNull())
    cells = materialize(nearest_cells(traffic, "_pv", "t", "want", "_order", tolerance))
    size = min(int(spark.conf.get(CHUNK_ROWS_CONF, str(BLOCK))), BLOCK)
    parts = max(1, math.ceil((rows.count() + cells.count()) / size))
    marks = rows.unionByName(cells.select("_pv", F.col("at").alias("t")), allowMissingColumns=True)
    blocks = marks.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, "_pv", "t", "_tie")
    blocks = materialize(blocks.withColumn("block", F.spark_partition_id()).where(F.col("want").isNotNull()).drop("_tie"))
    # At most one unit more for each block than there are pvs.
    ends = blocks.groupBy("_pv", "block").agg(F.min("t").alias("low"), F.max("t").alias("high"), F.count(F.lit(1)).alias("n")).collect()
    ends = sorted(ends, key=lambda r: (r["_pv"], r["block"]))
    order = {name: p for p, name in enumerate(sorted({r["_pv"] for r in ends}))}
    kind = T.StructField("_pv", rows.schema["_pv"].dataType)
    names = spark.createDataFrame([(name, p) for name, p in order.items()], T.StructType([kind, T.StructField("p", T.IntegerType())]))
    unit = T.StructType([kind, T.StructField("block", T.IntegerType()), T.StructField("unit", T.IntegerType())])
    unit = spark.createDataFrame([(r["_pv"], r["block"], u) for u, r in enumerate(ends)], unit)
    scale = spread_scale(historian, ["_pv"], "want")
    scales = {r["p"]: r["scale"] for r in scale.join(small_side(names, len(order)), "_pv").collect()}
    units = [(order[r["_pv"]], r["block"], r["low"], r["high"], r["n"]) for r in ends]
    units = pd.DataFrame(units, columns=["p", "block", "low", "high", "n"], dtype="int64")
    cells = cells.join(small_side(names, len(order)), "_pv").select("p", "low", "at", "high", "first", "last")
    return Prepared(
        names,
        blocks.join(small_side(unit, len(ends)), ["_pv", "block"]).select("unit", "t", "want"),
        materialize(dealt_cells(cells, units, earliest, latest)),
        units,
        np.array([scales[p] for p in range(len(order))], float),
    )


def dealt_cells(cells: DataFrame, units: pd.DataFrame, earliest: int, latest: int) -> DataFrame:
    """(unit, low, at, high, first, last): each cell for the units with a row whose time passes over it."""
    # Units of a pv follow each other in time, so those that a cell meets do too.
    held = {p: (u.index[0], u["low"].to_numpy() + earliest, u["high"].to_numpy() + latest) for p, u in units.groupby("p")}
    names = ["unit", "low", "at", "high", "first", "last"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, low, high = (batch.column(c).to_numpy() for c in ("p", "low", "high"))
            for p in np.unique(owner):
                unit, lows, highs = held[p]
                some = np.flatnonzero(owner == p)
                begin = np.searchsorted(highs, low[some])
                count = np.maximum(np.searchsorted(lows, high[some], side="right") - begin, 0)
                taken = batch.take(pa.array(np.repeat(some, count)))
                unit = pa.array((unit + np.repeat(begin, count) + _places(count)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([unit, *(taken.column(c) for c in names[1:])], names)

    return cells.mapInArrow(deal, "unit int, low long, at long, high long, first double, last double")


def _places(count: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the counts."""
    ends = count.cumsum()
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count)


def matched_steps(times: np.ndarray, cells: pd.DataFrame, step: int, steps: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, seen, first, last), some at a time: the samples that rows match and the steps of the grid for which they do.

    ``times`` are those of the rows at the first offset.  A row meets the cells its time passes over, and is not copied for
    each offset; only where these are more than the steps, it meets the cell of each step."""
    cells = cells.sort_values("at")
    pick = lambda a, b: np.stack([a, b], 1).ravel()
    low, at, high = (cells[c].to_numpy() for c in ("low", "at", "high"))
    after, until, seen = pick(low, at), pick(at - 1, high), pick(cells["first"].to_numpy(float), cells["last"].to_numpy(float))
    live = (after <= until) & np.isfinite(seen)
    after, until, seen = after[live], until[live], seen[live]
    begin = np.searchsorted(until, times)
    count = np.maximum(np.searchsorted(after, times + step * (steps - 1), side="right") - begin, 0)
    for dense in (False, True):
        rows = np.flatnonzero(count > steps if dense else (count > 0) & (count <= steps))
        width = np.full(len(rows), steps) if dense else count[rows]
        ends = width.cumsum()
        a = 0
        while a < len(rows):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, side="right")))
            row, place = np.repeat(rows[a:b], width[a:b]), _places(width[a:b])
            if dense:
                first = last = place
                cell = np.maximum(np.searchsorted(after, times[row] + step * place, side="right") - 1, 0)
                holds = (after[cell] <= times[row] + step * place) & (times[row] + step * place <= until[cell])
            else:
                cell = begin[row] + place
                first = np.maximum(-((times[row] - after[cell]) // step), 0)
                last = np.minimum((until[cell] - times[row]) // step, steps - 1)
                holds = first <= last
            yield row[holds], seen[cell[holds]], first[holds], last[holds]
            a = b


def _ranks(counts: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each line of counts the place that holds the rank, the rank inside it and how many it holds."""
    upto, line = counts.cumsum(1), np.arange(len(counts))
    place = (upto <= ranks[:, None]).sum(1)
    held = counts[line, place]
    return place, ranks - upto[line, place] + held, held


class _Medians:
    """Exact medians of the errors of some pvs at every step of a grid.

    Errors are told apart by their bits, which sort as they do.  Starts and ends of matches are counted by value range, which
    tells for every step the range its median lies in.  Ranges that hold many errors are cut again, a round for each
    ``CUTS``-th part, so rounds are at most eight; the errors of the last ones are written with their counts and ranked.
    Matches are found anew in each pass and never written."""

    def __init__(self, found: Prepared, units: range, start: int, step: int, steps: int):
        inside = F.col("unit").between(units.start, units.stop - 1)
        self.rows, self.cells = found.rows.where(inside), found.cells.where(inside)
        self.units, self.found, self.grid = units, found, (start, step, steps)
        self.owner = found.units["p"].to_numpy()
        self.cuts = CUTS

    def _each(self, kernel: Callable, schema: str, units: Sequence[int] | None = None) -> DataFrame:
        """``kernel(p, errors)`` for each unit, where ``errors()`` gives (bits, first, last) of the matches, some at a time."""
        rows, cells = self.rows, self.cells
        if units is not None:
            rows, cells = (df.where(F.col("unit").isin(list(units))) for df in (rows, cells))
        (start, step, steps), owner, scales = self.grid, self.owner, self.found.scales

        def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left):
                return kernel(0, lambda thin=0: iter(()))
            p = owner[left["unit"].iloc[0]]

            def errors(thin: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
                some = left.sort_values("t")
                some = some.iloc[:: max(1, len(some) // thin)] if thin else some
                want = some["want"].to_numpy()
                with np.errstate(all="ignore"):
                    for row, seen, first, last in matched_steps(some["t"].to_numpy() + start, right, step, steps):
                        bits = np.abs(np.abs(seen - want[row]) / scales[p]).view(np.int64)
                        yield np.minimum(bits, MOST), first, last

            return kernel(p, errors)

        spread = self.found.units.iloc[list(self.units if units is None else units)]
        tasks = min(len(spread), max(spread["block"].nunique(), self.rows.sparkSession.sparkContext.defaultParallelism))
        sides = [df.repartition(tasks, "unit").groupBy("unit") for df in (rows, cells)]
        return sides[0].cogroup(sides[1]).applyInPandas(work, schema)

    def _first_cuts(self) -> dict[int, np.ndarray]:
        """Ranges of like counts for each pv, from some rows of its largest unit; zero is one by itself."""
        shares = np.arange(1, self.cuts - 1) / (self.cuts - 1)

        def sketch(p: int, errors: Callable) -> pd.DataFrame:
            bits = np.sort(np.concatenate([b for b, _, _ in errors(SKETCH)] or [np.zeros(0, np.int64)]))
            return pd.DataFrame({"p": p, "cut": np.unique(bits[(shares * len(bits)).astype(int)]) if len(bits) else bits})

        held = self.found.units.iloc[self.units.start : self.units.stop]
        cuts = self._each(sketch, "p int, cut long", [int(u) for u in held.groupby("p")["n"].idxmax()]).toPandas()
        cuts = {p: c["cut"].to_numpy() for p, c in cuts.groupby("p")}
        return {p: np.unique(np.append(cuts.get(p, np.zeros(0, np.int64)), 0)) for p in set(held["p"])}

    def _located(self, cuts: dict[int, np.ndarray]) -> pd.DataFrame:
        """(p, step, part, low, high, rank, held): where the lower and the upper median of each step lie among the cuts."""
        steps, width = self.grid[2], self.cuts + 1

        def count(p: int, errors: Callable) -> pd.DataFrame:
            grid = np.zeros((steps + 1) * width, np.int64)
            for bits, first, last in errors():
                part = np.searchsorted(cuts[p], bits)
                grid += np.bincount(first * width + part, minlength=len(grid)) - np.bincount((last + 1) * width + part, minlength=len(grid))
            at = np.flatnonzero(grid)
            return pd.DataFrame({"p": p, "at": at, "d": grid[at]})

        def locate(pdf: pd.DataFrame) -> pd.DataFrame:
            """A pv has at most (steps + 1) x (CUTS + 1) marks, whatever the number of its rows."""
            p = pdf["p"].iloc[0]
            grid = np.zeros((steps + 1) * width, np.int64)
            grid[pdf["at"].to_numpy()] = pdf["d"].to_numpy()
            counts = grid.reshape(steps + 1, width).cumsum(0)[:steps]
            step = np.flatnonzero(counts.any(1))
            counts = counts[step]
            n = counts.sum(1)
            low, high = np.append(0, cuts[p] + 1), np.append(cuts[p], MOST)
            out = []
            for ranks in ((n - 1) // 2, n // 2):
                part, rank, held = _ranks(counts, ranks)
                out.append(pd.DataFrame({"p": p, "step": step, "part": part, "low": low[part], "high": high[part], "rank": rank, "held": held}))
            return pd.concat(out)

        marks = self._each(count, "p int, at int, d long").groupBy("p", "at").agg(F.sum("d").alias("d"))
        return marks.groupBy("p").applyInPandas(locate, "p int, step int, part int, low long, high long, rank long, held long").toPandas()

    def _near(self, cuts: dict[int, np.ndarray], asked: pd.DataFrame) -> Callable:
        """(target, bits) of the errors that lie in the ranges asked for at a step, some at a time.

        ``asked`` is in order of pv, part and step, so what a match can meet is a stretch of it."""
        steps, width = self.grid[2], self.cuts + 1
        held = {}
        for p, a in asked.groupby("p"):
            held[p] = (a.index[0], a["part"].to_numpy() * steps + a["step"].to_numpy(), a["low"].to_numpy(), a["high"].to_numpy())

        def near(p: int, errors: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            if p not in held:
                return
            base, cell, low, high = held[p]
            upto = np.append(0, np.bincount(cell, minlength=width * steps).cumsum())
            for bits, first, last in errors():
                line = np.searchsorted(cuts[p], bits) * steps
                begin = upto[line + first]
                count = upto[line + last + 1] - begin
                some = np.flatnonzero(count)
                ends = count[some].cumsum()
                a = 0
                while a < len(some):
                    b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, side="right")))
                    pair = np.repeat(some[a:b], count[some[a:b]])
                    target, value = begin[pair] + _places(count[some[a:b]]), bits[pair]
                    holds = (low[target] <= value) & (value <= high[target])
                    yield base + target[holds], value[holds]
                    a = b

        return near

    def _narrowed(self, cuts: dict[int, np.ndarray], asked: pd.DataFrame) -> pd.DataFrame:
        """The ranges cut again, each drawn together to the least and the largest error in it."""
        near, parts = self._near(cuts, asked), self.cuts
        low, high = asked["low"].to_numpy(), asked["high"].to_numpy()
        wide = (high - low) // parts + 1
        ends = {p: (a.index[0], a.index[-1] + 1) for p, a in asked.groupby("p")}
        ranks = asked[["r1", "r2", "asks"]].to_numpy()

        def count(p: int, errors: Callable) -> pd.DataFrame:
            first, stop = ends.get(p, (0, 0))
            c, least, most = (np.full((stop - first) * parts, x, np.int64) for x in (0, MOST, 0))
            for target, bits in near(p, errors):
                at = (target - first) * parts + (bits - low[target]) // wide[target]
                order = np.argsort(at)
                at, bits = at[order], bits[order]
                begin = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
                if len(begin):
                    cell = at[begin]
                    c[cell] += np.diff(np.append(begin, len(at)))
                    least[cell] = np.minimum(least[cell], np.minimum.reduceat(bits, begin))
                    most[cell] = np.maximum(most[cell], np.maximum.reduceat(bits, begin))
            at = np.flatnonzero(c)
            return pd.DataFrame({"p": p, "at": at, "c": c[at], "least": least[at], "most": most[at]})

        def locate(pdf: pd.DataFrame) -> pd.DataFrame:
            first, stop = ends[pdf["p"].iloc[0]]
            at = pdf["at"].to_numpy()
            c, least, most = (np.zeros((stop - first) * parts, np.int64) for _ in range(3))
            c[at], least[at], most[at] = pdf["c"].to_numpy(), pdf["least"].to_numpy(), pdf["most"].to_numpy()
            c, least, most = (x.reshape(-1, parts) for x in (c, least, most))
            out, line = [], np.arange(stop - first)
            for k in (0, 1):
                place, rank, held = _ranks(c, ranks[first:stop, k])
                one = pd.DataFrame({"target": first + line, "low": least[line, place], "high": most[line, place], "rank": rank, "held": held})
                out.append(one if k == 0 else one[ranks[first:stop, 2] == 2])
            return pd.concat(out)

        marks = self._each(count, "p int, at int, c long, least long, most long")
        marks = marks.groupBy("p", "at").agg(F.sum("c").alias("c"), F.min("least").alias("least"), F.max("most").alias("most"))
        out = marks.groupBy("p").applyInPandas(locate, "target int, low long, high long, rank long, held long").toPandas()
        return out.join(asked[["p", "step", "part"]], on="target").drop(columns="target")

    def scores(self) -> DataFrame:
        """(p, step, score)"""
        spark = self.rows.sparkSession
        cuts = self._first_cuts()
        found, known = self._located(cuts), []
        while True:
            one = found["low"] == found["high"]
            known.append(found[one])
            asked = found[~one].groupby(["p", "part", "step", "low", "high"], as_index=False).agg(
                r1=("rank", "min"), r2=("rank", "max"), asks=("rank", "size"), held=("held", "first")
            )
            if asked["held"].sum() <= NEAR * len(cuts):
                break
            found = self._narrowed(cuts, asked)
        known = pd.concat(known)
        known = pd.DataFrame({"p": known["p"], "step": known["step"], "v": known["low"].to_numpy(np.int64).view(float), "hits": 1})
        hits = spark.createDataFrame(known.astype({"hits": "int32"}), "p int, step int, v double, hits int") if len(known) else None
        if len(asked):
            ranked = self._ranked(cuts, asked)
            hits = ranked if hits is None else hits.unionByName(ranked)
        if hits is None:
            return spark.createDataFrame([], "p int, step int, score double")
        return hits.groupBy("p", "step").agg((F.sum(F.col("v") * F.col("hits")) / 2).alias("score"))

    def _ranked(self, cuts: dict[int, np.ndarray], asked: pd.DataFrame) -> DataFrame:
        """(p, step, v, hits): the errors at the ranks asked for."""
        near, spark = self._near(cuts, asked), self.rows.sparkSession

        def count(p: int, errors: Callable) -> pd.DataFrame:
            held = [pd.DataFrame({"target": np.zeros(0, np.int64), "bits": np.zeros(0, np.int64), "c": np.zeros(0, np.int64)})]
            for target, bits in near(p, errors):
                held.append(pd.DataFrame({"target": target, "bits": bits, "c": 1}).groupby(["target", "bits"], as_index=False).sum())
            return pd.concat(held)

        counted = self._each(count, "target int, bits long, c long").groupBy("target", "bits").agg(F.sum("c").alias("c"))
        scan = Ordered(materialize(counted), ["target"], ["bits"], bound=int(asked["held"].max())).with_cumsum("upto", F.col("c"))
        targets = asked.assign(target=asked.index)[["target", "p", "step", "r1", "r2", "asks"]]
        targets = spark.createDataFrame(targets, "target int, p int, step int, r1 long, r2 long, asks int")
        rows = scan.frame().join(small_side(targets, len(asked)), "target")
        under = F.col("upto") - F.col("c")
        hits = (F.when((under <= F.col("r1")) & (F.col("r1") < F.col("upto")), 1).otherwise(0)
                + F.when((F.col("asks") == 2) & (under <= F.col("r2")) & (F.col("r2") < F.col("upto")), 1).otherwise(0))
        rows = rows.select("p", "step", "bits", hits.alias("hits")).where("hits > 0")

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"p": b["p"], "step": b["step"], "v": b["bits"].to_numpy(np.int64).view(float), "hits": b["hits"]})

        return rows.mapInPandas(read, "p int, step int, v double, hits int")


def offset_scores(
    historian: DataFrame, traffic: DataFrame, pv: str, time: str, value: str, tie: str, start: int, step: int, steps: int, tolerance: int,
    prepared: Prepared | None = None,
) -> DataFrame:
    """(offset, joint_score, pvs): the median scaled error of each pv at each offset of the grid, and its mean over the pvs.

    Times, start, step and tolerance are whole numbers of one unit.  Rows without time or finite value take no part; a pv
    without a match at an offset is left out of its mean; an offset without any match gives no row.  ``prepared``: what
    ``prepare`` gave for these tables and for offsets that hold this grid, when several grids search them."""
    found = prepared or prepare(historian, traffic, pv, time, value, tie, tolerance, start, start + step * (steps - 1))
    first = np.flatnonzero(found.units["p"].diff().fillna(1).to_numpy()).tolist()
    bounds = [*first[::SERIES], len(found.units)]
    per = historian.sparkSession.createDataFrame([], "p int, step int, score double")
    for a, b in zip(bounds, bounds[1:]):
        per = per.unionByName(_Medians(found, range(a, b), start, step, steps).scores())
    per = per.join(small_side(found.names, len(found.scales)), "p")
    offset = F.lit(start) + F.col("step").cast("long") * step
    # Added up in the order of the pvs, so that equal scores give equal means and a tie stays one.
    scores = F.array_sort(F.collect_list(F.struct("_pv", "score")))
    mean = F.aggregate(scores, F.lit(0.0), lambda total, s: total + s["score"]) / F.size(scores)
    return per.groupBy(offset.alias("offset")).agg(mean.alias("joint_score"), F.count(F.lit(1)).alias("pvs"))


def best_offset(scores: DataFrame, prior: float) -> DataFrame:
    """Smallest score; ties go to the offset nearest the prior, then the smaller."""
    order = F.struct("joint_score", F.abs(F.col("offset") - prior).alias("d"), "offset")
    return scores.agg(F.min(order).alias("b")).select("b.offset", "b.joint_score")


def grid(center: int, radius: int, step: int) -> tuple[int, int, int]:
    """(start, step, steps) of the offsets from center - radius to center + radius."""
    return center - radius, step, round(2 * radius / step) + 1
