"""The offset search against every row tried at every offset."""

import random

import numpy as np
import pandas as pd
import pytest

from tracelode.operators import calibration


def plain_scores(historian, traffic, start, step, steps, tolerance):
    out = {}
    for k in range(steps):
        offset, scores = start + k * step, {}
        for pv in {p for p, _, _ in historian}:
            rows = [(t, v) for p, t, v in historian if p == pv and t is not None and v is not None and np.isfinite(v)]
            values = np.array([v for _, v in rows])
            if not len(values):
                continue
            std = values.std(ddof=1) if len(values) > 1 else 0.0
            scale = max(std, (np.quantile(values, 0.75) - np.quantile(values, 0.25)) / 1.349, 1e-6)
            errors = []
            for t, v in rows:
                at = t + offset
                before = [(x, tie, y) for p, x, tie, y in traffic if p == pv and x <= at]
                after = [(x, tie, y) for p, x, tie, y in traffic if p == pv and x > at]
                found = max(before, key=lambda r: r[:2]) if before else None
                later = min(after, key=lambda r: r[:2]) if after else None
                if found is None or (later is not None and later[0] - at < at - found[0]):
                    found = later
                if found and abs(found[0] - at) <= tolerance and found[2] is not None and np.isfinite(found[2]):
                    errors.append(abs(found[2] - v) / scale)
            if errors:
                scores[pv] = float(np.median(errors))
        if scores:
            out[offset] = (float(np.mean(list(scores.values()))), len(scores))
    return out


@pytest.mark.parametrize("cuts", [256, 20])
@pytest.mark.parametrize("limit", ["2000000", "12"])
def test_offsets_against_every_row(spark, monkeypatch, cuts, limit):
    monkeypatch.setattr(calibration, "CUTS", cuts)
    spark.conf.set("spark.tracelode.maxGroupRows", limit)
    spark.conf.set("spark.tracelode.chunkRows", "7")
    try:
        rng = random.Random(4)
        historian = [(rng.choice("aab"), rng.randrange(-50, 2_000), round(rng.random(), 1)) for _ in range(120)]
        historian += [("a", 900, None), ("a", None, 1.0), ("a", 901, float("nan")), ("b", 902, float("inf")), ("c", 5, 1.0)]
        traffic = [(rng.choice("aabd"), rng.randrange(0, 400) * 5, k, round(rng.random(), 1)) for k in range(150)]
        traffic += [("a", 1_000, 200, None), ("b", 1_001, 201, float("nan")), ("b", 700, 202, 0.2), ("b", 700, 203, 0.9)]
        start, step, steps, tolerance = -300, 7, 90, 40
        left = spark.createDataFrame(historian, "pv string, t long, value double")
        right = spark.createDataFrame(traffic, "pv string, t long, tie long, value double")
        found = calibration.offset_scores(left, right, "pv", "t", "value", "tie", start, step, steps, tolerance)
        got = {r["offset"]: (r["joint_score"], r["pvs"]) for r in found.collect()}
        want = plain_scores(historian, traffic, start, step, steps, tolerance)
        assert got.keys() == want.keys() and len(got) == steps
        for offset, (score, pvs) in want.items():
            assert got[offset][1] == pvs and abs(got[offset][0] - score) < 1e-12, offset
    finally:
        spark.conf.unset("spark.tracelode.maxGroupRows")
        spark.conf.unset("spark.tracelode.chunkRows")


def test_no_traffic_gives_no_scores(spark):
    left = spark.createDataFrame([("a", 1, 2.0)], "pv string, t long, value double")
    right = spark.createDataFrame([], "pv string, t long, tie long, value double")
    assert calibration.offset_scores(left, right, "pv", "t", "value", "tie", 0, 1, 5, 10).count() == 0


def test_ties_go_to_the_prior(spark):
    scores = spark.createDataFrame([(-3, 1.0), (1, 1.0), (2, 1.0), (9, 2.0)], "offset long, joint_score double")
    assert calibration.best_offset(scores, 0).first()["offset"] == 1
    assert calibration.best_offset(scores, 1.5).first()["offset"] == 1


def _dense(seed=5):
    rng = random.Random(seed)
    historian = [("a", rng.randrange(0, 700), rng.random()) for _ in range(80)]
    return historian, [("a", t, k, rng.random()) for k, t in enumerate(rng.sample(range(-200, 1_200), 400))]


def _frames(spark, historian, traffic):
    return spark.createDataFrame(historian, "pv string, t long, value double"), spark.createDataFrame(traffic, "pv string, t long, tie long, value double")


def _same(scores, historian, traffic, start, step, steps, tolerance):
    got = {r["offset"]: (r["joint_score"], r["pvs"]) for r in scores.collect()}
    want = plain_scores(historian, traffic, start, step, steps, tolerance)
    assert got.keys() == want.keys()
    for offset, (score, pvs) in want.items():
        assert got[offset][1] == pvs and got[offset][0] == pytest.approx(score, rel=1e-12, abs=1e-12), offset


def test_matches_are_not_written(spark, monkeypatch):
    """Rows times the steps they match at: 4,800 here, and what made the search slow on large tables."""
    written = []
    keep = calibration.materialize

    def counted(df):
        out = keep(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(calibration, "materialize", counted)
    historian, traffic = _dense()
    found = calibration.offset_scores(*_frames(spark, historian, traffic), "pv", "t", "value", "tie", -100, 7, 60, 40)
    _same(found, historian, traffic, -100, 7, 60, 40)
    assert max(written) <= len(historian) + len(traffic)


@pytest.mark.parametrize("values", [[0.0], [0.0, 0.0, 1.0], [1e-9, 2e-9, 1e9, 1e9 + 1e-6], [0.0, 1.0, 5e-324, 1e-300]])
def test_medians_of_ranges_cut_again(spark, monkeypatch, values):
    """Few ranges and nothing written out: equal errors, a median between two far ones, and errors of any size."""
    monkeypatch.setattr(calibration, "CUTS", 5)
    monkeypatch.setattr(calibration, "NEAR", 0)
    rng = random.Random(6)
    historian = [(rng.choice("ab"), rng.randrange(0, 300), 0.0) for _ in range(40)]
    traffic = [(rng.choice("ab"), t, k, rng.choice(values)) for k, t in enumerate(range(-20, 330, 3))]
    found = calibration.offset_scores(*_frames(spark, historian, traffic), "pv", "t", "value", "tie", -30, 5, 13, 8)
    got = {r["offset"]: (r["joint_score"], r["pvs"]) for r in found.collect()}
    want = plain_scores(historian, traffic, -30, 5, 13, 8)
    assert got.keys() == want.keys()
    assert all(got[o][1] == want[o][1] and got[o][0] == pytest.approx(want[o][0], rel=1e-12, abs=0) for o in want)


def test_grids_share_what_is_prepared(spark, monkeypatch):
    """Also with pvs searched one at a time and errors near the medians taken in small pieces."""
    monkeypatch.setattr(calibration, "PAIRS", 50)
    monkeypatch.setattr(calibration, "SERIES", 1)
    historian, traffic = _dense(7)
    historian += [("b", 100, 1.0), ("b", 101, 3.0), ("c", 5, 1.0), (None, 5, 1.0)]
    traffic += [("b", 90, 400, 2.5), ("b", 120, 401, 7.0), ("d", 90, 402, 7.0), (None, 90, 403, 7.0)]
    left, right = _frames(spark, historian, traffic)
    historian, traffic = ([r for r in rows if r[0]] for rows in (historian, traffic))
    ready = calibration.prepare(left, right, "pv", "t", "value", "tie", 40, -100, 100)
    for grid in ((-100, 20, 11), (-30, 3, 9), (0, 1, 1)):
        found = calibration.offset_scores(left, right, "pv", "t", "value", "tie", *grid, 40, ready)
        _same(found, historian, traffic, *grid, 40)


@pytest.mark.parametrize("pairs", [1, 30, 10_000])
@pytest.mark.parametrize("step, steps", [(1, 40), (6, 9), (50, 3)])
def test_matches_in_pieces(monkeypatch, pairs, step, steps):
    """Rows that pass over more cells than steps, or fewer, taken some at a time; gaps and missing values match nothing."""
    monkeypatch.setattr(calibration, "PAIRS", pairs)
    rng = random.Random(8)
    ends = sorted(rng.sample(range(300), 120))
    cells = [(a, (a + b) // 2, b, rng.choice([1.0, 2.0, np.nan]), rng.choice([3.0, None])) for a, b in zip(ends[::2], ends[1::2])]
    times = np.array([rng.randrange(-30, 320) for _ in range(40)])
    want = set()
    for row, t in enumerate(times):
        for k in range(steps):
            for low, at, high, first, last in cells:
                seen = first if low <= t + k * step < at else last if at <= t + k * step <= high else None
                if seen is not None and np.isfinite(seen):
                    want.add((row, k, seen))
    got = []
    for found in calibration.matched_steps(times, pd.DataFrame(cells, columns=["low", "at", "high", "first", "last"]), step, steps):
        got += [(row, k, seen) for row, seen, first, last in zip(*found) for k in range(first, last + 1)]
    assert len(got) == len(want) and set(got) == want


def test_column_names_and_whole_times(spark):
    """Columns may have the names that the search uses itself, and times any whole type; tables may be empty."""
    historian, traffic = _dense(9)
    left = spark.createDataFrame(historian, "p string, t int, low float")
    right = spark.createDataFrame(traffic, "p string, t int, at long, low float")
    exact = [[(*r[:-1], float(np.float32(r[-1]))) for r in rows] for rows in (historian, traffic)]
    found = calibration.offset_scores(left, right, "p", "t", "low", "at", -100, 20, 11, 40)
    _same(found, *exact, -100, 20, 11, 40)
    assert calibration.offset_scores(left.limit(0), right, "p", "t", "low", "at", -100, 20, 11, 40).count() == 0


def test_many_pvs(spark, monkeypatch):
    monkeypatch.setattr(calibration, "SERIES", 40)
    rng = random.Random(10)
    historian = [(f"pv{rng.randrange(90)}", rng.randrange(60), rng.random()) for _ in range(400)]
    traffic = [(f"pv{rng.randrange(90)}", rng.randrange(60), k, rng.random()) for k in range(400)]
    found = calibration.offset_scores(*_frames(spark, historian, traffic), "pv", "t", "value", "tie", -5, 5, 3, 8)
    _same(found, historian, traffic, -5, 5, 3, 8)
