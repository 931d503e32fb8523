"""Order-dependent and iterative operators against brute force."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracelode.functions import binary
from tracelode.operators import blocks, greedy, matching, periods, segmentation, similarity, subspace
from tracelode.operators.consistency import streaks
from tracelode.operators.metrics import fit_metrics, label_times
from tracelode.operators.sessions import sessionize


def _greedy(values, span):
    kept, last = [], None
    for v in sorted(values):
        if last is None or v - last >= span:
            kept.append(v)
            last = v
    return kept


@pytest.mark.parametrize("conf", ["spark", "chunked"])
def test_greedy_select(request, conf):
    spark = request.getfixturevalue(conf)
    rng = random.Random(3)
    data = [(k, p) for k in ("a", "b") for p in sorted(rng.sample(range(400), 150))] + [("run", p) for p in range(90)]
    df = spark.createDataFrame(data, "k string, p long")
    rows = greedy.greedy_select(df, ["k"], "p", F.lit(4)).collect()
    for key in ("a", "b", "run"):
        expected = _greedy([p for k, p in data if k == key], 4)
        assert sorted(r["p"] for r in rows if r["k"] == key) == expected


def test_period_of_a_noisy_cycle(spark):
    cycle = "C-66-3,S-71-3,C-66-2,S-64-2,C-66-1,S-64-1".split(",")
    tokens = cycle * 40
    for at in (50, 111, 190):
        tokens.insert(at, "C-1-9")
    rows = [("s", i, i * 100_000, t) for i, t in enumerate(tokens)]
    df = spark.createDataFrame(rows, "session string, n long, ts long, token string")
    config = periods.PeriodConfig(autocorr_threshold=0.3, max_lag=20)
    out = periods.identify_periods(df, ["session"], ["n"], "ts", "token", config).collect()
    assert [r["period"] for r in out] == [6]
    row = out[0]
    assert row["coverage"] == pytest.approx(6 * row["segments"] / len(tokens))
    # Any phase that starts at a client token is a valid base of the same cycle.
    shifts = [cycle[k:] + cycle[:k] for k in range(0, 6, 2)]
    assert row["period_pattern"].split(",") in shifts


def test_constant_and_dynamic_runs(spark):
    df = spark.createDataFrame([("s", bytearray(b"\x00" + bytes([i]) + b"A")) for i in (1, 2, 3)], "session string, payload binary")
    sizes = blocks.lengths(df, ["session"])
    stats = blocks.position_stats(blocks.byte_histogram(df, ["session"]), sizes, ["session"])
    fixed = sorted((r["start_position"], r["end_position"]) for r in blocks.constant_blocks(stats, ["session"]).collect())
    moving = blocks.dynamic_blocks(stats, ["session"])
    assert fixed == [(0, 0), (2, 2)]
    extended = blocks.extend_blocks(moving, sizes, ["session"], 1).first()
    assert (extended["extended_start"], extended["extended_end"]) == (0, 2)


def test_decoding(spark):
    df = spark.createDataFrame(
        [(bytearray.fromhex("41480000"), bytearray.fromhex("0102"), bytearray.fromhex("8000000000000005"))], "a binary, b binary, c binary"
    )
    row = df.select(
        binary.float32(F.col("a"), 0).alias("f"), binary.uint(F.col("b"), 0, 2, "little").alias("u"), binary.uint(F.col("c"), 0, 8).alias("w")
    ).first()
    assert (row["f"], row["u"], int(row["w"])) == (12.5, 513, 9223372036854775813)


def test_session_boundary(spark):
    df = spark.createDataFrame([("s", 0.0), ("s", 100.0), ("s", 200.001)], "k string, t double")
    rows = sessionize(df, ["k"], "t", ["t"], 100.0).frame().orderBy("t").collect()
    assert [r["session_no"] for r in rows] == [1, 1, 2]


@pytest.mark.parametrize("conf", ["spark", "chunked"])
def test_alarm_gating(request, conf):
    spark = request.getfixturevalue(conf)
    flags = [0, 1, 1, 1, 0, 1]
    df = spark.createDataFrame([("s", i, bool(f)) for i, f in enumerate(flags * 6)], "k string, i long, f boolean")
    rows = streaks(df, ["k"], ["i"], "f", 3).orderBy("i").collect()
    assert [r["i"] for r in rows if r["alarm_flag"]][0] == 3
    assert [r["consecutive_count"] for r in rows][:6] == [0, 1, 2, 3, 0, 1]


def test_fit_metric_edges(spark):
    df = spark.createDataFrame([("exact", 2.0, 2.0), ("exact", 2.0, 2.0), ("off", 1.0, 2.0), ("off", 3.0, 2.0), ("zero", 1.0, 0.0)], "k string, p double, t double")
    rows = {r["k"]: r for r in fit_metrics(df, ["k"], "p", "t").collect()}
    assert (rows["exact"]["r2"], rows["off"]["r2"], rows["zero"]["r2"]) == (1.0, 0.0, 0.0)
    assert rows["zero"]["mape"] == float("inf")


def test_column_claims(spark):
    scores = [("s", "c1", "f1", 0.9), ("s", "c1", "f2", 0.5), ("s", "c2", "f1", 0.8), ("s", "c2", "f2", 0.7), ("s", "c3", "f1", 0.3)]
    df = spark.createDataFrame(scores, "s string, c string, f string, score double").withColumn("t", F.lit(0.4))
    got = {r["c"]: r["f"] for r in matching.column_claims(df, ["s"], "c", "f", "score", "t").collect()}
    assert got == {"c1": "f1", "c2": "f2"}


def test_greedy_assignment(spark):
    rng = random.Random(5)
    pairs = [(a, b, round(rng.random(), 3)) for a in range(6) for b in range(5)]
    taken_a, taken_b, expected = set(), set(), set()
    for a, b, s in sorted(pairs, key=lambda x: (-x[2], x[0], x[1])):
        if a not in taken_a and b not in taken_b:
            expected.add((a, b))
            taken_a.add(a)
            taken_b.add(b)
    got = matching.greedy_assignment(spark.createDataFrame(pairs, "a int, b int, s double"), "a", "b", "s").collect()
    assert {(r["a"], r["b"]) for r in got} == expected


@pytest.mark.parametrize("conf", ["spark", "chunked"])
def test_subspace_scores(request, conf):
    spark = request.getfixturevalue(conf)
    rng = np.random.default_rng(1)
    x = np.sin(np.arange(120) / 5) + rng.normal(0, 0.1, 120)
    lag, rank, n = 8, 3, 80
    df = spark.createDataFrame(pd.DataFrame({"channel": "c", "i": np.arange(120), "v": x}))
    got = subspace.detect(df, "channel", lag, rank).orderBy("i").toPandas()
    windows = np.lib.stride_tricks.sliding_window_view(x[:n], lag).T
    values, vectors = np.linalg.eigh(windows @ windows.T)
    basis = vectors[:, np.argsort(values)[::-1][:rank]]
    centre = basis.T @ windows.mean(axis=1)
    every = np.lib.stride_tricks.sliding_window_view(x, lag)
    expected = ((centre - every @ basis) ** 2).sum(axis=1)
    assert np.allclose(got["score"], expected, atol=1e-8)
    assert got["threshold"].iloc[0] == pytest.approx(expected[n - lag + 1 :].max() + 1e-6)


@pytest.mark.parametrize("run", ["big", "little"])
def test_segmentation_is_exact(run):
    """The best answer of 200 random blocks, with one path kept for each state, against enumeration."""
    for seed in range(200):
        rng = random.Random(seed)
        size, rows = 6, []
        entropy = [rng.random() * 3 for _ in range(size)]
        for start in range(size):
            for length in range(1, size - start + 1):
                rows.append(
                    dict(start=start, length=length, confidence=round(rng.random(), 3), is_dynamic=rng.random() > 0.3, endian=rng.choice([run, "n/a", "n/a"]),
                         first_entropy=entropy[start], last_entropy=entropy[start + length - 1], on_block=start >= 2, block_start=0, block_end=size - 1)
                )
        at = {(r["start"], r["length"]): r for r in rows}
        best = 0.0
        for cuts in itertools.product([0, 1], repeat=size - 1):
            ends = [i for i, c in enumerate(cuts) if c] + [size - 1]
            starts = [0] + [e + 1 for e in ends[:-1]]
            fields = [at[s, e - s + 1] for s, e in zip(starts, ends)]
            mean = sum(f["confidence"] * (1.0 if f["on_block"] else 0.9) for f in fields) / len(fields)
            if run == "big":
                pairs = [not a["is_dynamic"] or a["last_entropy"] > b["first_entropy"] for a, b in zip(fields, fields[1:])]
            else:
                pairs = [not b["is_dynamic"] or a["last_entropy"] < b["first_entropy"] for a, b in zip(fields, fields[1:])]
            share = sum(pairs) / len(pairs) if pairs and any(f["endian"] != "n/a" for f in fields) else 0.5
            best = max(best, 0.10 + 0.65 * mean + 0.20 * share + 0.05)
        assert segmentation._search(pd.DataFrame(rows), run, 1)[0][0] == pytest.approx(best), seed


def test_long_series_are_warped_at_full_length():
    rng = np.random.default_rng(5)
    x, y = rng.random(8192), rng.random(8192)
    assert 0 < similarity.multilevel_dtw(x, y, 1) < np.abs(x - y).sum()


def test_warping_distance():
    rng = np.random.default_rng(2)
    x = rng.random(64)
    assert similarity.multilevel_dtw(x, x, 1) == 0.0
    y = np.roll(x, 1)
    exact = similarity._banded(x, y, None)[0]
    assert exact <= similarity.multilevel_dtw(x, y, 1) + 1e-9
    assert similarity.multilevel_dtw(x, y, 64) == pytest.approx(exact)


@pytest.mark.parametrize("conf", ["spark", "chunked"])
@pytest.mark.parametrize("most", [0, 1000])
def test_interval_labels(request, conf, most):
    spark = request.getfixturevalue(conf)
    rng = random.Random(8)
    spans = [(s, s + rng.randint(0, 40)) for s in rng.sample(range(1000), 30)]
    times = [rng.randrange(1100) for _ in range(200)]
    points = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i long, t long")
    intervals = spark.createDataFrame(spans, "s long, e long")
    got = {r["i"]: r["hit"] for r in label_times(points, "t", intervals, "s", "e", "hit", most).collect()}
    assert got == {i: any(s <= t < e for s, e in spans) for i, t in enumerate(times)}
