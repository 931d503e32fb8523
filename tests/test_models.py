"""Robust covariance, kernel machine and streaming first alarms against their definitions."""

import datetime
import math

import numpy as np
import pytest

from tracelode.operators import oneclass, scenarios, subspace
from tracelode.streaming import jobs


def planted(spark, n=600, bad=60):
    """Correlated normal rows with a tenth of far rows that mask each other."""
    rng = np.random.default_rng(5)
    good = rng.normal(size=(n - bad, 3)) @ np.array([[2.0, 0.5, 0.0], [0.0, 1.0, 0.3], [0.0, 0.0, 0.5]]) + [5, -3, 10]
    far = rng.normal(size=(bad, 3)) * 0.3 + [40, 30, -20]
    rows = [(k, *map(float, r), k >= n - bad) for k, r in enumerate(np.r_[good, far])]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, far boolean").repartition(4), good


def test_chi2_quantiles():
    # published table values
    for share, degrees, want in ((0.5, 1, 0.4549), (0.975, 2, 7.3778), (0.975, 5, 12.8325), (0.5, 10, 9.3418)):
        assert oneclass.chi2_quantile(share, degrees) == pytest.approx(want, abs=2e-4)


def test_robust_envelope_is_not_masked(spark):
    df, good = planted(spark)
    distance, limit = oneclass.robust_envelope(df, "id", ["a", "b", "c"], contamination=0.1)
    rows = df.withColumn("d", distance).collect()
    assert all((r["d"] > limit) == r["far"] for r in rows)
    plain, _ = oneclass.envelope(df, ["a", "b", "c"], 0.1)
    worst = max(r["d"] for r in df.where("not far").withColumn("d", plain).collect())
    assert min(r["d"] for r in df.where("far").withColumn("d", plain).collect()) < worst  # the plain one is
    # distances come near those of the good rows' own covariance
    mean, inverse = good.mean(axis=0), np.linalg.inv(np.cov(good, rowvar=False))
    own = np.array([(np.array([r["a"], r["b"], r["c"]]) - mean) @ inverse @ (np.array([r["a"], r["b"], r["c"]]) - mean) for r in rows if not r["far"]])
    got = np.array([r["d"] for r in rows if not r["far"]])
    assert 0.7 < np.median(got / own) < 1.4


def test_concentration_never_grows_the_determinant():
    x = np.random.default_rng(1).normal(size=(200, 2))
    last = math.inf
    for steps in range(1, 8):
        size, _, _ = oneclass.concentrated(x, 120, x[:3].mean(axis=0), np.cov(x[:3], rowvar=False), steps)
        assert size <= last * (1 + 1e-12)
        last = size


@pytest.mark.parametrize("kernel", ["rbf", "sigmoid"])
def test_dual_is_optimal(kernel):
    x = np.random.default_rng(3).normal(size=(150, 3))
    k = oneclass.kernel_matrix(x, x, kernel, 0.3)
    a, offset = oneclass.solve_dual(k, 0.1, 1e-6)
    g = k @ a
    assert a.sum() == pytest.approx(15) and a.min() >= 0 and a.max() <= 1
    assert (g[a < 1 - 1e-9] >= offset - 1e-4).all() and (g[a > 1e-9] <= offset + 1e-4).all()


def test_kernel_machine_finds_planted_rows(spark):
    df, _ = planted(spark)
    machine = oneclass.kernel_machine(df.where("not far"), "id", ["a", "b", "c"], nu=0.02)
    rows = oneclass.kernel_decisions(df, machine).collect()
    assert all(r["decision"] < 0 for r in rows if r["far"])
    assert sum(r["decision"] < 0 for r in rows if not r["far"]) <= 0.05 * 540
    assert len(machine.vectors) < 540
    sample = oneclass.kernel_machine(df.where("not far"), "id", ["a", "b", "c"], nu=0.05, sample=100)
    assert len(sample.vectors) <= 100


@pytest.mark.parametrize("splits", [1, 3, 7])
def test_streaming_first_alarms_do_not_depend_on_batches(spark, tmp_path, splits):
    rng = np.random.default_rng(8)
    lag, n = 6, 80
    base = {c: np.sin(np.arange(200) / (3 + k)) + rng.normal(scale=0.05, size=200) for k, c in enumerate("xyz")}
    train = spark.createDataFrame([(c, i, float(v)) for c, s in base.items() for i, v in enumerate(s[:120])], "ch string, i long, v double")
    model = subspace.train(train, "ch", lag, 2)
    live = {c: s[120:].copy() for c, s in base.items()}
    live["x"][50] += 4.0  # an alarm in the window
    live["y"][10] += 4.0  # one before it
    start, end, zero = 1_700_000_030.0, 1_700_000_070.0, 1_700_000_000
    limits = spark.createDataFrame([(c, 2.0) for c in "xyz"], "ch string, threshold double")
    tails = spark.createDataFrame([(c, [float(v) for v in s[120 - lag : 120]]) for c, s in base.items()], "ch string, tail array<double>")
    # every row scored at once
    want = set()
    parts = {c: rows.sort_values("component") for c, rows in model.toPandas().groupby("ch")}
    for c, values in live.items():
        windows = np.lib.stride_tricks.sliding_window_view(np.r_[base[c][120 - lag : 120], values], lag)[1:]
        apart = (parts[c]["projection"].to_numpy() - windows @ np.array(parts[c]["basis"].tolist()).T) * parts[c]["weight"].to_numpy()
        at = zero + np.flatnonzero((apart**2).sum(axis=1) >= 2.0)
        want |= {(c, phase, float(hits[0])) for phase, hits in (("before", at[at < start]), ("inside", at[(at >= start) & (at < end)])) if len(hits)}
    assert {w[:2] for w in want} >= {("x", "inside"), ("y", "before")}
    schema = "ch string, t timestamp, v double"
    edges = np.linspace(0, n, splits + 1).astype(int)
    for a, b in zip(edges[:-1], edges[1:]):
        rows = [(c, datetime.datetime.fromtimestamp(zero + i, datetime.UTC).replace(tzinfo=None), float(s[i])) for c, s in live.items() for i in range(a, b)]
        rows += [("unknown", rows[0][1], 99.0)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = jobs.first_alarms(stream, "ch", "t", "v", model, limits, tails, start, end, "1 hour")
    name = f"first_{splits}"
    query = found.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert {(r["ch"], r["phase"], r["ts"]) for r in spark.table(name).collect()} == want


@pytest.mark.parametrize("source", ["holdout", "base"])
def test_scenario_models_equal_single_ones(spark, source):
    """Every (scenario, test, channel) scored on its own by the definition: Gram matrix, projection, centroid, tail."""
    rng = np.random.default_rng(2)
    lag, rank = 5, 2
    train = {(s, c): np.sin(np.arange(90) / (2 + s + k)) + rng.normal(scale=0.05, size=90) for s in (1, 2) for k, c in enumerate("ab")}
    clean = {key: np.sin(np.arange(40) / 3) + rng.normal(scale=0.3, size=40) for key in train}
    tests = {(s, t, c): np.r_[train[s, c][-20:], rng.normal(scale=2.0, size=15)] for s, c in train for t in ("x", "y")}
    got = scenarios.scenario_alarms(
        spark.createDataFrame([(s, c, i, float(v)) for (s, c), x in train.items() for i, v in enumerate(x)], "scenario int, ch string, i long, v double"),
        spark.createDataFrame([(s, t, c, 1000 + i, float(v)) for (s, t, c), x in tests.items() for i, v in enumerate(x)], "scenario int, test string, ch string, at long, v double"),
        ["scenario"], ["test"], "ch", "at", lag, rank,
        spark.createDataFrame([(s, c, i, float(v)) for (s, c), x in clean.items() for i, v in enumerate(x)], "scenario int, ch string, i long, v double") if source == "base" else None,
    ).collect()
    found = {(r["scenario"], r["test"], r["ch"], r["at"]): (r["score"], r["threshold"], r["alarm"]) for r in got}
    assert len(found) == len(got) == sum(map(len, tests.values()))
    for (s, t, c), values in tests.items():
        whole = train[s, c]
        fitted, held = (whole, clean[s, c]) if source == "base" else (whole[:60], whole[60:])
        windows = np.lib.stride_tricks.sliding_window_view(fitted, lag)
        _, vectors = np.linalg.eigh(windows.T @ windows)
        basis = vectors[:, ::-1][:, :rank]
        centre = basis.T @ windows.mean(axis=0)

        def scores(x):
            return ((centre - np.lib.stride_tricks.sliding_window_view(np.r_[fitted[-(lag - 1) :], x], lag) @ basis) ** 2).sum(axis=1)

        limit = scores(held).max() + 1e-6
        for i, score in enumerate(scores(values)):
            a, b, alarm = found[s, t, c, 1000 + i]
            assert a == pytest.approx(score, rel=1e-6, abs=1e-9) and b == pytest.approx(limit, rel=1e-6) and alarm == (a >= b)
