"""One-class models: covariance envelopes, plain and robust, isolation forest and kernel machine."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelode.plans.quantiles import quantile, quantiles


def scaled(train: DataFrame, columns: Sequence[str]) -> list[tuple[str, float, float]]:
    """Mean and population deviation per column: one row, bounded by the schema."""
    row = train.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return [(c, float(row[f"m_{c}"]), float(row[f"s_{c}"]) or 1.0) for c in columns]


def standardize(df: DataFrame, stats: list[tuple[str, float, float]]) -> DataFrame:
    return df.withColumns({f"z_{c}": (F.col(c) - m) / s for c, m, s in stats})


def subsample(df: DataFrame, key: str, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` training rows, the ones with the smallest seeded hash."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(most)


def envelope(train: DataFrame, columns: Sequence[str], contamination: float = 0.01):
    """Squared Mahalanobis distance expression and its threshold.

    Mean and covariance are two aggregates; only a d x d matrix reaches the driver."""
    d = len(columns)
    pairs = [(a, b) for a in range(d) for b in range(a, d)]
    row = train.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.covar_pop(columns[a], columns[b]).alias(f"c{a}_{b}") for a, b in pairs],
    ).first()
    mean = [float(row[f"m{i}"]) for i in range(d)]
    cov = np.zeros((d, d))
    for a, b in pairs:
        cov[a, b] = cov[b, a] = float(row[f"c{a}_{b}"])
    inverse = np.linalg.pinv(cov)
    distance = F.lit(0.0)
    for a in range(d):
        for b in range(d):
            distance = distance + (F.col(columns[a]) - mean[a]) * (F.col(columns[b]) - mean[b]) * float(inverse[a, b])
    limit = quantiles(train.select(distance.alias("d")), [], "d", {"t": 1 - contamination}).first()["t"]
    return distance, float(limit)


_NODE = "tree int, node int, feature int, cut double, left int, right int, size int"


def isolation_trees(train: DataFrame, key: str, columns: Sequence[str], trees: int = 32, sample: int = 256, seed: int = 42) -> DataFrame:
    """Forest as a node table.  Every tree draws its own hash sample of ``sample`` rows
    (the method's subsampling), so a task never sees more than that."""
    total = train.count()
    # Hash thinning before the exact cut keeps the sort small on large inputs.
    share = min(1.0, 4.0 * sample / max(1, total))
    def unit(tree: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), tree, F.col(key)), F.lit(1 << 30)) / float(1 << 30)

    # A row is copied only for the trees that may draw it.
    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: unit(tree) <= share)
    thin = train.select(key, *columns, F.explode(drawn).alias("tree")).withColumn("_u", unit(F.col("tree")))
    names = list(columns)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_u", key]).head(sample)
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng(seed + tree)
        data = pdf[names].to_numpy(dtype=float)
        limit = int(np.ceil(np.log2(max(2, len(data)))))
        nodes, todo = [], [(0, np.arange(len(data)), 0)]
        following = 1
        while todo:
            node, rows, depth = todo.pop()
            part = data[rows]
            spread = [k for k in range(len(names)) if len(rows) > 1 and part[:, k].min() < part[:, k].max()]
            if depth >= limit or not spread:
                nodes.append((tree, node, -1, 0.0, -1, -1, len(rows)))
                continue
            k = int(rng.choice(spread))
            cut = float(rng.uniform(part[:, k].min(), part[:, k].max()))
            below = part[:, k] < cut
            nodes.append((tree, node, k, cut, following, following + 1, len(rows)))
            todo += [(following, rows[below], depth + 1), (following + 1, rows[~below], depth + 1)]
            following += 2
        return pd.DataFrame(nodes, columns=[f.split()[0] for f in _NODE.split(", ")])

    return thin.groupBy("tree").applyInPandas(grow, _NODE)


def _average_path(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    return np.where(n > 2, 2 * (np.log(safe - 1) + 0.5772156649) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


def isolation_scores(df: DataFrame, forest: DataFrame, columns: Sequence[str], sample: int = 256) -> DataFrame:
    """Anomaly score per row; the forest is bounded by trees x sample and broadcast."""
    rows = forest.orderBy("tree", "node").toPandas()
    packed = [
        tuple(part[c].to_numpy() for c in ("feature", "cut", "left", "right", "size")) for _, part in rows.groupby("tree", sort=True)
    ]
    shared = df.sparkSession.sparkContext.broadcast(packed)
    # Trees of fewer rows than ``sample`` are normalised by what they have.
    grown = int(rows.loc[rows["node"] == 0, "size"].max())
    norm = float(_average_path(np.array([min(sample, grown)]))[0])

    @F.pandas_udf(T.DoubleType())
    def score(data: pd.Series) -> pd.Series:
        x = np.array(data.tolist(), dtype=float)
        depth = np.zeros(len(x))
        for feature, cut, left, right, size in shared.value:
            at = np.zeros(len(x), dtype=int)
            steps = np.zeros(len(x))
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                f, i = feature[at[inner]], np.flatnonzero(inner)
                at[i] = np.where(x[i, f] < cut[at[i]], left[at[i]], right[at[i]])
                steps[i] += 1
            depth += steps + _average_path(size[at])
        return pd.Series(np.exp2(-depth / len(shared.value) / norm))

    return df.withColumn("anomaly", score(F.array(*[F.col(c).cast("double") for c in columns])))


# ---- robust covariance ------------------------------------------------------------------------------------------------


def chi2_quantile(share: float, degrees: int) -> float:
    """Quantile of the chi-squared distribution, by bisection on its series."""

    def below(x: float) -> float:
        a, half = degrees / 2, x / 2
        term = total = 1 / a
        for k in range(1, 10_000):
            term *= half / (a + k)
            total += term
            if term < total * 1e-16:
                break
        return total * math.exp(a * math.log(half) - half - math.lgamma(a)) if x > 0 else 0.0

    low, high = 0.0, 10.0 * (degrees + 10)
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < share else (low, middle)
    return (low + high) / 2


def _distance(columns: Sequence[str], mean: np.ndarray, cov: np.ndarray) -> Column:
    inverse = np.linalg.pinv(cov)
    out = F.lit(0.0)
    for a, x in enumerate(columns):
        for b, y in enumerate(columns):
            out = out + (F.col(x) - float(mean[a])) * (F.col(y) - float(mean[b])) * float(inverse[a, b])
    return out


def _moments(rows: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population covariance: one aggregate row of d + d (d + 1) / 2 numbers."""
    pairs = [(a, b) for a in range(len(columns)) for b in range(a, len(columns))]
    row = rows.agg(*[F.avg(c) for c in columns], *[F.covar_pop(columns[a], columns[b]) for a, b in pairs]).first()
    cov = np.zeros((len(columns), len(columns)))
    for (a, b), value in zip(pairs, row[len(columns) :]):
        cov[a, b] = cov[b, a] = value
    return np.array(row[: len(columns)], float), cov


def concentrated(x: np.ndarray, keep: int, mean: np.ndarray, cov: np.ndarray, steps: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Concentration steps: the ``keep`` rows nearest by the present covariance give the next one, whose determinant is never
    larger."""
    last = math.inf
    for _ in range(steps):
        apart = x - mean
        near = np.argpartition(np.einsum("ij,jk,ik->i", apart, np.linalg.pinv(cov), apart), keep - 1)[:keep]
        mean, cov = x[near].mean(axis=0), np.cov(x[near], rowvar=False, bias=True).reshape(x.shape[1], -1)
        size = float(np.linalg.det(cov))
        if size >= last * (1 - 1e-12) or size <= 0:
            break
        last = size
    return float(np.linalg.det(cov)), mean, cov


def robust_envelope(
    train: DataFrame, key: str, columns: Sequence[str], contamination: float = 0.01, support: float | None = None, sample: int = 5_000, starts: int = 60, seed: int = 42
) -> tuple[Column, float]:
    """Squared distance under the covariance of least determinant, and the threshold that ``contamination`` of the rows exceed.

    Starting points come from a bounded sample (``sample`` rows by hash): random subsets of d + 1 rows, two concentration
    steps each, the ten best to the end.  The best one is then concentrated on all rows in Spark, a quantile and an
    aggregate a step, scaled to the chi-squared median, and reweighted by the rows inside the 97.5 % quantile.  ``support``
    is the share of rows that a concentration keeps, by default just over a half."""
    columns = list(columns)
    d = len(columns)
    x = subsample(train.select(key, *columns), key, sample, seed).select(*columns).toPandas().to_numpy(float)
    share = support if support is not None else min(1.0, (len(x) + d + 1) / 2 / len(x))
    keep = max(d + 1, min(len(x), math.ceil(share * len(x))))
    rng = np.random.default_rng(seed)
    first = []
    for _ in range(starts):
        pick = x[rng.choice(len(x), min(len(x), d + 1), replace=False)]
        cov = np.cov(pick, rowvar=False, bias=True).reshape(d, d) + np.eye(d) * 1e-9
        first.append(concentrated(x, keep, pick.mean(axis=0), cov, 2))
    best = min((concentrated(x, keep, m, c, 50) for _, m, c in sorted(first, key=lambda f: f[0])[:10]), key=lambda f: f[0])
    mean, cov, last = best[1], best[2], math.inf
    rows = train.select(*columns)
    total = rows.select(F.count(_distance(columns, mean, cov))).first()[0]
    guess, limit = None, math.inf
    for _ in range(30):
        distance, before = _distance(columns, mean, cov), limit
        limit = quantile(rows.select(distance.alias("d")), "d", share, guess=guess)
        moved = abs(limit - before)  # limits move less from step to step; a bracket of many values would save nothing
        guess = (total, limit - 2 * moved, limit + 2 * moved) if 0 < moved < limit * 2e-3 else None
        mean, cov = _moments(rows.where(distance <= limit), columns)
        size = float(np.linalg.det(cov))
        if size >= last * (1 - 1e-9) or size <= 0:
            break
        last = size
    middle = quantile(rows.select(_distance(columns, mean, cov).alias("d")), "d", 0.5)
    cov = cov * (middle / chi2_quantile(0.5, d))
    mean, cov = _moments(rows.where(_distance(columns, mean, cov) < chi2_quantile(0.975, d)), columns)
    distance = _distance(columns, mean, cov)
    limit = quantile(rows.select(distance.alias("d")), "d", 1 - contamination)
    return distance, float(limit)


# ---- kernel machine ---------------------------------------------------------------------------------------------------


@dataclass
class KernelMachine:
    """Support vectors of a one-class machine on scaled columns: f(x) = sum of weight * kernel(vector, x) - offset."""

    columns: list[str]
    stats: list[tuple[str, float, float]]
    vectors: np.ndarray
    weights: np.ndarray
    offset: float
    kernel: str
    gamma: float

    def decision(self, x: np.ndarray) -> np.ndarray:
        return kernel_matrix(x, self.vectors, self.kernel, self.gamma) @ self.weights - self.offset


def kernel_matrix(a: np.ndarray, b: np.ndarray, kernel: str, gamma: float) -> np.ndarray:
    if kernel == "rbf":
        return np.exp(-gamma * np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))
    if kernel == "sigmoid":
        return np.tanh(gamma * a @ b.T)
    raise ValueError(f"unknown kernel {kernel!r}")


def solve_dual(k: np.ndarray, nu: float, tolerance: float = 1e-4, most: int = 200_000) -> tuple[np.ndarray, float]:
    """Weights a in [0, 1] with the sum nu * n that make a' K a least, and the offset: the pair that violates optimality most is
    moved until none does by more than ``tolerance``."""
    n = len(k)
    total = nu * n
    a = np.clip(total - np.arange(n), 0.0, 1.0)
    g = k @ a
    for _ in range(most):
        up, down = np.where(a < 1, g, np.inf), np.where(a > 0, g, -np.inf)
        i, j = int(up.argmin()), int(down.argmax())
        if down[j] - up[i] < tolerance:
            break
        step = min((g[j] - g[i]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12), 1 - a[i], a[j])
        a[i] += step
        a[j] -= step
        a[j] = 0.0 if a[j] < 1e-15 else a[j]
        g += step * (k[:, i] - k[:, j])
    free = (a > 1e-12) & (a < 1 - 1e-12)
    offset = float(g[free].mean()) if free.any() else float((np.where(a < 1, g, np.inf).min() + np.where(a > 0, g, -np.inf).max()) / 2)
    return a, offset


def kernel_machine(train: DataFrame, key: str, columns: Sequence[str], nu: float = 0.01, kernel: str = "rbf", gamma: str | float = "scale", sample: int = 2_000, seed: int = 42) -> KernelMachine:
    """One-class machine of at most ``sample`` training rows, chosen by hash; the dual of a bounded sample is small.

    ``gamma`` is ``scale``, one over the columns' number times the variance of the scaled sample, ``auto``, one over the columns'
    number, or a value."""
    columns = list(columns)
    stats = scaled(train, columns)
    x = subsample(train.select(key, *columns), key, sample, seed).select(*columns).toPandas().to_numpy(float)
    x = (x - [m for _, m, _ in stats]) / [s for _, _, s in stats]
    width = {"scale": 1 / (len(columns) * max(float(x.var()), 1e-12)), "auto": 1 / len(columns)}.get(gamma, gamma)
    weights, offset = solve_dual(kernel_matrix(x, x, kernel, width), nu)
    used = weights > 1e-12
    return KernelMachine(columns, stats, x[used], weights[used], offset, kernel, float(width))


def kernel_decisions(df: DataFrame, machine: KernelMachine, name: str = "decision") -> DataFrame:
    """``df`` with the decision value of every row; rows below 0 are outliers.  The support vectors are bounded by the sample."""
    shared = df.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf(T.DoubleType())
    def decide(*parts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.decision(np.column_stack([p.to_numpy(float) for p in parts])))

    return df.withColumn(name, decide(*((F.col(c) - m) / s for c, m, s in machine.stats)))
