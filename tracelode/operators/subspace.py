"""Departure scores of sliding windows from a trained signal subspace.

Training needs the Gram matrix of all length-L windows.  Its entries are sums of
lagged products minus a few terms at both ends of the series, so Spark sums
products per block (a bounded task each) and only L sums plus 2 L edge values per
channel meet in the small eigen problem."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.plans.ordered import halo
from tracelode.plans.sizing import small_side
from tracelode.session import materialize


def split_training(df: DataFrame, channel: str, lag: int, position: str = "i", share: float = 2 / 3) -> DataFrame:
    """``part``: train for the first two thirds (at least lag + 1 rows), else calibration."""
    n = df.groupBy(channel).agg((F.max(position) + 1).alias("_n"))
    cut = F.greatest(F.lit(lag + 1), F.ceil(F.col("_n") * share))
    joined = df.join(small_side(n), channel)
    return joined.withColumn("part", F.when(F.col(position) < cut, "train").otherwise("calibration")).drop("_n")


def _lag_sums(train: DataFrame, channel: str, lag: int) -> DataFrame:
    kind = train.schema[channel].dataType.simpleString()

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        x = pdf["v"].to_numpy(dtype=float)
        own = int((pdf["_home"] == pdf["_blk"]).sum())
        sums = [float(np.dot(x[: min(own, len(x) - d)], x[d : d + min(own, len(x) - d)])) for d in range(lag)]
        total = float(x[:own].sum())
        return pd.DataFrame({channel: pdf[channel].iloc[0], "d": range(lag + 1), "s": [*sums, total], "n": own})

    blocks = halo(train.select(channel, "i", "v"), [channel], "i", 0, lag - 1)
    # ``before`` is 0: the only foreign rows of a block follow its own.
    parts = blocks.groupBy(channel, "_blk").applyInPandas(products, f"{channel} {kind}, d int, s double, n long")
    return parts.groupBy(channel, "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def train(series: DataFrame, channel: str, lag: int, rank: int, weighted: bool = False) -> DataFrame:
    """Model rows (channel, component, basis, projection, weight).

    ``series``: (channel, i, v) with dense i.  ``weighted`` scales components by the
    root of their singular-value share."""
    kind = series.schema[channel].dataType.simpleString()
    sums = _lag_sums(series, channel, lag)
    n = series.groupBy(channel).agg((F.max("i") + 1).alias("n"))
    ends = series.join(small_side(n), channel).where((F.col("i") < lag) | (F.col("i") >= F.col("n") - lag))
    rows = sums.select(channel, F.lit("sum").alias("k"), F.col("d").cast("long").alias("i"), F.col("s").alias("v"), "n").unionByName(
        ends.select(channel, F.lit("edge").alias("k"), F.col("i").cast("long"), F.col("v").cast("double"), "n")
    )

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        totals = pdf[pdf["k"] == "sum"].sort_values("i")["v"].to_numpy()
        count = int(pdf["n"].max())
        edge = dict(zip(pdf.loc[pdf["k"] == "edge", "i"], pdf.loc[pdf["k"] == "edge", "v"]))
        windows = count - lag + 1
        if windows < 1:
            return pd.DataFrame(columns=[channel, "component", "basis", "projection", "weight"])
        head = np.array([edge[i] for i in range(min(lag, count))])
        tail = np.array([edge[i] for i in range(max(0, count - lag), count)])
        gram = np.zeros((lag, lag))
        for d in range(lag):
            front = np.concatenate([[0.0], np.cumsum(head[: lag - d] * head[d:lag])])
            back = tail[: lag - d] * tail[d:lag]
            after = np.concatenate([[0.0], np.cumsum(back[::-1])])
            for a in range(lag - d):
                # Products i < a in front, and i > a + windows - 1 at the end.
                gram[a, a + d] = gram[a + d, a] = totals[d] - front[a] - after[lag - d - 1 - a]
        before = np.concatenate([[0.0], np.cumsum(head)])[:lag]
        behind = np.concatenate([[0.0], np.cumsum(tail[::-1])])
        centroid = (totals[lag] - before - behind[lag - 1 - np.arange(lag)]) / windows
        values, vectors = np.linalg.eigh(gram)
        top = [k for k in np.argsort(values)[::-1] if values[k] > 0][:rank]
        basis = vectors[:, top]
        singular = np.sqrt(values[top])
        weight = np.sqrt(singular / singular.sum()) if weighted else np.ones(len(top))
        return pd.DataFrame(
            {
                channel: pdf[channel].iloc[0], "component": range(len(top)), "basis": [basis[:, k].tolist() for k in range(len(top))],
                "projection": (basis.T @ centroid).tolist(), "weight": weight.tolist(),
            }
        )

    return rows.groupBy(channel).applyInPandas(solve, f"{channel} {kind}, component int, basis array<double>, projection double, weight double")


def score(series: DataFrame, model: DataFrame, channel: str, lag: int, carry: Sequence[str] = ()) -> DataFrame:
    """Score of every row with a full window ending at it.

    Blocks carry the ``lag - 1`` rows in front of them and meet the model of their
    channel block by block, so neither side has to fit one task."""
    kind = series.schema[channel].dataType.simpleString()
    keep = list(carry)
    types = ", ".join(f"{c} {series.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{channel} {kind}, i long, " + (types + ", " if keep else "") + "score double"
    blocks = halo(series.select(channel, "i", "v", *keep), [channel], "i", lag - 1, 0)
    places = blocks.select(channel, "_blk").distinct()
    models = places.join(small_side(model), channel).select(
        F.col(channel).alias("_mc"), F.col("_blk").alias("_mb"), "basis", "projection", "weight"
    )

    def project(key, rows: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        x = rows["v"].to_numpy(dtype=float)
        if len(x) < lag or parts.empty:
            return pd.DataFrame(columns=[channel, "i", *keep, "score"])
        basis = np.array(parts["basis"].tolist()).T
        view = np.lib.stride_tricks.sliding_window_view(x, lag)
        apart = (parts["projection"].to_numpy() - view @ basis) * parts["weight"].to_numpy()
        out = rows.iloc[lag - 1 :].copy()
        out["score"] = np.einsum("ij,ij->i", apart, apart)
        out = out[out["_home"] == out["_blk"]]
        return out[[channel, "i", *keep, "score"]]

    return blocks.groupBy(channel, "_blk").cogroup(models.groupBy("_mc", "_mb")).applyInPandas(project, schema)


def thresholds(scores: DataFrame, channel: str, eps: float = 1e-6) -> DataFrame:
    """Largest calibration score plus a margin."""
    return scores.groupBy(channel).agg((F.max("score") + eps).alias("threshold"))


def alarms(scores: DataFrame, limits: DataFrame, channel: str, factor: float = 1.0) -> DataFrame:
    joined = scores.join(small_side(limits), channel)
    return joined.withColumn("alarm", F.col("score") >= F.col("threshold") * factor).withColumn("score_ratio", F.col("score") / F.col("threshold"))


def first_alarms(flagged: DataFrame, channel: str, time: str, start: int, end: int) -> DataFrame:
    """First alarm before and inside the attack window per channel."""
    t = F.when(F.col("alarm"), F.col(time))
    return flagged.groupBy(channel).agg(
        F.min(F.when(F.col(time) < start, t)).alias("pre"), F.min(F.when((F.col(time) >= start) & (F.col(time) < end), t)).alias("attack")
    )


def detect(series: DataFrame, channel: str, lag: int, rank: int, carry: Sequence[str] = (), eps: float = 1e-6, weighted: bool = False) -> DataFrame:
    """Train on the first two thirds, set thresholds on the rest and flag every row."""
    parts = materialize(split_training(series, channel, lag))
    model = materialize(train(parts.where(F.col("part") == "train"), channel, lag, rank, weighted))
    scored = score(parts, model, channel, lag, ["part", *carry])
    limits = thresholds(scored.where(F.col("part") == "calibration"), channel, eps)
    return alarms(scored, limits, channel)
