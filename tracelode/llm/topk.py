"""Exact top-k by inner product: ball trees per shard, branch and bound.

Vectors are dealt to shards and query rows to blocks.  A shard's ball tree is searched
for a block of queries at once: a node is visited, better bound first, only by queries
whose upper bound (query . centre + |query| * radius) reaches their current kth score.
A first round searches one shard for each block and shares its kth scores; the second
round starts all other shards from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelode.llm.frames import shuffle_width
from tracelode.session import materialize

K = 5
SCALE = 256
QUERY_STEP = 50
LEAF = 128
SHARD_ROWS = 50_000
BLOCK_QUERIES = 5_000
NONE = np.iinfo(np.int64).min + 1  # its negative is a number too


class BallTree:
    """Rows in leaf order, and nodes with centre, radius, rows and children."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(rows))
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        self.root = self._build(rows, 0, len(rows), leaf)
        self.rows = rows[self.order]
        self.centre = np.array(self.centres)
        self.radius = np.array(self.radii)

    def _build(self, rows: np.ndarray, start: int, end: int, leaf: int) -> int:
        root = self._node(rows, start, end)
        queue = [root]
        while queue:
            node = queue.pop()
            start, end = self.spans[node]
            if end - start <= leaf:
                continue
            own = rows[self.order[start:end]]
            far = own[np.argmax(((own - self.centres[node]) ** 2).sum(1))]
            other = own[np.argmax(((own - far) ** 2).sum(1))]
            side = own @ (far - other)
            half = (end - start) // 2  # the median keeps the depth logarithmic, also for equal rows
            self.order[start:end] = self.order[start:end][np.argpartition(side, half)]
            pair = self._node(rows, start, start + half), self._node(rows, start + half, end)
            self.children[node] = pair
            queue.extend(pair)
        return root

    def _node(self, rows: np.ndarray, start: int, end: int) -> int:
        own = rows[self.order[start:end]]
        centre = own.mean(0)
        self.centres.append(centre)
        # Bounds are a little wide, so that rounding never hides a row.
        self.radii.append(float(np.sqrt(((own - centre) ** 2).sum(1).max(initial=0))) * (1 + 1e-9) + 1e-6)
        self.spans.append((start, end))
        self.children.append(None)
        return len(self.centres) - 1


class Best:
    """The k best (score, id) of each query, ties to the smaller id."""

    def __init__(self, bound: np.ndarray, k: int):
        self.k = k
        self.score = np.full((len(bound), k), NONE)
        self.id = np.full((len(bound), k), np.iinfo(np.int64).max)
        self.bound = bound  # a score that k rows are known to reach

    def floor(self, at: np.ndarray) -> np.ndarray:
        return np.maximum(self.bound[at], self.score[at, -1])

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        score = np.concatenate([self.score[at], scores], 1)
        key = np.concatenate([self.id[at], np.broadcast_to(ids, scores.shape)], 1)
        order = np.lexsort((key, -score))[:, : self.k]
        self.score[at] = np.take_along_axis(score, order, 1)
        self.id[at] = np.take_along_axis(key, order, 1)


def as_integers(values: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in values], object).reshape(values.shape)


def search(tree: BallTree, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, best: Best, exact: bool) -> None:
    """Fill ``best`` with the rows of the tree; row ``own`` of a query is not a candidate.

    ``exact``: products fit a double's whole numbers; otherwise leaves are multiplied as Python integers."""
    norm = np.sqrt((queries**2).sum(1))
    slack = 1e-9 * norm + 1e-6

    def bound(node: int, at: np.ndarray) -> np.ndarray:
        top = queries[at] @ tree.centre[node]
        return top + norm[at] * tree.radius[node] + slack[at] * (1 + np.abs(tree.centre[node]).sum())

    stack = [(tree.root, np.arange(len(queries)))]
    while stack:
        node, at = stack.pop()
        at = at[bound(node, at) >= best.floor(at)]
        if not len(at):
            continue
        if tree.children[node] is None:
            start, end = tree.spans[node]
            rows = tree.rows[start:end]
            if exact:
                scores = np.rint(queries[at] @ rows.T).astype(np.int64)
            else:
                whole = (as_integers(queries[at]) @ as_integers(rows).T).clip(NONE + 1, -NONE)
                scores = whole.astype(np.int64)
            keys = ids[tree.order[start:end]]
            scores = np.where(keys[None, :] == own[at][:, None], NONE, scores)
            best.add(at, scores, keys)
            continue
        left, right = tree.children[node]
        first = bound(left, at) >= bound(right, at)
        # The last pushed is searched first: each query's better child, then the other one with the new kth score.
        stack += [(right, at[first]), (left, at[~first]), (left, at[first]), (right, at[~first])]


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components as floor(scale * x); rows that are null or hold a null, NaN or infinity are left out."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.filter("vec_id is not null and embedding is not null").filter(fine).select("vec_id", whole.alias("v"))


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.array(rows.tolist(), np.float64).reshape(len(rows), -1)


def _task(k: int, both: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    found = []
    both = both.drop_duplicates("vec_id") if both["vec_id"].duplicated().any() else both
    for size, block in asked.groupby(asked["v"].map(len)):
        rows = both[both["v"].map(len) == size]
        if not len(rows):
            continue
        ids, matrix = rows["vec_id"].to_numpy(np.int64), _matrix(rows["v"])
        queries, own = _matrix(block["v"]), block["vec_id"].to_numpy(np.int64)
        largest = np.abs(matrix).max(initial=0) * np.abs(queries).max(initial=0) * size
        best = Best(np.array([NONE if pd.isna(b) else int(b) for b in block["bound"]], np.int64), k)
        search(BallTree(matrix), ids, queries, own, best, bool(largest < 2**52))
        real = best.score > NONE
        at = np.nonzero(real)
        found.append(pd.DataFrame({"query_id": own[at[0]], "vec_id": best.id[real], "score": best.score[real]}))
    return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")


def top_k(vectors: DataFrame, step: int = QUERY_STEP, k: int = K, scale: int = SCALE) -> DataFrame:
    """Per query (vec_id divisible by ``step``): its ``k`` highest inner products with other rows: query_id, rank, vec_id, score.

    Ties go to the smaller vec_id; fewer rows are returned if there are fewer candidates.  Vectors that are null or hold
    null or non-finite components take no part, nor do rows without vec_id; vectors meet only vectors of their length;
    repeated rows of a vec_id count once; a product beyond a long is cut to the longest; other columns are ignored; an empty table gives no rows.

    Work is a grid of blocks: each shard meets each block of queries in a task of bounded size."""
    vectors = vectors.select("vec_id", "embedding")
    total = vectors.count()
    asked = quantised(vectors.filter(F.col("vec_id") % step == 0), scale)
    shards = max(1, min(shuffle_width(vectors), total // 2_000 + 1), -(-total // SHARD_ROWS))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    deal = lambda parts, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(parts)).cast("long")
    dealt = materialize(quantised(vectors, scale).withColumn("shard", deal(shards, 1)))
    asked = materialize(asked.dropDuplicates(["vec_id"]).withColumn("block", deal(blocks, 2)))
    kind = "query_id long, vec_id long, score long"
    home = F.pmod(F.col("block"), F.lit(shards))

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        return _task(k, rows, queries) if len(rows) and len(queries) else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    def searched(queries: DataFrame, pairs: DataFrame) -> DataFrame:
        rows = dealt.join(F.broadcast(pairs), "shard") if shards * blocks <= 100_000 else dealt.join(pairs, "shard")
        return queries.groupBy("shard", "block").cogroup(rows.groupBy("shard", "block")).applyInPandas(lambda q, r: run(r, q), kind)

    grid = vectors.sparkSession.range(shards * blocks).select((F.col("id") % shards).alias("shard"), F.floor(F.col("id") / shards).alias("block"))
    first = asked.withColumn("shard", home.cast("long")).withColumn("bound", F.lit(None).cast("long"))
    start = materialize(searched(first, grid.filter(F.col("shard") == home)))
    bounds = start.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), F.col("least").alias("bound"))
    rest = grid.filter(F.col("shard") != home)
    more = asked.join(bounds, "vec_id", "left").join(rest, "block")
    found = start.unionByName(searched(more, rest))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
