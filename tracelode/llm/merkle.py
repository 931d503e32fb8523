"""Merkle manifest of a table: a postorder append log of node digests for each tree, and proofs read from it.

Rows of one language are the leaves of a tree, in order of their id; every eight consecutive nodes have one parent.  The
roots of these trees are the leaves of one more tree.  The nodes of a tree are numbered in the order in which appending
leaf after leaf completes them: a parent directly after its last child.  The number of leaf j is j plus the sizes of all
inner nodes completed before it, j // 8 + j // 64 + ..., so the place of every node follows from its level, its index and
the number of leaves, and nothing has to be searched.

A builder takes an aligned block of ``8 ** LEVELS`` consecutive leaves, which is one contiguous piece of the log, and
hands its root to the builders of the next round.  A proof reads the siblings of a node at their places in the block and
goes on with the path that the next round found for the block's root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.llm.frames import over_batches
from tracelode.session import materialize

FANOUT = 8
LEVELS = 3  # of one builder; its block has 512 leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_place(j: int, fanout: int = FANOUT) -> int:
    """Postorder number of leaf j: the leaves and the inner nodes completed before it."""
    place = j
    while j:
        j //= fanout
        place += j
    return place


def node_place(level: int, index: int, leaves: int, fanout: int = FANOUT) -> int:
    """Postorder number of a node: it is completed ``level`` nodes after the last leaf below it."""
    return leaf_place(min((index + 1) * fanout**level, leaves) - 1, fanout) + level


def levels_of(leaves: int, multiple: bool, fanout: int = FANOUT, levels: int = LEVELS) -> int:
    """Levels that a builder adds above a block: all of them if the tree has more blocks, else up to the tree's root."""
    if multiple:
        return levels
    height = 0
    while leaves > 1:
        leaves, height = -(-leaves // fanout), height + 1
    return height


def digest(parts: list[bytes]) -> bytes:
    """Digest of digests as hexadecimal text."""
    return hashlib.sha256(b"".join(x.hex().encode() for x in parts)).digest()


def block_log(leaves: list[bytes], multiple: bool, fanout: int = FANOUT, levels: int = LEVELS) -> list[bytes]:
    """Digests of a block's nodes in the order in which they are completed; the block's root comes last."""
    height = levels_of(len(leaves), multiple, fanout, levels)
    log: list[bytes] = [b""] * (node_place(height, 0, len(leaves), fanout) + 1)
    nodes = leaves
    for level in range(height + 1):
        for k, node in enumerate(nodes):
            log[node_place(level, k, len(leaves), fanout)] = node
        if level < height:
            nodes = [digest(nodes[k : k + fanout]) for k in range(0, len(nodes), fanout)]
    return log


def block_siblings(log: list[bytes], leaves: int, index: int, multiple: bool, fanout: int = FANOUT, levels: int = LEVELS) -> list[tuple[int, list[bytes]]]:
    """(place among the brothers, the others' digests) of a leaf and each of its ancestors below the block's root."""
    path, width = [], leaves
    for level in range(levels_of(leaves, multiple, fanout, levels)):
        first = index - index % fanout
        path.append((index - first, [log[node_place(level, k, leaves, fanout)] for k in range(first, min(first + fanout, width)) if k != index]))
        index, width = index // fanout, -(-width // fanout)
    return path


def climb(leaf: bytes, path: list[tuple[int, list[bytes]]]) -> bytes:
    """The root that a leaf and the siblings on its way give."""
    for place, others in path:
        leaf = digest([*others[:place], leaf, *others[place:]])
    return leaf


def pack_path(path: list[tuple[int, list[bytes]]]) -> bytes:
    return b"".join(bytes([place, len(others)]) + b"".join(others) for place, others in path)


def unpack_path(packed: bytes) -> list[tuple[int, list[bytes]]]:
    path, at = [], 0
    while at < len(packed):
        place, count = packed[at], packed[at + 1]
        path.append((place, [packed[k : k + 32] for k in range(at + 2, at + 2 + 32 * count, 32)]))
        at += 2 + 32 * count
    return path


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _leaf(text: Column) -> Column:
    others = [_field(F.col(name)) for name in FIELDS[:-1]]
    return F.unhex(F.sha2(F.concat(*others, _field(text)).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc, leaf, folded, salt): the leaf of every row, and the leaf of its text in lower case where three divides the
    checksum of its id.  ``tree`` sorts like the language, null first."""
    folded = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return docs.select(*FIELDS).select(
        F.coalesce(F.concat(F.lit(":"), "lang"), F.lit("-")).alias("tree"),
        F.col("doc_id").alias("doc"),
        _leaf(F.col("text")).alias("leaf"),
        F.when(folded, _leaf(F.translate("text", UPPER, LOWER))).alias("folded"),
        F.monotonically_increasing_id().alias("salt"),
    )


def _ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``idx``, the rank of a row in its tree, and ``n``, the tree's rows.

    Rows are range-partitioned over all trees, so that a tree of any share of the rows is sorted by many tasks; only the
    number of rows of each (tree, partition) is added up."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = nodes.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id())
    placed = materialize(placed).withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy("tree", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.sum("rows").over(tree.orderBy("part")) - F.col("rows")
    starts = counts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("n"))
    return placed.join(starts, ["tree", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


@dataclass
class Forest:
    """Log pieces of the rounds: (tree, n, block, log, docs, folded); ``docs`` and ``folded`` belong to the leaves of round 0."""

    rounds: list[DataFrame]
    levels: int

    @property
    def size(self) -> int:
        return FANOUT**self.levels

    def roots(self) -> DataFrame:
        """(tree, digest) of every tree."""
        ends = [r.filter(F.col("n") <= self.size).select("tree", F.expr("substring(log, length(log) - 31, 32)").alias("digest")) for r in self.rounds]
        out = ends[0]
        for more in ends[1:]:
            out = out.unionByName(more)
        return out


def _built(nodes: DataFrame, levels: int) -> DataFrame:
    """Log pieces of all aligned blocks of (tree, idx, n, leaf, doc, folded)."""
    size = FANOUT**levels

    def build(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("idx")
        n = int(block["n"].iloc[0])
        folded = [None if x is None else bytes(x) for x in block["folded"]]
        return pd.DataFrame({
            "tree": [block["tree"].iloc[0]], "n": [n], "block": [int(block["block"].iloc[0])],
            "log": [b"".join(block_log([bytes(x) for x in block["leaf"]], n > size, levels=levels))],
            "docs": [[None if x is None else bytes(x).decode() for x in block["doc"]]], "folded": [folded],
        })

    keyed = nodes.select("tree", "idx", "n", "leaf", F.col("doc").cast("string").cast("binary").alias("doc"), "folded", (F.floor(F.col("idx") / size)).alias("block"))
    return keyed.groupBy("tree", "block").applyInPandas(build, "tree string, n long, block long, log binary, docs array<string>, folded array<binary>")


def _forest(nodes: DataFrame, levels: int) -> Forest:
    """All rounds over ranked nodes; each has 1 / 8 ** levels of the rows of the one before."""
    size = FANOUT**levels
    largest = nodes.agg(F.max("n")).first()[0] or 0
    rounds = [materialize(_built(nodes, levels))]
    while largest > size:
        largest = -(-largest // size)
        tops = rounds[-1].filter(F.col("n") > size).select(
            "tree", F.col("block").alias("idx"), F.ceil(F.col("n") / size).alias("n"), F.expr("substring(log, length(log) - 31, 32)").alias("leaf"),
            F.lit(None).cast("string").alias("doc"), F.lit(None).cast("binary").alias("folded"),
        )
        rounds.append(materialize(_built(tops, levels)))
    return Forest(rounds, levels)


def _steps(row_n: int, block: int, size: int) -> tuple[int, bool]:
    """Leaves of a block, and whether its tree has more blocks."""
    return min(size, row_n - block * size), row_n > size


def _paths(forest: Forest, above: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log pieces of round 0, path of each piece's root up to the last root): rounds are read from the top down.  ``above`` has
    the path of every tree's root."""
    size, levels = forest.size, forest.levels

    def extract(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {"tree": [], "block": [], "path": []}
            for tree, n, block, log, path in zip(batch["tree"], batch["n"], batch["block"], batch["log"], batch["path"], strict=True):
                count, multiple = _steps(n, block, size)
                nodes = [log[k : k + 32] for k in range(0, len(log), 32)]
                for k in range(count):
                    out["tree"].append(tree)
                    out["block"].append(block * size + k)
                    out["path"].append(pack_path(block_siblings(nodes, count, k, multiple, levels=levels)) + path)
            yield out

    found = None
    for pieces in reversed(forest.rounds):
        ends = pieces.filter(F.col("n") <= size).join(above, "tree").select("tree", "block", "path")
        paths = ends if found is None else ends.unionByName(found)
        if pieces is forest.rounds[0]:
            return pieces, paths
        joined = pieces.select("tree", "n", "block", "log").join(paths, ["tree", "block"])
        found = materialize(over_batches(joined, extract, "tree string, block long, path binary"))
    raise AssertionError("a forest has a round")


def _super(forest: Forest) -> tuple[Forest, DataFrame]:
    """The tree over the trees' roots, and the path of every root in it."""
    size, levels = forest.size, forest.levels
    tops = forest.roots().select(F.lit("").alias("tree"), F.col("tree").alias("doc"), F.col("digest").alias("leaf"), F.lit(None).cast("binary").alias("folded"))
    top = _forest(_ranked(tops, ["doc"]), levels)
    none = top.rounds[0].select("tree").distinct().withColumn("path", F.lit(b""))
    pieces, paths = _paths(top, none)

    def extract(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {"tree": [], "path": []}
            for n, block, log, docs, path in zip(batch["n"], batch["block"], batch["log"], batch["docs"], batch["path"], strict=True):
                count, multiple = _steps(n, block, size)
                nodes = [log[k : k + 32] for k in range(0, len(log), 32)]
                for k, tree in enumerate(docs):
                    out["tree"].append(tree)
                    out["path"].append(pack_path(block_siblings(nodes, count, k, multiple, levels=levels)) + path)
            yield out

    return top, materialize(over_batches(pieces.drop("folded").join(paths, ["tree", "block"]), extract, "tree string, path binary"))


def manifest(docs: DataFrame, levels: int = LEVELS) -> Forest:
    """The log pieces of every language's tree; see :func:`proofs` for how rows are read."""
    return _forest(_ranked(materialize(leaves(docs)), ["doc", "leaf", "salt"]), levels)


def log(forest: Forest) -> DataFrame:
    """The append log itself: (tree, place, digest), one row a node, places from 0 without gaps in each tree.

    Blocks of round 0 are contiguous; nodes of later rounds are placed one by one."""
    size, levels = forest.size, forest.levels

    def rows(first_level: int):
        def run(batches: Iterator[dict]) -> Iterator[dict]:
            for batch in batches:
                out: dict[str, list] = {"tree": [], "place": [], "digest": []}
                for tree, n, leaves_below, block, piece in zip(batch["tree"], batch["n"], batch["total"], batch["block"], batch["log"], strict=True):
                    count, multiple = _steps(n, block, size)
                    width = count
                    for level in range(levels_of(count, multiple, levels=levels) + 1):
                        for k in range(width):
                            if first_level and not level:
                                continue  # the leaves of a later round are roots of the round before
                            at = 32 * node_place(level, k, count)
                            index = block * FANOUT ** (levels - level) + k if multiple else k
                            out["tree"].append(tree)
                            out["place"].append(node_place(first_level + level, index, leaves_below))
                            out["digest"].append(piece[at : at + 32].hex())
                        width = -(-width // FANOUT)
                yield out

        return run

    total = forest.rounds[0].select("tree", F.col("n").alias("total")).distinct()
    parts = [over_batches(r.select("tree", "n", "block", "log").join(total, "tree"), rows(levels * k), "tree string, place long, digest string") for k, r in enumerate(forest.rounds)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def proofs(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    The leaf of a row holds doc_id, source, lang, n_chars and text, nulls included; an empty text differs from a null one; a
    text of any length is one leaf.  Rows of one doc_id stand in order of their leaves, a null doc_id comes first and is
    never tampered with, a null language is a tree of its own, an empty table has no rows, and other columns are ignored."""
    forest = manifest(docs, levels)
    size = forest.size
    _, above = _super(forest)
    pieces, paths = _paths(forest, above)

    def extract(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for n, block, piece, names, folded, packed in zip(*(batch[c] for c in ("n", "block", "log", "docs", "folded", "path")), strict=True):
                count, multiple = _steps(n, block, size)
                nodes = [piece[k : k + 32] for k in range(0, len(piece), 32)]
                upper = unpack_path(packed)
                # Levels of the tree come first in the path, those of the tree over the trees last.
                height = levels_of(n, False)
                subroot = climb(nodes[-1], upper[: height - levels_of(count, multiple, levels=levels)]).hex()
                tail = "".join(x.hex() for _, others in upper for x in others)
                out: dict[str, list] = {c: [] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")}
                root = climb(nodes[-1], upper)
                for k, name in enumerate(names):
                    own = block_siblings(nodes, count, k, multiple, levels=levels)
                    leaf = nodes[node_place(0, k, count)]
                    again = climb(leaf if folded[k] is None else folded[k], [*own, *upper])
                    out["doc_id"].append(None if name is None else int(name))
                    out["leaf"].append(leaf.hex())
                    out["subroot"].append(subroot)
                    out["root"].append(root.hex())
                    out["proof_sha256"].append(hashlib.sha256(("".join(x.hex() for _, others in own for x in others) + tail).encode()).hexdigest())
                    out["folded_root"].append(again.hex())
                    out["verified"].append(again == root)
                yield out

    return over_batches(pieces.join(paths, ["tree", "block"]), extract, PROOFS)


def sql(levels: int = 12) -> str:
    """DuckDB SQL of :func:`proofs` over ``documents`` whose trees have at most ``8 ** levels`` leaves."""
    def field(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"

    head = " || ".join(field(c) for c in FIELDS[:-1])
    crc = (
        "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda acc, b: "
        "list_reduce(list_prepend(xor(acc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END)), 4294967295::BIGINT)"
    )
    steps = [f"""
WITH l0 AS MATERIALIZED (
  SELECT coalesce(':' || lang, '-') AS tree, doc_id, sha256({head} || {field('text')}) AS h,
         CASE WHEN {crc} % 3 = 0 THEN sha256({head} || {field(f"translate(text, '{UPPER}', '{LOWER}')")}) END AS folded
  FROM documents),
n0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM l0),
w0 AS MATERIALIZED (SELECT tree, doc_id, i, h AS leaf, coalesce(folded, h) AS f, i AS spot, '' AS proof FROM n0)"""]

    def climbed(k: int, part: str, source: str) -> str:
        # the nodes of one level, their parents, and each leaf's way through them; a tree of one node stays as it is
        return f"""
p{k} AS MATERIALIZED (SELECT tree, i // 8 AS i, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h, (n + 7) // 8 AS n FROM {source} GROUP BY tree, i // 8, n),
s{k} AS MATERIALIZED (SELECT a.tree, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lo, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS hi, any_value(a.n) AS n
  FROM {source} a LEFT JOIN {source} b ON a.tree = b.tree AND a.i // 8 = b.i // 8 AND a.i <> b.i GROUP BY a.tree, a.i),
w{k} AS MATERIALIZED (SELECT {part} tree, doc_id, w.i, leaf, CASE WHEN s.n > 1 THEN sha256(lo || f || hi) ELSE f END AS f, spot // 8 AS spot, proof || lo || hi AS proof
  FROM w{k - 1} w JOIN s{k} s ON w.tree = s.tree AND w.spot = s.i)"""

    source = "n0"
    for k in range(1, levels + 1):
        steps.append(climbed(k, "w.tree AS", source))
        source = f"p{k}"
    top = f"""
sub AS MATERIALIZED (SELECT tree AS name, h FROM p{levels}),
m0 AS MATERIALIZED (SELECT 0 AS tree, name, h, row_number() OVER (ORDER BY name) - 1 AS i, count(*) OVER () AS n FROM sub)"""
    steps.append(top)
    steps.append(f"""
w{levels + 1} AS MATERIALIZED (SELECT 0 AS tree, doc_id, w.i, leaf, f, m.i AS spot, proof, m.h AS subroot FROM w{levels} w JOIN m0 m ON w.tree = m.name)""")
    source, last = "m0", levels + 1
    for k in range(last + 1, last + 4):
        steps.append(climbed(k, "subroot, w.tree AS", source))
        source = f"p{k}"
    end = last + 3
    return ",".join(steps) + f"""
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.h AS verified FROM w{end} w, (SELECT h FROM p{end}) r"""
