"""Language model scores of whole documents by a probabilistic suffix tree.

A state of the tree is a context, the one to ``DEPTH`` words before a token.  Contexts are grown word by word: those that
occur ``SUPPORT`` times and hold the share ``LEAST_SHARE`` of all training tokens are counted, and one is kept as a state
if its next-symbol counts diverge from the distribution of its longest kept suffix by more than they would cost.  A
state's distribution takes one from each count and spends what that frees on the distribution of the suffix state, down
to the smoothed unigrams; symbols that a state saw once need no entry of their own.  A token is scored by the state of the
longest suffix of its history.

The least share bounds the number of contexts of a length by 1 / ``LEAST_SHARE``, whatever the corpus, so contexts are
broadcast.  What grows with the corpus, the next-symbol counts, stays in Spark: documents are coded once into blocks of
word numbers, each block sends its distinct (next word, context) pairs to the bucket of the next word, where the counts
of all contexts before this word meet, and buckets answer the pairs of each block in the order in which they came.
Words that hold more than ``HOT_SHARE`` of the tokens are few and are spread by their last context word as well.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.llm.frames import shuffle_width, trim
from tracelode.llm.shingles import BATCH_BYTES, mixed, word_hashes
from tracelode.session import materialize

DEPTH = 3
SUPPORT = 16
LEAST_SHARE = 2.0**-17
HOT_SHARE = 2.0**-12
BLOCK_TOKENS = 2_000_000
BUCKET_TOKENS = 4_000_000
FOLDS, HELD_OUT = 10, 0
END = np.uint64(0x6A09E667F3BCC909)  # the number of the end token
STEP = np.uint64(0xD1342543DE82EF95)
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


# ---- packed rows -----------------------------------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned arrays as one compressed binary; bytes of the same weight stand together, ascending arrays as differences."""
    out = []
    for values in arrays:
        values = values.astype(np.uint64)
        rising = bool(len(values) > 1 and (values[1:] >= values[:-1]).all())
        if rising:
            values = np.r_[values[:1], values[1:] - values[:-1]]
        width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
        planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
        out.append(struct.pack("<QBB", len(values), width, rising) + np.ascontiguousarray(planes).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(packed: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(packed)
    found, at = [], 0
    while at < len(data):
        n, width, rising = struct.unpack_from("<QBB", data, at)
        at += 10
        values = np.zeros((n, 8), np.uint8)
        values[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
        at += n * width
        values = values.reshape(-1).view(np.uint64)
        found.append(np.cumsum(values, dtype=np.uint64) if rising else values)
    return found


# ---- blocks of documents ---------------------------------------------------------------------------------------------


class Block:
    """Documents as numbers of words: ``words`` are the hashes, most frequent first, ``at`` the number of each token."""

    def __init__(self, packed: bytes, docs: list):
        self.words, at, sizes = unpack(packed)
        self.at, self.sizes, self.docs = at.astype(np.int64), sizes.astype(np.int64), docs
        self.held = np.array([zlib.crc32(("null" if d is None else str(d)).encode()) % FOLDS == HELD_OUT for d in docs], bool)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.offset = np.arange(len(self.at)) - np.repeat(self.starts, self.sizes)  # place of a token in its document

    def training(self) -> np.ndarray:
        return np.repeat(~self.held, self.sizes)


def blocks(docs: DataFrame) -> DataFrame:
    """(block, docs, packed, tokens): every row of doc_id and text, cut into blocks of some ``BLOCK_TOKENS`` tokens."""

    def flush(tokens: list[np.ndarray], keys: list, number: int) -> pa.RecordBatch:
        flat = np.concatenate(tokens)
        words, at, counts = np.unique(flat, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        packed = pack(words[order], place[at], np.array([len(t) for t in tokens]))
        return pa.RecordBatch.from_pydict({"block": [number], "docs": pa.array([keys], pa.list_(pa.int64())), "packed": pa.array([packed], pa.binary()), "tokens": [len(flat)]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        tokens, keys, size = [], [], 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for key, found in zip(ids, _tokens(batch.column(1)), strict=True):
                if size + len(found) > BLOCK_TOKENS and keys:
                    yield flush(tokens, keys, number)
                    number, tokens, keys, size = number + 1, [], [], 0
                tokens.append(found)
                keys.append(key)
                size += len(found)
        if keys:
            yield flush(tokens, keys, number)
        trim()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "block long, docs array<bigint>, packed binary, tokens long")


def _tokens(column: pa.Array) -> Iterator[np.ndarray]:
    """Hashes of the lower-cased words of each text, then the end."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, body = column.buffers()
    edges = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None and len(body) else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + BATCH_BYTES, side="right")) - 1)
        flat, counts = word_hashes(data[edges[first] : edges[last]], edges[first : last + 1] - edges[first])
        ends = np.cumsum(counts)
        for a, b in zip(ends - counts, ends, strict=True):
            yield np.r_[flat[a:b], END]
        first = last


# ---- contexts --------------------------------------------------------------------------------------------------------


@dataclass
class Level:
    """Contexts of one length, by key: occurrences, number of the suffix without the first word, last word."""

    keys: np.ndarray
    counts: np.ndarray
    suffix: np.ndarray
    last: np.ndarray


@dataclass
class Tree:
    """What is broadcast.  State 0 is the empty context; context j of length k is state ``first[k] + j``."""

    tokens: int
    vocabulary: int
    buckets: int
    hot: np.ndarray  # words, ascending
    hot_counts: np.ndarray
    levels: list[Level] = field(default_factory=list)
    first: list[int] = field(default_factory=lambda: [0, 1])
    counts: np.ndarray = field(default_factory=lambda: np.zeros(1))
    last: np.ndarray = field(default_factory=lambda: np.zeros(1, np.uint64))
    free: np.ndarray = field(default_factory=lambda: np.zeros(1))  # counts that a state gives to its suffix; 0: not kept
    resolved: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # the longest kept suffix, itself included
    parent: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # of a state, the longest kept proper suffix

    def add(self, level: Level) -> None:
        depth = len(self.levels) + 1
        self.levels.append(level)
        self.first.append(self.first[-1] + len(level.keys))
        self.counts = np.r_[self.counts, level.counts]
        self.last = np.r_[self.last, level.last]
        self.free = np.r_[self.free, np.zeros(len(level.keys))]
        shorter = self.resolved[self.first[depth - 1] + level.suffix] if depth > 1 else np.zeros(len(level.keys), np.int64)
        self.parent = np.r_[self.parent, shorter]
        self.resolved = np.r_[self.resolved, shorter]

    def keep(self, states: np.ndarray, free: np.ndarray) -> None:
        self.free[states] = free
        self.resolved[states] = states

    def contexts(self, block: Block) -> Iterator[np.ndarray]:
        """For each length, the state of the context before every token of the block, -1 where it is none."""
        hashes = block.words[block.at]
        before = np.r_[np.zeros(1, np.uint64), hashes[:-1]]  # the last word of each context
        keys, found = None, None
        for k, level in enumerate(self.levels, 1):
            inside = block.offset >= k
            if k == 1:
                own = _find(level.keys, block.words)
                states = np.where(inside, np.r_[-1, own[block.at[:-1]]], -1)
                keys = before
            else:
                keys = np.r_[np.zeros(1, np.uint64), keys[:-1]] * STEP + before
                at = np.flatnonzero(inside & (found >= 0))
                states = np.full(len(hashes), -1)
                states[at] = _find(level.keys, keys[at])
            found = np.where(states >= 0, states + self.first[k], -1)
            yield found

    def bucket(self, words: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Bucket of each (next word, last word of the context)."""
        spread = _find(self.hot, words) >= 0
        return (mixed(np.where(spread, words ^ mixed(last + np.uint64(1)), words)) % np.uint64(self.buckets)).astype(np.int64)

    def root(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.1) / (self.tokens + 0.1 * (self.vocabulary + 1))


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each value in ascending keys, -1 where it is missing."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


# ---- pairs of next words and states ----------------------------------------------------------------------------------


def _grouped(tree: Tree, words: np.ndarray, at: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of distinct (word, state) pairs by bucket, word hash and state, and the buckets in this order."""
    bucket = tree.bucket(words[at], tree.last[states])
    order = np.lexsort((states, words[at], bucket))
    return order, bucket[order]


def _sent(tree: Tree, words: np.ndarray, at: np.ndarray, states: np.ndarray, *more: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed pairs): the distinct words, the number of pairs of each, the states, then ``more`` by pair."""
    order, bucket = _grouped(tree, words, at, states)
    if not len(order):
        return
    hashes, states, more = words[at[order]], states[order], [m[order] for m in more]
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        new = np.flatnonzero(np.r_[True, hashes[a + 1 : b] != hashes[a : b - 1]])
        yield int(bucket[a]), pack(hashes[a:b][new], np.diff(np.r_[new, b - a]), states[a:b], *(m[a:b] for m in more))


def _per_block(rows: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(number, block)`` gives rows of the schema, as tuples."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, docs, packed in zip(frame["block"], frame["docs"], frame["packed"], strict=True):
                out = list(fn(int(number), Block(packed, _ids(docs))))
                yield pd.DataFrame(out, columns=names)
        trim()

    return rows.select("block", F.expr("transform(docs, x -> cast(x as string))").alias("docs"), "packed").mapInPandas(run, schema)


def _ids(docs) -> list:
    return [None if d is None else int(d) for d in docs]


class Counts:
    """Counts of a bucket: of words alone, and of (word, state) pairs that occur twice at least."""

    def __init__(self, tree: Tree, rows: list[tuple[int, bytes]]):
        self.tree = tree
        single = [unpack(packed) for kind, packed in rows if kind == 0]
        self.words = np.concatenate([s[0] for s in single]) if single else np.zeros(0, np.uint64)
        self.word_counts = np.concatenate([s[1] for s in single]).astype(np.int64) if single else np.zeros(0, np.int64)
        codes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for kind, packed in rows:
            if kind:
                hashes, sizes, states, n = unpack(packed)
                codes.append(self.code(np.repeat(hashes, sizes.astype(np.int64)), states))
                counts.append(n.astype(np.int64))
        codes, counts = np.concatenate(codes), np.concatenate(counts)
        order = np.argsort(codes)
        self.codes, self.counts = codes[order], counts[order]

    @staticmethod
    def code(words: np.ndarray, states: np.ndarray) -> np.ndarray:
        """One number for a word and a state."""
        return mixed(words + states.astype(np.uint64) * STEP)

    def single(self, words: np.ndarray) -> np.ndarray:
        """Training count of each word; the hot words' are broadcast."""
        at = _find(self.words, words)
        found = np.where(at >= 0, self.word_counts[at] if len(self.words) else 0, 0)
        at = _find(self.tree.hot, words)
        return np.where(at >= 0, self.tree.hot_counts[at] if len(self.tree.hot) else 0, found)

    def probability(self, words: np.ndarray, states: np.ndarray) -> np.ndarray:
        """Smoothed probability of each word after a kept state or the empty one."""
        tree = self.tree
        chain = []
        while (states > 0).any():
            chain.append(states)
            states = tree.parent[states]
        p = tree.root(self.single(words))
        for states in reversed(chain):
            at = _find(self.codes, self.code(words, states))
            n = np.where(at >= 0, self.counts[at] if len(self.codes) else 0, 0)
            inner = states > 0
            total = np.where(inner, tree.counts[states], 1)
            p = np.where(inner, (np.maximum(n - 1, 0) + tree.free[states] * p) / total, p)
        return p


# ---- fitting ---------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    tree: Tree
    counts: DataFrame  # (bucket, kind, packed); kind 0: words alone, k: pairs with contexts of k words


def _unigrams(rows: DataFrame, buckets: int) -> DataFrame:
    plain = Tree(0, 0, buckets, np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def send(_: int, block: Block) -> Iterator[tuple[int, bytes]]:
        counts = np.bincount(block.at[block.training()], minlength=len(block.words))
        at = np.flatnonzero(counts)
        yield from _sent(plain, block.words, at, np.zeros(len(at), np.int64), counts[at])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(x) for x in frame["packed"]]
        words, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([p[3] for p in parts]).astype(np.float64)).astype(np.int64)
        trim()
        return pd.DataFrame({"bucket": frame["bucket"].iloc[:1], "kind": 0, "packed": [pack(words, counts)], "tokens": int(counts.sum()), "distinct": len(words)})

    return _per_block(rows, send, "bucket long, packed binary").groupBy("bucket").applyInPandas(add, "bucket long, kind int, packed binary, tokens long, distinct long")


def _frequent(unigrams: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Words that occur ``least`` times, ascending; at most training tokens / ``least``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for packed in frame["packed"]:
                words, counts = unpack(packed)
                keep = counts >= least
                yield pd.DataFrame({"word": words[keep].view(np.int64), "n": counts[keep].astype(np.int64)})

    found = unigrams.select("packed").mapInPandas(run, "word long, n long").toPandas()
    words, counts = found["word"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(words)
    return words[order], counts[order]


def _counted(rows: DataFrame, model: Model, depth: int, least: int) -> DataFrame:
    """(bucket, kind, packed, stats, longer) of the pairs with contexts of ``depth`` words.

    ``stats`` holds, by state, what the divergence needs; ``longer`` the contexts that one more word makes frequent."""
    shared = rows.sparkSession.sparkContext.broadcast(model.tree)

    def send(_: int, block: Block) -> Iterator[tuple[int, bytes]]:
        tree = shared.value
        for states in tree.contexts(block):
            pass
        keep = np.flatnonzero(block.training() & (states >= 0))
        size = np.int64(len(tree.counts))
        codes, counts = np.unique(block.at[keep] * size + states[keep], return_counts=True)
        yield from _sent(tree, block.words, codes // size, codes % size, counts)

    def add(sent: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(sent):
            return pd.DataFrame({"bucket": [], "kind": [], "packed": [], "stats": [], "longer": []})
        tree = shared.value
        parts = [unpack(x) for x in sent["packed"]]
        hashes = np.concatenate([np.repeat(p[0], p[1].astype(np.int64)) for p in parts])
        states = np.concatenate([p[2] for p in parts]).astype(np.int64)
        n = np.concatenate([p[3] for p in parts]).astype(np.float64)
        words, at = np.unique(hashes, return_inverse=True)
        size = np.int64(len(tree.counts))
        codes, kind = np.unique(at * size + states, return_inverse=True)
        n = np.bincount(kind, n).astype(np.int64)
        keep = n > 1
        codes, n = codes[keep], n[keep]
        hashes, states = words[codes // size], codes % size
        p = Counts(tree, list(zip(known["kind"], known["packed"], strict=True))).probability(hashes, tree.parent[states])
        own, at = np.unique(states, return_inverse=True)
        part = n * np.log(n / (tree.counts[states] * p))
        sums = [np.bincount(at, x, minlength=len(own)) for x in (part, n, p, np.ones(len(n)))]
        stats = np.column_stack([own, *sums]).astype(np.float64).tobytes()
        long = np.flatnonzero((n >= least) & (hashes != END)) if depth < DEPTH else np.zeros(0, np.int64)
        level = tree.levels[-1]
        own_at = states[long] - tree.first[depth]
        key = level.keys[own_at] * STEP + hashes[long]
        suffix = tree.levels[-2].keys[level.suffix[own_at]] * STEP + hashes[long] if depth > 1 else hashes[long]
        longer = np.column_stack([key, suffix, hashes[long], n[long].astype(np.uint64)]).astype(np.uint64).tobytes()
        new = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, np.int64)
        packed = pack(hashes[new], np.diff(np.r_[new, len(hashes)]), states, n)
        trim()
        return pd.DataFrame({"bucket": sent["bucket"].iloc[:1], "kind": depth, "packed": [packed], "stats": [stats], "longer": [longer]})

    pairs = _per_block(rows, send, "bucket long, packed binary")
    return pairs.groupBy("bucket").cogroup(model.counts.groupBy("bucket")).applyInPandas(add, "bucket long, kind int, packed binary, stats binary, longer binary")


def _kept(counted: DataFrame, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """States whose counts diverge from their suffix's distribution, and the counts that each gives to its suffix.

    The divergence is that of the counts over the symbols seen twice and all others together; a symbol costs the
    logarithm of the state's occurrences."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for stats in frame["stats"]:
                yield pd.DataFrame(np.frombuffer(stats).reshape(-1, 5), columns=["state", "part", "n", "p", "m"])

    rows = counted.select("stats").mapInPandas(run, "state double, part double, n double, p double, m double")
    sums = rows.groupBy("state").agg(*(F.sum(c).alias(c) for c in ("part", "n", "p", "m"))).toPandas()
    states = sums["state"].to_numpy(np.int64)
    part, n, p, m = (sums[c].to_numpy(np.float64) for c in ("part", "n", "p", "m"))
    total = tree.counts[states]
    rest = total - n
    divergence = part + np.where(rest > 0, rest * np.log(np.maximum(rest, 1) / (total * np.maximum(1 - p, 1e-12))), 0)
    keep = divergence >= (m + 1) * np.log(total)
    return states[keep], (total - (n - m))[keep]


def _longer(counted: DataFrame, tree: Tree) -> Level:
    """The contexts of one more word."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for longer in frame["longer"]:
                yield pd.DataFrame(np.frombuffer(longer, np.int64).reshape(-1, 4), columns=["k", "s", "w", "n"])

    found = counted.select("longer").mapInPandas(run, "k long, s long, w long, n long").toPandas().drop_duplicates("k")
    keys = found["k"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    suffix = found["s"].to_numpy(np.int64).view(np.uint64)[order]
    return Level(keys[order], found["n"].to_numpy(np.int64)[order], _find(tree.levels[-1].keys, suffix), found["w"].to_numpy(np.int64).view(np.uint64)[order])


def fit(rows: DataFrame) -> Model:
    """The suffix tree of the training documents of :func:`blocks`."""
    total = rows.agg(F.sum("tokens")).first()[0] or 0
    buckets = max(shuffle_width(rows), -(-total // BUCKET_TOKENS))
    unigrams = materialize(_unigrams(rows, buckets))
    tokens, vocabulary = (x or 0 for x in unigrams.agg(F.sum("tokens"), F.sum("distinct")).first())
    least = max(SUPPORT, int(np.ceil(tokens * LEAST_SHARE)))
    words, counts = _frequent(unigrams, least)
    hot = counts >= max(SUPPORT, tokens * HOT_SHARE)
    tree = Tree(tokens, vocabulary, buckets, words[hot], counts[hot])
    model = Model(tree, unigrams.select("bucket", "kind", "packed"))
    inner = words != END
    level = Level(words[inner], counts[inner], np.full(int(inner.sum()), -1), words[inner])
    for depth in range(1, DEPTH + 1):
        if not len(level.keys):
            break
        tree.add(level)
        counted = materialize(_counted(rows, model, depth, least))
        tree.keep(*_kept(counted, tree))
        model.counts = model.counts.unionByName(counted.select("bucket", "kind", "packed"))
        if depth < DEPTH:
            level = _longer(counted, tree)
    return model


# ---- scoring ---------------------------------------------------------------------------------------------------------


def _wanted(tree: Tree, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (word, state) pairs of a block, and the pair of each token."""
    states = np.zeros(len(block.at), np.int64)
    for found in tree.contexts(block):
        states = np.where(found >= 0, found, states)
    states = tree.resolved[states]
    size = np.int64(len(tree.counts))
    codes, pair = np.unique(block.at * size + states, return_inverse=True)
    return codes // size, codes % size, pair


def score(rows: DataFrame, model: Model) -> DataFrame:
    """Scores of all documents of :func:`blocks`.

    A null or empty text is its end token alone; a null doc_id counts as the text ``null`` for its fold; repeated rows are
    scored each; texts of any length are scored whole; an empty table has no rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model.tree)

    def send(number: int, block: Block) -> Iterator[tuple[int, int, bytes]]:
        tree = shared.value
        at, states, _ = _wanted(tree, block)
        for bucket, packed in _sent(tree, block.words, at, states):
            yield bucket, number, packed

    def answer(sent: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        counts = Counts(shared.value, list(zip(known["kind"], known["packed"], strict=True)))
        out = []
        for packed in sent["packed"]:
            hashes, sizes, states = unpack(packed)
            p = counts.probability(np.repeat(hashes, sizes.astype(np.int64)), states.astype(np.int64))
            out.append(pack(np.log10(p).astype(np.float32).view(np.uint32), counts.single(hashes)))
        trim()
        return pd.DataFrame({"bucket": sent["bucket"], "block": sent["block"], "packed": out})

    def add(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        tree = shared.value
        block = Block(own["packed"].iloc[0], _ids(own["docs"].iloc[0]))
        at, states, pair = _wanted(tree, block)
        order, bucket = _grouped(tree, block.words, at, states)
        got = {int(b): unpack(x) for b, x in zip(answers["bucket"], answers["packed"], strict=True)}
        logs, counts = np.zeros(len(order)), np.zeros(len(block.words), np.int64)
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            values, single = got[int(bucket[a])]
            logs[order[a:b]] = values.astype(np.uint32).view(np.float32)
            words = at[order[a:b]]
            counts[words[np.r_[True, words[1:] != words[:-1]]]] = single.astype(np.int64)
        base = np.log10(tree.root(counts))[block.at]
        known = (counts > 0)[block.at]
        trim()
        return pd.DataFrame({
            "doc_id": pd.array(block.docs, dtype="Int64"), "held_out": block.held, "n_tokens": block.sizes,
            "n_known": np.add.reduceat(known.astype(np.int64), block.starts), "train_tokens": tree.tokens,
            "base_score": np.add.reduceat(base, block.starts), "score": np.add.reduceat(logs[pair], block.starts),
        })

    asked = _per_block(rows, send, "bucket long, block long, packed binary")
    answers = asked.groupBy("bucket").cogroup(model.counts.groupBy("bucket")).applyInPandas(answer, "bucket long, block long, packed binary")
    own = rows.select("block", F.expr("transform(docs, x -> cast(x as string))").alias("docs"), "packed")
    return own.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(add, SCHEMA)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row, by a model of the training fold;
    see :func:`score` for nulls, repeats and empty tables.  Other columns are ignored."""
    rows = materialize(blocks(docs))
    return score(rows, fit(rows))
