"""Harmonic packing of documents into fixed-length training sequences.

Lengths fall into reciprocal-capacity classes: class k holds lengths in
(capacity / (k + 1), capacity / k], and each bin of the class takes exactly k
documents, so no bin has to look at another.  What a bin leaves free is filled from a
stream: documents longer than a sequence, and as many of the wasteful class 1 as the
free room needs, are laid end to end and cut where a bin is full.

Every worker packs blocks of its own input: no shuffle, no state between workers, and
memory bounded by one block, whatever the size of the table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tracelode.llm.bpe import CACHE_ENTRIES, VOCABULARY, encoder
from tracelode.llm.frames import over_batches

CAPACITY = 2048
END = 1  # id that closes a document
BLOCK_TOKENS = 4_000_000  # ids a worker packs at a time (16 MB)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
# Sequences a partition may number: 2^33, as in Spark's own increasing ids.
PARTITION_BITS = 33


def layout(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Pieces (document, start, length, bin, offset) of one block, in bin order.

    ``lengths`` are positive.  Offsets of a bin are gapless from 0."""
    lengths = np.asarray(lengths, np.int64)
    if not len(lengths):
        return np.zeros((0, 5), np.int64)
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    whole = int(np.searchsorted(-sizes, -capacity))  # the first ``whole`` documents are longer than a sequence
    kept = _streamed(sizes, whole, capacity)
    stream, packed = order[:kept], order[kept:]

    # Bins of each class, k documents each; the last bin of a class may hold fewer.
    groups = capacity // lengths[packed]
    firsts = np.flatnonzero(np.r_[True, np.diff(groups) != 0]) if len(packed) else np.zeros(0, np.int64)
    within = np.arange(len(packed)) - np.repeat(firsts, np.diff(np.r_[firsts, len(packed)]))
    slot = within % groups if len(packed) else within
    bins = np.cumsum(slot == 0) - 1
    count = int(bins[-1]) + 1 if len(packed) else 0
    filled = np.bincount(bins, lengths[packed], count).astype(np.int64) if count else np.zeros(0, np.int64)
    before = np.cumsum(lengths[packed]) - lengths[packed]
    opens = before[slot == 0] if count else before
    pieces = [np.c_[packed, np.zeros(len(packed), np.int64), lengths[packed], bins, before - opens[bins] if count else before]]

    # The stream fills the free room of the bins and then sequences of its own.
    total = int(lengths[stream].sum())
    if total:
        room = np.cumsum(capacity - filled)
        used = int(room[-1]) if count else 0
        own = np.arange(used + capacity, total + capacity, capacity) if total > used else np.zeros(0, np.int64)
        edges = np.r_[room, own]
        starts = np.r_[0, edges[:-1]]
        bodies = np.r_[filled, np.zeros(len(own), np.int64)]
        doc_ends = np.cumsum(lengths[stream])
        cuts = np.unique(np.r_[0, doc_ends, edges[edges < total]])
        left, right = cuts[:-1], cuts[1:]
        owner = np.searchsorted(doc_ends, left, side="right")
        target = np.searchsorted(edges, left, side="right")
        pieces.append(np.c_[stream[owner], left - (doc_ends - lengths[stream])[owner], right - left, target, bodies[target] + left - starts[target]])
    table = np.concatenate(pieces)
    return table[np.lexsort((table[:, 4], table[:, 3]))]


def _streamed(sizes: np.ndarray, whole: int, capacity: int) -> int:
    """How many of the longest documents go to the stream: those longer than a sequence, and more while free room exceeds
    the stream.  ``sizes`` descend."""
    groups = capacity // np.maximum(sizes[whole:], 1)
    shares = capacity / np.maximum(groups, 1) - sizes[whole:]  # room that a document leaves free in its bin
    room = shares.sum() - np.r_[0, np.cumsum(shares)]
    stream = sizes[:whole].sum() + np.r_[0, np.cumsum(sizes[whole:])]
    return whole + int(np.argmax(stream >= room))


def pack(
    docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end: int = END, block: int = BLOCK_TOKENS, cache: int = CACHE_ENTRIES
) -> DataFrame:
    """Pieces of the packed sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its text, then ``end``.  A null or empty text is the end id alone; a null doc_id is kept;
    repeated rows are packed each; a document of any length is cut; an empty table gives no rows; other columns are
    ignored.  Sequence ids are unique over the table and depend only on how the input is split.  ``cache``: pre-tokens a
    worker remembers; fewer take less memory and more time, the result is the same."""
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        known = encoder(vocabulary, cache)
        next_sequence = TaskContext.get().partitionId() << PARTITION_BITS
        keys: list = []
        ids: list[bytes] = []
        size = 0
        for batch in batches:
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids.append(known.ids(text) + last)
                keys.append(key)
                size += len(ids[-1]) // 4
                if size >= block:
                    out, next_sequence = _packed(keys, ids, capacity, next_sequence)
                    yield out
                    keys, ids, size = [], [], 0
        if keys:
            yield _packed(keys, ids, capacity, next_sequence)[0]

    return over_batches(docs.select("doc_id", "text"), run, SCHEMA)


def _packed(keys: list, ids: list[bytes], capacity: int, sequence: int) -> tuple[dict, int]:
    lengths = np.array([len(x) // 4 for x in ids], np.int64)
    at = layout(lengths, capacity)
    checks = [zlib.crc32(memoryview(ids[d])[4 * s : 4 * (s + n)]) for d, s, n in at[:, :3].tolist()]
    out = {
        "doc_id": [keys[d] for d in at[:, 0].tolist()], "start": at[:, 1], "length": at[:, 2], "ids_crc32": checks,
        "doc_tokens": lengths[at[:, 0]], "sequence_id": sequence + at[:, 3], "offset": at[:, 4],
    }
    return out, sequence + int(at[-1, 3]) + 1
