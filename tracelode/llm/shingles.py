"""Five-word shingles of texts as sorted 64-bit hashes, computed on the bytes of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WORDS = 5
BATCH_BYTES = 1 << 20  # texts hashed together; a longer text is hashed alone

_STEP = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# ASCII white space; the code of each byte, A-Z as a-z.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CODE = mixed(np.arange(1, 257, dtype=np.uint64) * _STEP)
_CODE[65:91] = _CODE[97:123]


class _Powers:
    """Powers of the step and of its inverse, as many as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _STEP)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _INVERSE)], dtype=np.uint64)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def word_hashes(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between white space and the number of words of each text; text k is data[edges[k]:edges[k + 1]]."""
    size = len(data)
    if not size:
        return np.zeros(0, np.uint64), np.zeros(len(edges) - 1, np.int64)
    gap = _SPACE[data]
    before = np.r_[True, gap[:-1]]
    after = np.r_[gap[1:], True]
    inner = edges[(edges > 0) & (edges < size)]
    before[inner] = True
    after[inner - 1] = True
    starts = np.flatnonzero(before & ~gap)
    ends = np.flatnonzero(after & ~gap)
    up, down = _POWERS.get(size)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_CODE[data] * up, out=sums[1:])
    hashes = mixed((sums[ends + 1] - sums[starts]) * down[starts])
    return hashes, np.diff(np.searchsorted(starts, edges))


def shingle_sets(data: np.ndarray, edges: np.ndarray, size: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingles of ``size`` words of each text; a shorter text is one shingle, a text without words none."""
    flat, counts = word_hashes(data, edges)
    if len(flat) >= size:
        windows = np.full(len(flat) - size + 1, size, np.uint64)
        for k in range(size):
            windows = windows * _STEP + flat[k : k + len(windows)]
        windows = mixed(windows)
    found, at = [], 0
    for count in counts.tolist():
        if count >= size:
            own = np.sort(windows[at : at + count - size + 1])
            found.append(own[np.r_[True, own[1:] != own[:-1]]])
        elif count:
            whole = np.full(1, count, np.uint64)
            for k in range(count):
                whole = whole * _STEP + flat[at + k]
            found.append(mixed(whole))
        else:
            found.append(flat[:0])
        at += count
    return found


def column_shingles(column: pa.Array, size: int = WORDS):
    """Shingles of each text of an Arrow column, a null as an empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, body = column.buffers()
    edges = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None and len(body) else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + BATCH_BYTES, side="right")) - 1)
        yield from shingle_sets(data[edges[first] : edges[last]], edges[first : last + 1] - edges[first], size)
        first = last


def text_shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Shingles of one text."""
    return next(column_shingles(pa.array([text or ""]), size))
