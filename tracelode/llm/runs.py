"""Periodic runs of words, found on a Re-Pair grammar of each document.

Word ids are compressed by Re-Pair: the most frequent pair of neighbouring symbols becomes a new symbol until no pair
occurs twice.  A pair that is more frequent than every pair overlapping one of its occurrences can be replaced before the
others without changing what they become, so one round replaces all such pairs of all documents at hand.  Words whose
pairs occur once can't lie in a run (each pair of a run of four periods occurs three times), and the grammar leaves them
alone; what lies between them is an island.

A run belongs to the lowest node of the derivation whose two halves it crosses.  Each symbol is searched once, at its
first place: a period q has a square of length 2 q on one side of the boundary at least, which prefix hashes find, and the
run is what the longest common extensions give around it.  Runs are then carried to all places of their symbol in the
derivation, and of those of one period the maximal ones are kept.  The final sequence of an island is halved again and
again, which gives every boundary in it a node.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame

from tracelode.llm.frames import over_batches
from tracelode.llm.shingles import mixed

LEAST_WORDS = 6
LEAST_PERIODS = 4
BATCH_WORDS = 400_000  # words compressed together; a longer document is compressed alone
TESTS = 1 << 21  # (node, period) pairs looked at together
SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def perturbed(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places that the words of a document are taken from, where its checksum asks for a periodic tail; None elsewhere."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    places = np.arange(n)
    places[first:] = first + (places[first:] - first) % period
    return places


class Grammar:
    """Re-Pair rules over documents laid end to end; ``ids`` are non-negative and differ between documents.

    ``left``, ``right``, ``length`` and ``first`` (a place in the text) describe rule k, whose symbol is ``base + k``.
    ``symbols``, ``places`` and ``island`` are what is left of each island."""

    def __init__(self, ids: np.ndarray):
        self.base = int(ids.max()) + 1 if len(ids) else 0
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        self.length: list[np.ndarray] = []
        self.first: list[np.ndarray] = []
        symbols, places, sizes, joined = ids, np.arange(len(ids)), np.ones(len(ids), np.int64), np.r_[np.ones(max(0, len(ids) - 1), bool), np.zeros(min(1, len(ids)), bool)]
        island = None
        done: list[tuple[np.ndarray, ...]] = []
        total = self.base
        while len(symbols):
            # A neighbour pair whose count is one stays so for ever; it separates what is compressed.
            at, kinds, counts = _pairs(symbols, joined)
            frequent = np.zeros(len(symbols), bool)
            frequent[at] = counts[kinds] > 1
            same = np.r_[symbols[1:] == symbols[:-1], False] & joined
            odd = same.copy()
            odd[at] = False
            frequent |= odd & np.r_[False, frequent[:-1]]  # a pair of equals that overlaps the one before
            if island is None:
                apart = ~np.r_[False, frequent[:-1]]
                island = np.cumsum(apart)
                sized = np.bincount(island)[island] >= LEAST_WORDS
                joined = frequent
            else:
                joined = joined & frequent
                sized = np.r_[False, joined[:-1]] | joined
                done.append((symbols[~sized], places[~sized], sizes[~sized], island[~sized]))
            if not sized.all():
                symbols, places, sizes, joined, island = symbols[sized], places[sized], sizes[sized], joined[sized], island[sized]
                if not len(symbols):
                    break
                at, kinds, counts = _pairs(symbols, joined)
            chosen = _chosen(len(symbols), at, kinds, counts)
            if not len(chosen[0]):
                done.append((symbols, places, sizes, island))
                break
            at, kinds = chosen
            _, firsts, names = np.unique(kinds, return_index=True, return_inverse=True)
            head = at[firsts]
            self.left.append(symbols[head])
            self.right.append(symbols[head + 1])
            self.first.append(places[head])
            self.length.append(sizes[head] + sizes[head + 1])
            symbols, sizes = symbols.copy(), sizes.copy()
            sizes[at] += sizes[at + 1]
            symbols[at] = total + names
            total += len(head)
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            joined = joined.copy()
            joined[at] = joined[at + 1]
            symbols, places, sizes, joined, island = symbols[keep], places[keep], sizes[keep], joined[keep], island[keep]
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.left, self.right, self.first, self.length = (join(x) for x in (self.left, self.right, self.first, self.length))
        rest = [join([d[k] for d in done]) for k in range(4)]
        order = np.argsort(rest[1], kind="stable")
        self.symbols, self.places, self.sizes, self.island = (x[order] for x in rest)


def _pairs(symbols: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of non-overlapping neighbour pairs, the kind of each, and how often each kind occurs."""
    at = np.flatnonzero(joined[:-1])
    a, b = symbols[at], symbols[at + 1]
    equal = a == b
    if equal.any():
        # in a stretch of equal symbols every second pair counts
        starts = np.r_[True, (at[1:] != at[:-1] + 1) | (a[1:] != a[:-1]) | ~equal[:-1]]
        offset = np.arange(len(at)) - np.flatnonzero(starts)[np.cumsum(starts) - 1]
        keep = ~equal | (offset % 2 == 0)
        at, a, b = at[keep], a[keep], b[keep]
    if not len(at):
        return at, at, at
    codes, kinds = np.unique(a * (symbols.max() + 1) + b, return_inverse=True)
    return at, kinds, np.bincount(kinds, minlength=len(codes))


def _chosen(size: int, at: np.ndarray, kinds: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and kinds of the repeated pairs that no more frequent pair overlaps; ties are ordered by a hash."""
    if not len(at):
        return at, kinds
    hashed = mixed(np.arange(1, len(counts) + 1, dtype=np.uint64) * _STEP)
    rank = np.empty(len(counts), np.int64)
    rank[np.lexsort((hashed, counts))] = np.arange(1, len(counts) + 1)
    rank[counts < 2] = 0
    weight = np.zeros(size + 2, np.int64)
    weight[at + 1] = rank[kinds]
    beside = np.maximum(weight[at], weight[at + 2])
    blocked = rank == 0
    blocked[kinds[beside > rank[kinds]]] = True
    keep = ~blocked[kinds]
    return at[keep], kinds[keep]


class Texts:
    """Equal stretches and common extensions of one id sequence by prefix hashes."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        values = mixed(ids.astype(np.uint64) + np.uint64(1))
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(len(ids), _STEP)], dtype=np.uint64)
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(values * self.power[:-1], out=self.sums[1:])

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the ``n`` ids from a and from b > a agree."""
        return (self.sums[a + n] - self.sums[a]) * self.power[b - a] == self.sums[b + n] - self.sums[b]

    def ahead(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many ids from a and from b agree, ``limit`` at most."""
        low, high = np.zeros(len(a), np.int64), limit.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = self.equal(a, b, middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low

    def behind(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many ids before a and before b agree, ``limit`` at most."""
        low, high = np.zeros(len(a), np.int64), limit.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = self.equal(a - middle, b - middle, middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low


def _nodes(grammar: Grammar) -> tuple[np.ndarray, ...]:
    """(start, boundary, end, rule or -1) of all rules and of the halvings of the islands' final sequences."""
    rules = np.flatnonzero(grammar.length >= LEAST_WORDS)
    halves = grammar.left[rules]
    inner = halves >= grammar.base
    size = np.ones(len(rules), np.int64)
    size[inner] = grammar.length[halves[inner] - grammar.base]
    start = grammar.first[rules]
    found = [(start, start + size, start + grammar.length[rules], rules)]
    edges = np.flatnonzero(np.r_[True, grammar.island[1:] != grammar.island[:-1], True]) if len(grammar.island) else np.zeros(1, np.int64)
    low, high = edges[:-1], edges[1:]
    ends = grammar.places + grammar.sizes
    while len(low):
        wide = (high - low > 1) & (ends[high - 1] - grammar.places[low] >= LEAST_WORDS)
        low, high = low[wide], high[wide]
        middle = (low + high) // 2
        found.append((grammar.places[low], grammar.places[middle], ends[high - 1], np.full(len(low), -1)))
        low, high = np.r_[low, middle], np.r_[middle, high]
    return tuple(np.concatenate([f[k] for f in found]) for k in range(4))


def crossing_runs(texts: Texts, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """(node, start, end, period) of the runs inside [start, end) of each node that hold words of both its halves."""
    found = []
    for right in (True, False):
        periods = (end - middle if right else middle - start) // 2
        periods = np.minimum(periods, (end - start) // LEAST_PERIODS)
        edge = np.r_[0, np.cumsum(periods)]
        first = 0
        while first < len(periods):
            last = max(first + 1, int(np.searchsorted(edge, edge[first] + TESTS, side="right")) - 1)
            counts = periods[first:last]
            node = np.repeat(np.arange(first, last), counts)
            q = np.arange(len(node)) - np.repeat(edge[first:last] - edge[first], counts) + 1
            m = middle[node]
            a = m if right else m - 1
            alike = texts.ids[a] == texts.ids[a + q if right else a - q]
            node, q, m = node[alike], q[alike], m[alike]
            base = m if right else m - 2 * q
            alike = texts.equal(base, base + q, q)
            node, q, m = node[alike], q[alike], m[alike]
            base = m if right else m - q
            low = base - texts.behind(base, base + q, base - start[node])
            high = base + q + texts.ahead(base, base + q, end[node] - base - q)
            good = (low < m) & (high > m) & (high - low >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q))
            found.append((node[good], low[good], high[good], q[good]))
            first = last
    node, low, high, q = (np.concatenate([f[k] for f in found]) for k in range(4)) if found else (np.zeros(0, np.int64),) * 4
    # of the periods of one stretch the smallest one divides the others
    order = np.lexsort((q, high, low, node))
    node, low, high, q = node[order], low[order], high[order], q[order]
    new = np.r_[True, (node[1:] != node[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])] if len(node) else np.zeros(0, bool)
    return node[new], low[new], high[new], q[new]


def _everywhere(grammar: Grammar, rule: np.ndarray, low: np.ndarray, high: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """The runs of rules at all places of their symbols in the derivation of the islands."""
    holds = np.zeros(len(grammar.length), bool)
    holds[rule] = True
    own = holds.copy()
    base = grammar.base
    while True:  # symbols above a symbol that holds runs; rules are deep as their round at most
        more = holds.copy()
        for side in (grammar.left, grammar.right):
            inner = side >= base
            more[inner] |= holds[side[inner] - base]
        if (more == holds).all():
            break
        holds = more
    order = np.argsort(rule, kind="stable")
    rule, low, high, q = rule[order], low[order], high[order], q[order]
    counts = np.bincount(rule, minlength=len(grammar.length))
    begins = np.r_[0, np.cumsum(counts)]
    symbol, place = grammar.symbols, grammar.places
    found = []
    while len(symbol):
        inner = symbol >= base
        symbol, place = symbol[inner] - base, place[inner]
        keep = holds[symbol]
        symbol, place = symbol[keep], place[keep]
        at = own[symbol]
        k = np.repeat(begins[symbol[at]], counts[symbol[at]]) + _within(counts[symbol[at]])
        shift = np.repeat(place[at] - grammar.first[symbol[at]], counts[symbol[at]])
        found.append((low[k] + shift, high[k] + shift, q[k]))
        left = grammar.left[symbol]
        size = np.ones(len(left), np.int64)
        size[left >= base] = grammar.length[left[left >= base] - base]
        symbol, place = np.r_[left, grammar.right[symbol]], np.r_[place, place + size]
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))


def _within(counts: np.ndarray) -> np.ndarray:
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def maximal(low: np.ndarray, high: np.ndarray, q: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Intervals of one period that no other interval of it contains, in order of their start; ``span`` exceeds every end."""
    order = np.lexsort((-high, low, q))
    low, high, q = low[order], high[order], q[order]
    if not len(low):
        return low, high, q
    part = np.cumsum(np.r_[False, q[1:] != q[:-1]]) * np.int64(span + 1)
    reach = np.maximum.accumulate(high + part)
    keep = np.r_[True, (high + part)[1:] > reach[:-1]]
    low, high, q = low[keep], high[keep], q[keep]
    order = np.lexsort((q, low))
    return low[order], high[order], q[order]


def runs_of(ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, period) of the runs of documents laid end to end, whose ids differ between documents."""
    if not len(ids):
        return (np.zeros(0, np.int64),) * 3
    grammar = Grammar(ids)
    texts = Texts(ids)
    start, middle, end, rule = _nodes(grammar)
    node, low, high, q = crossing_runs(texts, start, middle, end)
    owner = rule[node]
    within = owner >= 0
    more = _everywhere(grammar, owner[within], low[within], high[within], q[within])
    low, high, q = (np.r_[own[~within], other] for own, other in zip((low, high, q), more, strict=True))
    return maximal(low, high, q, len(ids))


def _ids(words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Numbers of the words, the same for equal words of one document only."""
    coded = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    _, ids = np.unique(doc * (coded.max() + 1) + coded, return_inverse=True)
    return ids


def _flush(keys: list, texts: list[list[bytes]]) -> dict:
    counts = np.array([len(w) for w in texts], np.int64)
    edges = np.r_[0, np.cumsum(counts)]
    flat = [w for words in texts for w in words]
    low, high, q = runs_of(_ids(flat, counts)) if flat else runs_of(np.zeros(0, np.int64))
    owner = np.searchsorted(edges, low, side="right") - 1
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    out: dict[str, list] = {name.split()[0]: [] for name in SCHEMA.split(", ")}
    for k, (key, words) in enumerate(zip(keys, texts, strict=True)):
        a, b = bounds[k], bounds[k + 1]
        runs = [(int(s - edges[k]), int(e - s), int(p)) for s, e, p in zip(low[a:b], high[a:b], q[a:b], strict=True)]
        best = None
        for s, n, p in runs:  # by start, then period; a later run must be strictly better
            if best is None or n * best[2] > best[1] * p:
                best = (s, n, p)
        kept = words
        if runs:
            drop = np.zeros(len(words) + 1, np.int64)
            for s, n, p in runs:
                drop[s + p] += 1
                drop[s + n] -= 1
            kept = [w for w, d in zip(words, np.cumsum(drop[:-1]).tolist(), strict=True) if not d]
        out["doc_id"].append(key)
        out["n_runs"].append(len(runs))
        for name, value in zip(("start", "length", "period"), best or (None, None, None), strict=True):
            out[name].append(value)
        out["exponent_milli"].append(1000 * best[1] // best[2] if best else None)
        out["runs_sha256"].append(hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest())
        out["collapsed_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent, digests of all runs and of the words kept, for every row.

    A null or empty text has no words and no run, and its digests are those of the empty text; a null doc_id is kept and its
    words are never rearranged; repeated rows are searched each; ties go to the smallest start, then period; a document of
    any length is searched whole; an empty table has no rows, and other columns are ignored."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        keys: list = []
        texts: list[list[bytes]] = []
        size = 0
        for batch in batches:
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = text.encode().split() if text else []  # splits at the six bytes of ASCII white space
                places = perturbed(key, len(words))
                if size + len(words) > BATCH_WORDS and keys:
                    yield _flush(keys, texts)
                    keys, texts, size = [], [], 0
                keys.append(key)
                texts.append(words if places is None else [words[i] for i in places.tolist()])
                size += len(words)
        if keys:
            yield _flush(keys, texts)

    return over_batches(docs.select("doc_id", "text"), run, SCHEMA)
