"""Periodic runs against a search of every period of every document."""

import hashlib
import random
import zlib

import numpy as np
from llm.cases import BIG, prose, rows, table

from tracelode.llm import runs


def brute_runs(words):
    """Every maximal stretch of least period q with max(6, 4 q) words, by comparing all words at every distance."""
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - s
            if length >= max(6, 4 * q) and all(any(words[s + k] != words[s + k + p] for k in range(length - p)) for p in range(1, q)):
                found.append((s, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = None
    for s, length, q in found:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    return (
        doc_id, len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def repetitive(rng):
    """Words over few letters, with powers of random words, powers of powers and plain stretches."""
    out = []
    while len(out) < rng.choice((8, 40, 160)):
        kind = rng.random()
        if kind < 0.6:
            unit = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
            if rng.random() < 0.3:
                unit = unit * rng.randint(2, 5) + [rng.choice("abc")]
            out += (unit * rng.randint(2, 9))[: rng.randint(4, 90)]
        else:
            out += [rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))]
    return out


def test_runs_of_repetitive_sequences():
    rng = random.Random(3)
    for _ in range(25):
        docs = [repetitive(rng) for _ in range(rng.randint(1, 12))] + [[], ["a"] * rng.randint(1, 300)]
        flat = [w.encode() for d in docs for w in d]
        counts = np.array([len(d) for d in docs])
        low, high, q = runs.runs_of(runs._ids(flat, counts))
        got = sorted(zip(low.tolist(), (high - low).tolist(), q.tolist(), strict=True))
        want = sorted((s + int(at), length, p) for d, at in zip(docs, np.cumsum(counts) - counts, strict=True) for s, length, p in brute_runs(d))
        assert got == want


def expand(grammar, symbol):
    if symbol < grammar.base:
        return [symbol]
    k = symbol - grammar.base
    return expand(grammar, grammar.left[k]) + expand(grammar, grammar.right[k])


def test_grammar_expands_to_its_text_and_repeats_no_pair():
    rng = random.Random(8)
    for _ in range(20):
        ids = np.array([ord(w) for w in repetitive(rng)])
        grammar = runs.Grammar(ids)
        for symbol, place, size in zip(grammar.symbols, grammar.places, grammar.sizes, strict=True):
            assert expand(grammar, symbol) == ids[place : place + size].tolist()
        for k in range(len(grammar.length)):
            assert expand(grammar, grammar.base + k) == ids[grammar.first[k] : grammar.first[k] + grammar.length[k]].tolist()
        last: dict[tuple, int] = {}
        for k in range(len(grammar.symbols) - 1):
            if grammar.island[k] == grammar.island[k + 1]:
                pair = (grammar.symbols[k], grammar.symbols[k + 1])
                assert pair not in last or last[pair] == k - 1  # only pairs that overlap themselves may stand twice
                last[pair] = k


def test_find_runs(spark):
    rng = random.Random(5)
    data = rows() + [(k, " ".join(repetitive(rng)), None, 0, "", "", "", 0.0, 0) for k in range(1000, 1120)]
    data += [(2000 + k, prose(k, 120), None, 0, "", "", "", 0.0, 0) for k in range(60)]
    data += [(3000, "a " * 5000, None, 0, "", "", "", 0.0, 0), (BIG + 7, "A a A a A a A a", None, 0, "", "", "", 0.0, 0)]
    data = [r for r in data if len(r[1] or "") < 60_000]  # the search of every period is quadratic
    got = sorted(map(tuple, runs.find_runs(table(spark, data)).collect()), key=str)
    assert got == sorted((expected(r[0], r[1]) for r in data), key=str)
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in data)
    assert runs.find_runs(table(spark, [])).count() == 0


def test_long_documents_and_small_batches(spark, monkeypatch):
    rng = random.Random(6)
    data = [(k, " ".join(repetitive(rng)), None, 0, "", "", "", 0.0, 0) for k in range(30)]
    many = runs.find_runs(table(spark, data)).collect()
    monkeypatch.setattr(runs, "BATCH_WORDS", 10)
    monkeypatch.setattr(runs, "TESTS", 7)
    assert sorted(many) == sorted(runs.find_runs(table(spark, data)).collect())
    low, high, q = runs.runs_of(np.r_[np.arange(30_000) % 7_001, 7_001 + np.arange(5)])
    assert (low.tolist(), high.tolist(), q.tolist()) == ([0], [30_000], [7_001])
