"""Suffix tree scores against a model of dictionaries, and its distributions against one."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm.cases import BIG, rows, table

from tracelode.llm import context_tree

END = None


def tokens(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split() + [END]


def held(doc_id):
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % 10 == 0


class Brute:
    """Contexts as tuples of words, grown, tested and smoothed one by one."""

    def __init__(self, data):
        docs = [tokens(r[1]) for r in data if not held(r[0])]
        self.unigrams = Counter(w for d in docs for w in d)
        self.total, self.kinds = sum(self.unigrams.values()), len(self.unigrams)
        least = max(16, math.ceil(self.total * 2.0**-17))
        self.next = defaultdict(Counter)
        for d in docs:
            for i in range(len(d)):
                for k in range(1, 4):
                    if i >= k:
                        self.next[tuple(d[i - k : i])][d[i]] += 1
        self.kept = {}
        level = {(w,) for w, n in self.unigrams.items() if n >= least and w is not END}
        for _ in range(3):
            for c in level:
                seen = self.next[c]
                n = sum(seen.values())
                twice = {w: m for w, m in seen.items() if m > 1}
                p = {w: self.probability(w, self.suffix(c[1:])) for w in twice}
                g = sum(m * math.log(m / (n * p[w])) for w, m in twice.items())
                rest = n - sum(twice.values())
                g += rest * math.log(rest / (n * max(1 - sum(p.values()), 1e-12))) if rest else 0
                if g >= (len(twice) + 1) * math.log(n):
                    self.kept[c] = n
            level = {(*c, w) for c in level for w, m in self.next[c].items() if m >= least and w is not END}

    def suffix(self, context):
        while context and context not in self.kept:
            context = context[1:]
        return context

    def probability(self, word, state):
        if not state:
            return (self.unigrams[word] + 0.1) / (self.total + 0.1 * (self.kinds + 1))
        n, seen = self.kept[state], self.next[state]
        free = n - sum(m - 1 for m in seen.values())
        return (max(seen[word] - 1, 0) + free * self.probability(word, self.suffix(state[1:]))) / n

    def score(self, text):
        d = tokens(text)
        base = sum(math.log10(self.probability(w, ())) for w in d)
        best = sum(math.log10(self.probability(w, self.suffix(tuple(d[max(0, i - 3) : i])))) for i, w in enumerate(d))
        return len(d), sum(self.unigrams[w] > 0 for w in d), self.total, base, best


def chain(rng, words):
    """Text whose next word depends on the last two."""
    out = ["a", "b"]
    while len(out) < words:
        k = (sum(map(ord, out[-1])) * 3 + sum(map(ord, out[-2]))) % 7
        out.append(rng.choice(["abcdefg"[k]] * 4 + list("abcdefgh") + [f"x{rng.randrange(300)}"]))
    return " ".join(w.upper() if rng.random() < 0.1 else w for w in out)


def corpus():
    rng = random.Random(12)
    return rows() + [(1000 + k, chain(rng, rng.randint(1, 200)), None, 0, "", "", "", 0.0, 0) for k in range(150)]


@pytest.mark.parametrize("block", [2_000_000, 700])
def test_scores(spark, monkeypatch, block):
    monkeypatch.setattr(context_tree, "BLOCK_TOKENS", block)
    data = corpus()
    model = Brute(data)
    assert {len(c) for c in model.kept} == {1, 2, 3}
    got = sorted(map(tuple, context_tree.score_documents(table(spark, data)).collect()), key=lambda r: (str(r[0]), r[2], r[5]))
    want = sorted(((r[0], held(r[0]), *model.score(r[1])) for r in data), key=lambda r: (str(r[0]), r[2], r[5]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9, atol=0)
    assert np.allclose([r[6] for r in got], [r[6] for r in want], rtol=1e-5, atol=0)
    assert BIG in {r[0] for r in got} and None in {r[0] for r in got}
    # every state gives the words and the unknown word together the probability one
    for state in random.Random(1).sample(sorted(model.kept), 20):
        assert abs(sum(model.probability(w, state) for w in [*model.unigrams, b"never seen"]) - 1) < 1e-9


def test_empty_and_untrained(spark):
    assert context_tree.score_documents(table(spark, [])).count() == 0
    ids = [i for i in range(100) if held(i)][:3]
    out = context_tree.score_documents(table(spark, [(i, "a b", None, 0, "", "", "", 0.0, 0) for i in ids])).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in out] == [(3, 0, 0, 0.0, 0.0)] * 3


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    arrays = [np.sort(rng.integers(0, 2**63, 50)).astype(np.uint64), np.zeros(0, np.uint64), np.array([5, 3, 2**40]), np.array([2**64 - 1], np.uint64), np.zeros(7)]
    assert all((a.astype(np.uint64) == b).all() for a, b in zip(arrays, context_tree.unpack(context_tree.pack(*arrays)), strict=True))
