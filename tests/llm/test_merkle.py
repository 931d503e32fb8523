"""Merkle proofs and the append log against trees built node by node."""

import hashlib
import random
import zlib

import pytest
from llm.cases import BIG

from tracelode.llm import merkle

SCHEMA = "text string, doc_id long, lang string, n_chars long, source string, tree string, leaf string, idx long, n long, path binary"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def grow(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def proof(levels, k):
    out = []
    for nodes in levels[:-1]:
        first = k - k % 8
        run = nodes[first : first + 8]
        out.append((run[: k - first], run[k - first + 1 :]))
        k //= 8
    return out


def up(leaf, path):
    for before, after in path:
        leaf = H(*before, leaf, *after)
    return leaf


def brute(data):
    def hashed(r, text):
        return H(field(r[1]), field(r[4]), field(r[2]), field(r[3]), field(text))

    trees = {}
    for r in data:
        trees.setdefault(r[2], []).append((hashed(r, r[0]), r))
    for rows in trees.values():
        rows.sort(key=lambda x: (x[1][1] is not None, x[1][1] or 0, x[0]))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    grown = {t: grow([h for h, _ in rows]) for t, rows in trees.items()}
    top = grow([grown[t][-1][0] for t in order])
    out = []
    for place, t in enumerate(order):
        for k, (leaf, r) in enumerate(trees[t]):
            path = proof(grown[t], k) + proof(top, place)
            folded = leaf
            if r[1] is not None and zlib.crc32(str(r[1]).encode()) % 3 == 0:
                folded = hashed(r, None if r[0] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[0]))
            again = up(folded, path)
            out.append((r[1], leaf, grown[t][-1][0], top[-1][0], H(*(x for lo, hi in path for x in (*lo, *hi))), again, again == top[-1][0]))
    return sorted(out, key=str), grown


def documents():
    rng = random.Random(2)
    data = []
    for lang, count in (("en", 700), ("de", 65), (None, 9), ("fr", 8), ("é", 1), ("", 64)):
        for _ in range(count):
            text = rng.choice((None, "", "Some Text", "ÀB c\n中文", "x" * rng.randint(0, 5000)))
            data.append((text, rng.choice((None, BIG, rng.randint(-5, 400), rng.randint(0, 10**9))), lang, rng.choice((None, 7)), rng.choice((None, "s", "a:b")), "t", "l", 3, 4, b"p"))
    return data + data[:40] * 3  # repeated rows


@pytest.mark.parametrize("levels", [1, 3])
def test_proofs_and_log(spark, levels):
    data = documents()
    docs = spark.createDataFrame(data, SCHEMA).repartition(5)
    want, grown = brute(data)
    got = sorted(map(tuple, merkle.proofs(docs, levels).collect()), key=str)
    assert got == want
    assert {row[-1] for row in got} == {True, False}
    if levels > 1:
        return
    rows = merkle.log(merkle.manifest(docs, levels)).collect()
    for lang, tree in grown.items():
        own = {r["place"]: r["digest"] for r in rows if r["tree"] == ("-" if lang is None else ":" + lang)}
        log = []
        for k, leaf in enumerate(tree[0]):  # append leaf after leaf; a parent follows its last child
            log.append(leaf)
            last = k + 1 == len(tree[0])
            level, at = 1, k
            while level < len(tree) and (last or at % 8 == 7):
                at //= 8
                log.append(tree[level][at])
                level += 1
        assert own == dict(enumerate(log))


def test_places_are_gapless():
    for leaves in [*range(1, 140), 511, 512, 513, 4097]:
        seen, width, level = [], leaves, 0
        while True:
            seen += [merkle.node_place(level, k, leaves) for k in range(width)]
            if width == 1:
                break
            width, level = -(-width // 8), level + 1
        assert sorted(seen) == list(range(len(seen)))


def test_single_and_empty(spark):
    one = spark.createDataFrame([("T", 1, "en", 1, "s", "", "", 0, 0, b"")], SCHEMA)
    row = merkle.proofs(one).collect()[0]
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == H()
    assert merkle.proofs(spark.createDataFrame([], SCHEMA)).count() == 0
