"""Suffix arrays, repeated strings, shingle components and near copies against brute force."""

import hashlib
import random
import re

import numpy as np
from llm.cases import BIG, prose, rows, table

from tracelode.llm import jaccard, suffixes
from tracelode.llm.components import components
from tracelode.llm.frames import membership
from tracelode.llm.shingles import text_shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for _ in range(150):
        letters = rng.choice([1, 2, 3, 256])
        codes = np.array([x for _ in range(rng.randint(1, 8)) for x in [*(rng.randrange(letters) + 1 for _ in range(rng.randint(1, 30))), 0]])
        depth = rng.choice([7, 10, 20])
        array = suffixes.suffix_array(codes, depth + 7)
        assert sorted(array.tolist()) == list(range(len(codes)))
        at = [i for i in array.tolist() if i + depth <= len(codes) and 0 not in codes[i : i + depth]]
        keys = [tuple(codes[i : i + depth]) for i in at]
        assert keys == sorted(keys)
        if at:
            shared = suffixes.common_prefixes(codes, np.array(at), depth)
            for k in range(1, len(at)):
                n = next((j for j in range(depth) if keys[k][j] != keys[k - 1][j]), depth)
                assert shared[k] == n


def kept_by_brute_force(data, length):
    texts = [(i, (t or "").encode()) for i, t, *_ in data]
    first = {}
    for i, b in texts:
        if i is not None:
            for k in range(len(b) - length + 1):
                s = b[k : k + length]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        if i is not None:
            for k in range(len(b) - length + 1):
                if first[b[k : k + length]] < i:
                    gone[k : k + length] = b"\1" * length
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_repeated_strings(spark):
    rng = random.Random(4)
    pieces = [prose(50 + k, 12) for k in range(6)]
    more = [(100 + k, " ".join(rng.choice(pieces)[rng.randint(0, 9) :] for _ in range(rng.randint(1, 5))), None, 0, "", "", "", 0.0, 0) for k in range(40)]
    data = rows() + more
    got = sorted(map(tuple, suffixes.remove_repeats(table(spark, data)).collect()), key=str)
    assert got == kept_by_brute_force(data, 50)
    assert suffixes.remove_repeats(table(spark, [])).count() == 0


def shingle_set(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def expected_components(data):
    sets = [shingle_set(t) for _, t, *_ in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                root[find(a)] = find(b)
    ids = {}
    for k, row in enumerate(data):
        ids.setdefault(find(k), []).append(row[0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return sorted(((row[0], len(sets[k]), least[find(k)]) for k, row in enumerate(data)), key=str)


def test_shingles_are_sets():
    for _, text, *_ in rows():
        assert len(text_shingles(text)) == len(shingle_set(text))
    assert (text_shingles("A b\tC d\ne F") == text_shingles(" a B c D e f ")).all()


def test_jaccard_components(spark):
    rng = random.Random(9)
    base = prose(77, 90).split()
    near = []
    for k in range(30):  # chains of edits around the threshold
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(40)}"
        near.append((200 + k, " ".join(words), None, 0, "", "", "", 0.0, 0))
    data = rows() + near
    got = sorted(map(tuple, jaccard.jaccard_components(table(spark, data)).collect()), key=str)
    assert got == expected_components(data)
    assert jaccard.jaccard_components(table(spark, [])).count() == 0


def test_one_of_each(spark):
    docs = table(spark)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [row["doc_id"] for row in kept.select("doc_id").collect()]
    assert sorted(map(str, ids)) == sorted(map(str, [3, 11, 12, 13, 14, 16, 17, 18, 19, 20, 21, BIG, BIG + 1]))


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert {found[k] for k in range(41)} == {0} and {found[k] for k in range(100, 140)} == {100}


def exchanged(df):
    """Columns that each exchange of the plan carries."""
    plan = df.sparkSession.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [part.split("Input [", 1)[1].split("]: ", 1)[1].split("\n", 1)[0] for part in plan.split("\n\n") if ") Exchange\n" in part and "Input [" in part]


def test_texts_of_whole_copies_are_not_shuffled(spark):
    """Only rows that share a doc_id with a copy but are none bring their text."""
    texts = {k: prose(k, 60) for k in range(6)}
    data = [(k, texts[k % 6], None, 0, "", "", "", 0.0, 0) for k in range(60)]
    data += [(59, "another text of a doc_id that is a copy elsewhere", None, 0, "", "", "", 0.0, 0), (70, "short", None, 0, "", "", "", 0.0, 0), (71, "short", None, 0, "", "", "", 0.0, 0)]
    docs = table(spark, data)
    assert sorted(map(tuple, suffixes.remove_repeats(docs).collect()), key=str) == kept_by_brute_force(data, 50)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = suffixes.remove_repeats(docs)
        carried = exchanged(found)
        assert any("n_removed" in c for c in carried)
        assert not any("text#" in c for c in carried if "n_removed" in c)
        texts_only = docs.select("doc_id", "text")
        assert suffixes.without_copies(texts_only, suffixes.whole_copies(texts_only))[0].count() == 6 + 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_long_texts_qualify_by_the_leading_shingles_they_share(spark):
    """Long texts with a passage in common are no pair; those near the threshold are, whatever they share."""
    rng = random.Random(5)
    draw = lambda n: [f"w{rng.randrange(3_000)}" for _ in range(n)]
    passages, base = [draw(150) for _ in range(5)], draw(1_400)  # in four texts each: shingles of more are common and do not lead
    data = [(k, " ".join(draw(500) + passages[k % 5] + draw(500 + 10 * k)), None, 0, "", "", "", 0.0, 0) for k in range(20)]
    for k in range(24):  # up to about the threshold, by edits or by length
        words = list(base) + draw(30 * (k % 12))
        for _ in range(0 if k % 2 else 3 * k):
            words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
        data.append((100 + k, " ".join(words), None, 0, "", "", "", 0.0, 0))
    docs = table(spark, data)
    order = spark.sparkContext.broadcast(jaccard.Order(jaccard.frequent_shingles(docs, 5)[0]))
    group = {key: int(order.value.keys(text_shingles(text))[0]) for key, text, *_ in data}
    found = {frozenset(map(int, row)) for row in jaccard.qualifying_groups(docs, 5, 75, order, 4).collect()}
    assert not any(frozenset((group[a], group[b])) in found for a in range(20) for b in range(a))
    sets = {key: shingle_set(text) for key, text, *_ in data}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert len(linked) > 30 and all(group[a] == group[b] or frozenset((group[a], group[b])) in found for a, b in linked)
    assert sorted(map(tuple, jaccard.jaccard_components(docs).collect()), key=str) == expected_components(data)


def test_membership_needs_no_python(spark):
    """A filter before a Python step must not take a second worker for each task."""
    keys = spark.range(0, 40_000, 7).withColumnRenamed("id", "k")
    may_hold = membership(keys, "k")
    rows = spark.range(40_000).union(spark.sql("select cast(null as long) as id"))
    held = rows.filter(may_hold("id"))
    assert "Python" not in held._jdf.queryExecution().toString()
    got = {row["id"] for row in held.collect()}
    assert set(range(0, 40_000, 7)) <= got and len(got) < 7_000
    assert rows.filter(~may_hold("id")).count() == 40_001 - len(got)
    assert rows.filter(membership(keys.filter("k < 0"), "k")("id")).count() == 0
