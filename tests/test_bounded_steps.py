"""Steps whose memory or shuffle must not grow faster than their input."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracelode.functions import binary, protocols
from tracelode.operators import blocks, inference, patterns, similarity, sweep, views
from tracelode.plans.ordered import CHUNK, Ordered
from tracelode.plans.quantiles import quantile, quantiles
from tracelode.queries import ORACLES, payloads


def overlap_rows(spark, rng, length):
    fields = [(rng.randrange(4), a, a + rng.randrange(5)) for a in (rng.randrange(600) for _ in range(300))]
    found = [(rng.randrange(3), a, a + rng.randrange(length)) for a in (rng.randrange(600) for _ in range(60))]
    left = spark.createDataFrame(fields + [(None, 1, 2), (1, None, 2)], "session int, start_pos int, end_pos int")
    right = spark.createDataFrame(found + [(None, 1, 2), (1, 3, None)], "session int, start_position int, end_position int")
    want = sorted(f for f in fields if any(f[0] == s and f[1] <= e and f[2] >= a for s, a, e in found))
    return left, right, want


def test_fields_and_blocks_meet_by_bounds(spark, chunked):
    left, right, want = overlap_rows(spark, random.Random(5), 20)
    assert sorted(map(tuple, blocks.intersecting(left, right, ["session"]).collect())) == want and 0 < len(want) < 300


def test_long_blocks_are_not_opened(spark):
    rows = [(1, 10, 10 + 2_000_000_000)]
    right = spark.createDataFrame(rows, "session int, start_position int, end_position int")
    left = spark.createDataFrame([(1, 5, 9), (1, 8, 10), (1, 2_000_000_000, 2_000_000_003)], "session int, start_pos int, end_pos int")
    assert sorted(r["start_pos"] for r in blocks.intersecting(left, right, ["session"]).collect()) == [8, 2_000_000_000]


def test_few_windows_travel_to_the_points(spark):
    rng = random.Random(6)
    points = [(rng.choice([0, 1]), rng.randrange(100), rng.choice([None, 1, 2])) for _ in range(150)]
    windows = [(k % 2, s, s + rng.randrange(4), k) for k, s in enumerate(rng.randrange(110) for _ in range(40))]
    p = spark.createDataFrame(points, "k int, t int, v int")
    w = spark.createDataFrame(windows, "k int, s int, e int, name int")
    want = []
    for k, s, e, name in windows:
        held = [v for a, t, v in points if a == k and s <= t <= e]
        want.append((k, s, e, name, len(held), len({v for v in held if v is not None}) > 1))
    few = sweep.changing_in_windows(p, w, ["k"], "t", "s", "e", ["v"])
    assert "Window" not in few._jdf.queryExecution().executedPlan().toString()
    many = sweep.changing_in_windows(p, w, ["k"], "t", "s", "e", ["v"], few=0)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == sorted(want)


def test_scanned_tasks_hold_one_chunk(spark, chunked):
    """A task's memory does not grow with the number of chunks, and changes are told as in a search of all pairs."""
    rng = random.Random(9)
    rows = [(rng.randrange(2), rng.randrange(300), rng.choice([None, 1, 1, 2]), rng.choice(["a", "b", None])) for _ in range(400)]
    points = spark.createDataFrame(rows, "k int, t int, v int, w string")
    scan = Ordered(points, ["k"], ["t"]).with_row_number("n").with_lag("p", F.col("t")).df
    held = scan.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct(CHUNK).alias("chunks"))
    assert [r["chunks"] for r in held.collect()] == [1] * (400 // 8)
    windows = [(k % 2, s, s + rng.randrange(-3, 9), k) for k, s in enumerate(rng.randrange(310) for _ in range(200))]
    want = []
    for k, s, e, name in windows:
        inside = [r[2:] for r in rows if r[0] == k and s <= r[1] <= e]
        want.append((k, s, e, name, len(inside), *(len({r[c] for r in inside} - {None}) > 1 for c in (0, 1))))
    found = sweep.changing_in_windows(points, spark.createDataFrame(windows, "k int, s int, e int, name int"), ["k"], "t", "s", "e", ["v", "w"])
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_recovered_view_without_writing_out_seconds(spark, chunked):
    rng = random.Random(10)
    rows = [(rng.choice([1, 2, 3, None]), rng.randrange(200) * 500_000, rng.choice("abc"), rng.choice([None, 1.0, 2.0]), n) for n in range(120)]
    far = [(4, 0, "a", 5.0, 200), (4, 9_000_000_000, "b", 6.0, 201)]  # more seconds than a block of the grid
    df = spark.createDataFrame(rows + far, "k int, t long, c string, v double, n int")
    given = (df, ["k"], "t", "c", "v", ["a", "b"], "n")
    above = df.select("k", F.floor(F.col("t") / 1_000_000).alias("sec")).where("sec % 3 = 0").distinct()
    spans = views.recovered_from_spans(above, views.dense_spans(*given), ["k"], ["a", "b"], F.col("sec") % 5 != 0)
    assert "Generate" not in spans._jdf.queryExecution().optimizedPlan().toString()
    dense = views.dense_seconds(*given)
    whole = views.recovered_view(above, dense.where("sec % 5 != 0"), ["k"], ["a", "b"])
    assert sorted(map(str, spans.collect())) == sorted(map(str, whole.collect())) and spans.where("a is not null").count() > 10
    want = {}
    for k in (1, 2, 3, 4):
        own = sorted((t // 1_000_000, t, n, c, v) for a, t, c, v, n in rows + far if a == k)
        for sec in range(own[0][0], own[-1][0] + 1):
            for c in "ab":
                last = {s: v for s, _, _, x, v in own if x == c}  # the last row of each second
                known = [(s, v) for s, v in sorted(last.items()) if v is not None]
                before = [v for s, v in known if s <= sec]
                want.setdefault((k, sec), []).append(before[-1] if before else known[0][1] if known else None)
    assert {(r["k"], r["sec"]): [r["a"], r["b"]] for r in dense.where("k is not null").collect()} == want


def test_headers_without_walking_bodies(spark):
    frames = payloads.enip_frames(spark, "/root/testdata/sf0.001").where("l_orderkey % 10 = 0")
    whole = protocols.parse(frames, "enip").select("l_orderkey", "l_linenumber", "enip")
    found = protocols.enip_headers(frames).select("l_orderkey", "l_linenumber", "enip")
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect()))
    query = payloads.enip_headers(spark, "/root/testdata/sf0.001")
    assert "cip_offset" not in query._jdf.queryExecution().optimizedPlan().toString()


def test_only_windows_of_a_prefix_are_written(spark):
    """Positions are left out before their windows; the prefix may reach over several tokens, tokens may be null."""
    rng = random.Random(11)
    rows = [(k, n, rng.choice(["e", "ea", "b", "", None])) for k in range(4) for n in range(30)]
    numbered = patterns.positions(spark.createDataFrame(rows, "k int, n int, t string"), ["k"], ["n"])
    every = patterns.ngrams(numbered, ["k"], "t", [1, 2, 5])
    for prefix in ("e", "e,b", ","):
        some = patterns.ngrams(numbered, ["k"], "t", [1, 2, 5], prefix)
        want = sorted(map(tuple, every.where(F.col("gram").startswith(prefix)).collect()))
        assert sorted(map(tuple, some.collect())) == want and len(want) > 5
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("StartsWith") < plan.index("Generate") < plan.rindex("StartsWith")


def test_maximal_patterns_list_ends_only(spark, chunked):
    rng = random.Random(12)
    grams = {(k, ",".join(rng.choice(["a", "ab", "b", "a-"]) for _ in range(rng.randrange(1, 7)))) for k in range(3) for _ in range(60)}
    rows = [(k, g.count(",") + 1, g) for k, g in sorted(grams)]
    kept = patterns.maximal_patterns(spark.createDataFrame(rows, "k int, size int, gram string"), ["k"])
    inside = lambda a, b: a[0] == b[0] and b[1] > a[1] and f",{a[2]}," in f",{b[2]},"
    want = sorted(a for a in rows if not any(inside(a, b) for b in rows))
    assert sorted((r["k"], r["size"], r["gram"]) for r in kept.collect()) == want and 20 < len(want) < len(rows) - 20
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "flatten" not in plan


def test_one_quantile_without_ranking_all_values(spark):
    rng = random.Random(7)
    for values in ([rng.gauss(0, 1) for _ in range(5_000)], [float(rng.randrange(3)) for _ in range(999)], [4.5]):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        for q in (0.0, 0.99):
            want = float(np.quantile(values, q))
            n = len(values)
            for guess in (None, (n, want - 0.01, want + 0.01), (n, want + 5, want + 6)):
                assert math.isclose(quantile(df, "v", q, guess=guess), want, rel_tol=1e-12, abs_tol=1e-12)
    assert quantile(df.where("v is null"), "v", 0.5) is None


def test_quantiles_are_rounded_as_in_sql(spark):
    """Interpolated values equal those of quantile_cont in every bit."""
    rng = random.Random(7)
    rows = [(k, round(rng.uniform(0.01, 500), 2)) for k in range(400) for _ in range(rng.randrange(5, 40))]
    found = quantiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.75})
    held = pa.table({"k": [k for k, _ in rows], "v": [v for _, v in rows]})  # noqa: F841
    want = duckdb.sql("select k, quantile_cont(v, [0.25, 0.5, 0.75]) from held group by 1").fetchall()
    assert {r["k"]: [r["a"], r["b"], r["c"]] for r in found.collect()} == dict(want)
    ends = spark.createDataFrame([(0, float("inf")), (0, 1.0), (0, 1.0), (0, 2.0), (0, 3.0), (1, 1e300), (1, 1.5e300)], "k int, v double")
    got = {r["k"]: r for r in quantiles(ends, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 1.0}).collect()}
    assert (got[0]["a"], got[0]["b"], got[0]["c"]) == (1.0, 2.0, math.inf) and math.isclose(got[1]["b"], 1.25e300)


def test_quartiles_that_differ_by_epsilon(spark):
    """Ties of a quartile's distance with epsilon fall as in SQL."""
    rng, left, right = random.Random(8), [], []
    for k in range(3_000):
        a, b = (sorted(rng.randrange(100, 5_000) for _ in range(n)) for n in (5, 3))
        low = a[1] + (a[2] - a[1]) / 4
        last = round(60 * abs(low - b[0]) - sum(a))  # the mean of a is ten times the distance
        if a[0] <= b[0] and last >= max(a[4], b[2]) and (a[0] + sum(b) + last) / 5 > (sum(a) + last) / 6:
            left += [(k, i, v / 100) for i, v in enumerate([*a, last])]
            right += [(k, i, v / 100) for i, v in enumerate([a[0], *b, last])]
    a0, b0 = ({c: [r[i] for r in rows] for i, c in enumerate(("user_id", "i", "v"))} for rows in (left, right))
    a0, b0 = pa.table(a0), pa.table(b0)
    body = ORACLES["similarity_quantiles"].split("sa as", 1)[1]
    want = dict(duckdb.sql("with sa as" + body).fetchall())
    a, b = (spark.createDataFrame(rows, "user_id long, i int, v double") for rows in (left, right))
    found = similarity.quantile_similarity(a, b, similarity.both(a, b, ["user_id"]), ["user_id"])
    got = {r["user_id"]: round(r["quantile_similarity"], 9) for r in found.collect()}
    assert len(want) > 20 and got == {k: round(float(v), 9) for k, v in want.items()}


def test_pairs_share_their_series(spark):
    """Scores by shared windows and counts are those of windows that are copied for each pair."""
    rng = random.Random(9)
    sizes = {"f": (0, 9), "g": (0, 9), "h": (0, 31), "x": (1, 30), "y": (1, 12), "z": (1, 4)}
    rows = [(s, name, i, float(rng.randrange(1, 6)) if name != "z" else rng.random()) for s in (0, 1) for name, (_, n) in sizes.items() for i in range(n + s)]
    series = spark.createDataFrame(rows, "session int, name string, i long, v double")
    pairs = spark.createDataFrame([(s, f, c) for s in (0, 1) for f in "fgh" for c in "xyz" if (f, c) != ("g", "y")], "session int, field string, column string")
    left, right = (series.where(F.col("name").isin(*names)) for names in ("fgh", "xyz"))
    own = ["session", "field", "column"]
    sides = [df.withColumnRenamed("name", n).join(pairs, ["session", n]).select(*own, "i", "v") for df, n in ((left, "field"), (right, "column"))]
    want = similarity.weighted_scores(*similarity.sliding_pairs(*sides, own), [*own, "window"])
    got = similarity.paired_scores(pairs, left, right, ["session"])
    assert sorted(got.columns) == sorted(want.columns)
    names = [c for c in want.columns if c not in (*own, "window")]
    want, got = ({tuple(r[c] for c in (*own, "window")): [r[c] for c in names] for r in df.collect()} for df in (want, got))
    assert want.keys() == got.keys() and len(want) > 60
    for k, values in want.items():
        assert all(a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(values, got[k])), (k, names, values, got[k])


def test_types_read_distinct_slices(spark):
    """Equal slices are one row with a count, and counts change no score."""
    rng = random.Random(10)
    rows = [(k % 2, k, bytes([65, 65, 65 + rng.randrange(2), rng.randrange(3)])) for k in range(200)]
    df = spark.createDataFrame(rows, "session int, seq int, payload binary")
    base = df.withColumns({"prev": F.col("payload"), "min_len": F.lit(4)})
    held = inference._slices(base, ["session"], 2).collect()
    assert sum(r["c"] for r in held) == 600 and len(held) <= 2 * (1 + 2 + 6)
    found = {(r["start"], r["field_type"], r["endian"]): r for r in inference.candidates(df.where("session = 0"), ["session"], "seq", [1, 2]).collect()}
    assert not found[(0, "UINT16", "big")]["is_dynamic"] and found[(2, "UINT16", "big")]["is_dynamic"]
    values = [r[2][2] * 256 + r[2][3] for r in rows if r[0] == 0]
    steps, width = np.diff(values), max(values) - min(values)
    low, high = np.quantile(values, [0.25, 0.75])
    score = (high - low) / width / (1 + np.std(steps) / width)
    spread = 0.2 if score >= 0.6 else 0.1 if score >= 0.4 else -0.05 if score >= 0.2 else -0.2

    def entropy(at):
        share = np.unique([r[2][at] for r in rows if r[0] == 0], return_counts=True)[1] / 100
        return round(float(-(share * np.log2(share)).sum()), 12)

    order = 0.3 if entropy(3) > entropy(2) else -0.15
    heuristic = min(1.0, max(0.0, 0.2 + 0.1 + order + spread))
    want = min(1.0, 0.35 + 0.65 * heuristic + (0 if heuristic > 0 else -0.15 / 2**0.5))
    assert math.isclose(found[(2, "UINT16", "big")]["confidence"], round(want, 9))


def test_odd_characters_are_counted(spark):
    texts = ["", "plain\n", "\x01\x02ab\x0b", "\x7f\x85\x9fé", "a\x0e\x80😀", "\x08" * 50, "x" * 30 + "\x01", "Ω\t\r\n"]
    found = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", binary.reasonable_share(F.col("t")).alias("s"))
    for k, share in found.collect():
        odd = sum(c in "\x0b\x0c" or "\x01" <= c <= "\x08" or "\x0e" <= c <= "\x1f" for c in texts[k])
        bad = sum("\x7f" <= c <= "\x9f" for c in texts[k])
        assert math.isclose(share, 1 - (odd / 2 + bad) / len(texts[k]) if texts[k] else 1.0)
