"""Sessions by arrival and windows of any shape against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tracelode.operators import sessions, sweep


def first_matches(times, limit):
    latest, out = [], []
    for t in times:
        for k, last in enumerate(latest):
            if t - last <= limit:
                latest[k] = t
                break
        else:
            k = len(latest)
            latest.append(t)
        out.append(k + 1)
    return out


@pytest.mark.parametrize("rows", ["2000000", "6"])
def test_sessions_by_arrival(spark, rows):
    spark.conf.set("spark.tracelode.maxGroupRows", rows)
    spark.conf.set("spark.tracelode.chunkRows", "5")
    try:
        rng = random.Random(1)
        series = {"given": [0, 200, 90, 290], "one": [5], "same": [7] * 9, "falling": [900, 500, 100, 650, 2000, 1990]}
        series["mixed"] = [int(k * 60 - rng.choice([0, 0, 0, 150, 400]) + (k // 9) * 300) for k in range(40)]
        data = [(name, i, t) for name, times in series.items() for i, t in enumerate(times)] + [(None, i, t) for i, t in enumerate((0, 300, 10))]
        df = spark.createDataFrame(data, "k string, i int, t long").repartition(3)
        got = {(r["k"], r["i"]): r["session_no"] for r in sessions.arrival_sessions(df, ["k"], "t", ["i"], 100).collect()}
        series[None] = [0, 300, 10]
        assert [got["given", i] for i in range(4)] == [1, 2, 1, 2]
        assert got == {(k, i): s for k, times in series.items() for i, s in enumerate(first_matches(times, 100))}
    finally:
        spark.conf.unset("spark.tracelode.maxGroupRows")
        spark.conf.unset("spark.tracelode.chunkRows")


def test_windows_of_any_shape(spark):
    rng = random.Random(2)
    points = [(rng.choice("ab"), rng.randrange(60), rng.choice([None, 1, 2, 5])) for _ in range(80)]
    windows = [(rng.choice("abc"), k % 7, s := rng.randrange(70), s + rng.choice([-3, 0, 1, 5, 30, 90])) for k in range(50)]
    windows += windows[:5]  # repeated windows stay apart
    p = spark.createDataFrame(points, "k string, t int, v int")
    w = spark.createDataFrame(windows, "k string, name int, s int, e int")
    got = sorted(map(tuple, sweep.totals_in_windows(p, w, ["k"], "t", "s", "e", {"n": F.lit(1), "total": F.col("v")}).collect()))
    inside = lambda q, x, closed: q[0] == x[0] and (x[2] <= q[1] <= x[3] if closed else x[2] <= q[1] < x[3])
    assert got == sorted((*x, sum(inside(q, x, False) for q in points), sum(q[2] or 0 for q in points if inside(q, x, False))) for x in windows)
    flags = {tuple(r)[:4]: tuple(r)[4:] for r in sweep.changing_in_windows(p, w, ["k"], "t", "s", "e", ["v"]).collect()}
    for x in windows:
        own = [q for q in points if inside(q, x, True)]
        if x[2] <= x[3]:
            assert flags[x] == (len(own), len({q[2] for q in own} - {None}) > 1)
    found = sweep.latest_window(p.distinct(), w, ["k"], "t", "s", "e", "hit", ["s", "name"]).collect()
    for r in found:
        started = [x for x in windows if x[0] == r["k"] and x[2] <= r["t"]]
        last = max(started, key=lambda x: (x[2], x[1])) if started else None
        ends = [x[3] for x in started if last and (x[2], x[1]) == (last[2], last[1])]
        want = (last[2], last[1]) if last and max(ends) > r["t"] else None
        assert (tuple(r["hit"]) if r["hit"] else None) == want or (len(set(ends)) > 1)
