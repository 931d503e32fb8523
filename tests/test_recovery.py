"""Row-driven decoding against struct, gates against all pairs, reports and the full weighted score against plain Python."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.operators import recovery, similarity

CODES = {"UINT8": "B", "INT8": "b", "UINT16": "H", "INT16": "h", "UINT32": "I", "INT32": "i", "UINT64": "Q", "INT64": "q", "FLOAT32": "f", "FLOAT64": "d"}


def expected(data, start, length, kind, endian):
    piece = data[start : start + length]
    if len(piece) < length:
        return None
    if kind in CODES:
        value = float(struct.unpack((">" if endian == "big" else "<") + CODES[kind], piece)[0])
        return round(value, 6) if kind == "FLOAT32" and math.isfinite(value) else round(value, 12) if kind == "FLOAT64" and math.isfinite(value) else value
    n = int.from_bytes(piece, endian)
    if length == 4:
        return n * 1000.0 if n <= 2524608000 else (n - 2208988800) * 1000.0
    if n <= 2524608000:
        return n * 1000.0
    if n <= 2524608000000:
        return float(n)
    stamp = (n // 2**32 - 2208988800) * 1000 + (n % 2**32) * 1000 // 2**32
    return float(stamp) if 0 <= stamp <= 2524608000000 else None


def test_numbers_of_any_type(spark):
    rng = random.Random(4)
    rows = []
    for k in range(600):
        kind = rng.choice([*CODES, "TIMESTAMP"])
        length = rng.choice([4, 8]) if kind == "TIMESTAMP" else struct.calcsize(CODES[kind])
        data = bytes(rng.randrange(256) for _ in range(rng.randint(6, 14)))
        if kind in ("FLOAT32", "FLOAT64"):
            data = b"\0" * 2 + struct.pack(("<" if k % 2 else ">") + CODES[kind], rng.choice([0.0, -1.5, rng.uniform(-1e4, 1e4), 2.0**-130, math.inf]))
        if kind == "TIMESTAMP" and length == 8:
            data = b"\0\0" + struct.pack("<Q" if k % 2 else ">Q", rng.choice([1_700_000_000, 1_700_000_000_123, (2208988800 + 1_600_000_000) << 32 | rng.randrange(2**32), 2**63]))
        rows.append((k, data, rng.choice([2, 2, 0, 9]) if kind not in ("FLOAT32", "FLOAT64", "TIMESTAMP") else 2, length, kind, "little" if k % 2 else "big"))
    df = spark.createDataFrame(rows, "k int, data binary, start int, length int, kind string, endian string")
    number = recovery.typed_number(*(F.col(c) for c in ("data", "start", "length", "kind", "endian")))
    for got in df.withColumn("v", number).collect():
        want = expected(bytes(got["data"]), got["start"], got["length"], got["kind"], got["endian"])
        assert (got["v"] is None) == (want is None) and (want is None or got["v"] == pytest.approx(want, rel=1e-12)), got


def test_texts(spark):
    rows = [(b"\x0a\x00\x01\xffabc", 0, 4, "IPV4", "10.0.1.255"), (b"\x0a\x00\x01\xff\x10\x20zz", 0, 6, "MAC_ADDRESS", "0a:00:01:ff:10:20"), ("né!".encode(), 0, 4, "UTF8_STRING", "né!"),
            (b"abc", 1, 2, "ASCII_STRING", "bc"), (b"\xff\x00", 0, 2, "BINARY", "ff00"), (b"ab", 1, 2, "BINARY", None), (b"ab", 0, 2, "UINT16", None)]
    df = spark.createDataFrame(rows, "data binary, start int, length int, kind string, want string")
    got = df.withColumn("v", recovery.typed_text(F.col("data"), F.col("start"), F.col("length"), F.col("kind"))).collect()
    assert all(r["v"] == r["want"] for r in got)


PROFILE = "session int, name string, kind string, n long, low double, high double, `values` long, repetition double"


def test_gates_let_every_possible_pair_through(spark):
    rng = random.Random(9)

    def series(prefix):
        out = []
        for k in range(60):
            low = rng.choice([0.0, -1.0, 1.0]) * rng.choice([0.0, 1e-9, 0.5, 3.0, 200.0, 1e12]) * rng.random()
            high = low + rng.choice([0.0, 1e-9, 1.0, 500.0]) * rng.random()
            kind = rng.choice(["int", "float", "text"])
            out.append((k % 3, f"{prefix}{k}", kind, 10, None if kind == "text" else low, None if kind == "text" else high, 1 if k % 11 == 0 else 5, 0.3))
        return out

    left, right = series("f"), series("c")
    pairs = recovery.candidate_pairs(spark.createDataFrame(left, PROFILE), spark.createDataFrame(right, PROFILE), ["session"], 0.1)
    want = {
        (a[0], a[1], b[1]) for a in left for b in right
        if a[0] == b[0] and a[2] == b[2] and a[6] > 1 and not (a[2] == "float" and a[5] < 1e-10)
        and (a[2] == "text" or (a[4] >= b[4] * 0.9 and a[5] <= b[5] * 1.1))
    }
    got = [(r["session"], r["field"], r["column"]) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_reports(spark):
    profiles = spark.createDataFrame(
        [(1, "a", "int", 9, 0.0, 9.0, 5, 0.3), (1, "b", "int", 9, 0.0, 9.0, 3, 0.95), (1, "c", "int", 9, 2.0, 2.0, 1, 1.0), (1, "d", "float", 9, 0.0, 1e-12, 4, 0.2), (1, "e", "text", 9, None, None, 4, 0.2)], PROFILE)
    scores = spark.createDataFrame([(1, "a", "x", 0.9), (1, "a", "y", 0.9), (1, "b", "x", 0.7), (1, "c", "x", 0.8), (1, "e", "z", 0.2)], "session int, field string, column string, score double")
    report = {r["field"]: r for r in recovery.field_report(scores, profiles, ["session"], 0.65).collect()}
    assert report["a"]["best_column"] == "x" and report["a"]["similarity"] == 0.9 and report["a"]["is_matched"]
    assert report["b"]["similarity"] == 0.65 and report["b"]["best_score"] == 0.7  # 0.7 - 0.15, clipped at the threshold
    assert all(report[k]["similarity"] == 0 and report[k]["is_constant"] and not report[k]["is_intersect"] for k in "cd")
    assert report["e"]["similarity"] == 0.65 and not report["e"]["is_matched"]
    summary = recovery.report_summary(recovery.field_report(scores, profiles, ["session"], 0.65), ["session"], 0.65).first()
    assert (summary["total_fields"], summary["scored_fields"], summary["matched_fields"]) == (5, 3, 1)
    assert summary["total_reward"] == pytest.approx((0.9 + 0.65 + 0.65) / 3) and summary["match_coverage"] == 0.2
    block = spark.createDataFrame([(1, "c"), (1, "b")], "session int, name string")
    report = {r["field"]: r for r in recovery.field_report(scores, profiles, ["session"], 0.65, block).collect()}
    assert report["c"]["similarity"] == pytest.approx(0.65) and report["c"]["is_intersect"] and report["a"]["similarity"] == 0 and not report["a"]["is_intersect"]


def measures(x, y):
    """All measures of two series and their weighted sum, from their definitions."""
    m = min(len(x), len(y))
    cosine = max(0.0, min(1.0, float(x[:m] @ y[:m] / (np.linalg.norm(x[:m]) * np.linalg.norm(y[:m])))))
    overlap = max(0.0, min(x.max(), y.max()) - max(x.min(), y.min())) / (max(x.max(), y.max()) - min(x.min(), y.min()))
    cv = math.exp(-abs(x.std() / x.mean() - y.std() / y.mean()))
    unit = lambda v: (v - v.min()) / (v.max() - v.min())
    bins = min(20, max(5, int(math.sqrt(len(x)))))
    p, q = (np.histogram(unit(v), bins=bins, range=(0, 1))[0] + 1e-10 for v in (x, y))
    p, q = p / p.sum(), q / q.sum()
    kl = math.exp(-float((p * np.log(p / q)).sum()))
    eps = min(0.1 * x.mean(), 0.1 * y.mean())
    near = np.mean([np.sort(np.abs(y - v))[:3].mean() <= eps for v in x])
    low, high = max(x.min(), y.min()), min(x.max(), y.max())
    inside = lambda v: v[(v >= low) & (v <= high)]
    quartiles = lambda v: np.quantile(inside(v), [0.25, 0.5, 0.75]) if len(inside(v)) else np.full(3, np.nan)
    quantile = np.mean(np.abs(quartiles(x) - quartiles(y)) <= eps) if low < high else 0.0
    a, b = unit(x), unit(y)
    cost = np.full((len(a) + 1, len(b) + 1), math.inf)
    cost[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            cost[i + 1, j + 1] = abs(a[i] - b[j]) + min(cost[i, j], cost[i, j + 1], cost[i + 1, j])
    dtw = math.exp(-3 * cost[-1, -1] / max(len(a), len(b)))
    return 0.15 * dtw + 0.15 * kl + 0.15 * cosine + 0.4 * (0.6 * near + 0.2 * overlap + 0.2 * quantile) + 0.15 * cv


def test_full_weighted_scores(spark):
    """Series of three and six values, short enough that multilevel warping is exact."""
    rng = np.random.default_rng(3)
    fields = {f"f{k}": rng.uniform(5, 20, 3) for k in range(4)}
    columns = {f"c{k}": rng.uniform(5, 20, n) for k, n in enumerate((3, 4, 6))}
    schema = "name string, i long, v double, text string"

    def series(named):
        return spark.createDataFrame([(n, i, float(x), None) for n, v in named.items() for i, x in enumerate(v)], schema)

    pairs = spark.createDataFrame([(f, c, "float") for f in fields for c in columns], "field string, column string, kind string")
    got = {(r["field"], r["column"]): r["score"] for r in recovery.pair_scores(pairs, series(fields), series(columns)).collect()}
    for (f, c), score in got.items():
        x, y = fields[f], columns[c]
        assert score == pytest.approx(measures(x, y), abs=1e-9), (f, c, similarity.WEIGHTS)
    assert len(got) == 12
