"""Runs registered queries next to their DuckDB SQL and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if isinstance(value, decimal.Decimal):
        return repr(float(value))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(row[i]) for i in order) for row in rows)


def compare(spark, con, folder: str, query, sql: str):
    start = time.time()
    df = query(spark, folder)
    left_columns = df.columns
    left = rows_of(left_columns, [tuple(r) for r in df.collect()])
    spent = time.time() - start
    cursor = con.execute(sql)
    right_columns = [c[0] for c in cursor.description]
    right = rows_of(right_columns, cursor.fetchall())
    problems = []
    if sorted(left_columns) != sorted(right_columns):
        problems.append(f"columns {sorted(left_columns)} vs {sorted(right_columns)}")
    if len(left) != len(right):
        problems.append(f"rows {len(left)} vs {len(right)}")
    if not left:
        problems.append("no rows")
    if left != right:
        only_left = [r for r in left if r not in set(right)][:3]
        only_right = [r for r in right if r not in set(left)][:3]
        if only_left or only_right:
            problems.append(f"values\n   spark {only_left}\n   sql   {only_right}")
    return problems, len(left), spent


def main(argv):
    sys.path.insert(0, ".")
    from tracelode.queries import ORACLES, QUERIES
    from tracelode.session import build_session

    folder = argv[0]
    names = argv[1:] or list(QUERIES)
    if names and names[0].startswith("@"):
        family = names[0][1:]
        names = [n for n, q in QUERIES.items() if q.__module__.endswith("." + family)]
    extra = {}
    if os.environ.get("TRACELODE_CHUNKED"):  # force the paths meant for hot groups
        extra = {"spark__tracelode__maxGroupRows": "40", "spark__tracelode__chunkRows": "16"}
    if os.environ.get("TRACELODE_NO_BROADCAST"):
        extra["spark__tracelode__maxBroadcastRows"] = "0"
    spark = build_session("8", **extra)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        try:
            if name in ORACLES:
                problems, n, spent = compare(spark, con, folder, QUERIES[name], ORACLES[name])
            else:
                start = time.time()
                n = len(QUERIES[name](spark, folder).collect())
                problems, spent = ([] if n else ["no rows"]), time.time() - start
        except Exception as error:  # report and go on with the next query
            problems, n, spent = [f"{type(error).__name__}: {str(error)[:900]}"], -1, 0.0
        bad += bool(problems)
        kind = "sql " if name in ORACLES else "rows"
        print(f"{'FAIL' if problems else 'ok  '} {kind} {name:32s} rows={n} {spent:.2f}s", *problems, flush=True)
    print(f"{len(names) - bad} of {len(names)} good")


if __name__ == "__main__":
    main(sys.argv[1:])
