"""Fixtures shared by the tests of the training-data operators."""

import random

from pyspark.sql import types as T

# Columns whose names the operators use inside, to see that they are left alone.
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("n", T.LongType()), T.StructField("cls", T.StringType()), T.StructField("doc", T.StringType()),
    T.StructField("spans", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_chars", T.LongType()),
])
BIG = 2**60 + 1  # an id that a double cannot hold


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(("ka", "lo", "mi", "ru", "te", "so", "an")) for _ in range(rng.randint(1, 4))) for _ in range(words))


def rows():
    """Nulls, empty, short and very long texts, copies, near copies, repeated rows and shared passages."""
    passage = prose(1, 60)
    base = prose(2, 120)
    near = base.split()
    near[60] = "changed"
    texts = [
        (5, base), (7, base), (3, " ".join(near)), (11, None), (12, ""), (13, "   \n\t "), (14, "one two"), (15, "one two"), (15, "one two"),
        (16, passage + " " + prose(3, 50)), (17, prose(4, 40) + " " + passage), (18, "x" * 5000), (19, "x" * 5000 + "y"), (None, base), (BIG, prose(5, 30)),
        (BIG + 1, prose(6, 20_000)), (20, "a\x00b é 中文 " * 30), (21, "ONE two three four five"), (22, "one TWO three four five"),
    ]
    return [(i, t, None, 1, "c", "d", "s", 0.5, len(t) if t is not None else None) for i, t in texts]


def table(spark, data=None, parts: int = 3):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(parts)
