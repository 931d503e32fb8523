import random

from tracelode.operators import periods
from tracelode.operators.patterns import positions
from tracelode.operators.sessions import token_dictionary

LOOSE = periods.PeriodConfig(autocorr_threshold=0.05, max_lag=12, min_segments=2, similarity_threshold=0.5, time_jitter_ratio=5.0, coverage_threshold=0.2)


def test_short_sessions_without_pieces_as_with_pieces(spark):
    rng = random.Random(8)
    rows = [(s, i, i * 1_000_000 + rng.randrange(1000), rng.choice(["C-a", "C-b", "S-c"]) if rng.random() < 0.3 else ["C-a", "S-c", "C-b", "S-d"][i % 4]) for s in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "session int, n long, ts long, token string")
    words = token_dictionary(df, ["session"], "token")
    coded = df.join(words, ["session", "token"])
    lags = periods.peaks(periods.autocorrelation(positions(coded, ["session"], ["n"]), ["session"], "token_id", 12), ["session"], 0.05)

    def table(direct):
        stats, bases = periods.segment_table(coded, ["session"], ["n"], "ts", "token", lags, LOOSE, direct)
        named = periods.named_bases(stats, bases, words, ["session"], "token")
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in named.select(sorted(named.columns)).collect()), named

    whole, frame = table(1_000)
    pieces, _ = table(0)
    mixed_base = {r["base"] for r in frame.collect()}
    assert whole == pieces and len(whole) > 20 and all(b.startswith("C-") for b in mixed_base)
