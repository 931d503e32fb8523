"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tracelode.queries import QUERIES  # noqa: E402
from tracelode.session import build_session  # noqa: E402

HEADLINE = (
    "acf_by_lag", "sessionize_gap", "stream_sessions", "ngram_greedy_rate", "downsample_rate", "fixed_period_chunks", "byte_entropy",
    "dynamic_blocks", "decode_signed", "modbus_headers", "column_profile", "monotonic_flags", "asof_nearest", "window_value_match",
    "resample_interp", "normalize_robust", "similarity_precision3", "flow_features33", "window_confusion", "or_fusion", "alarm_hold",
    "confusion_rollup", "fit_metrics", "subset_vote_search",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["fit_metrics"](spark, folder).collect()  # JVM warm-up outside the timing
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
