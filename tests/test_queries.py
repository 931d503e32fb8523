"""Registered queries against their SQL on the smallest tables.

All queries but a few heavy ones run (TRACELODE_ALL=1 adds these); those with ordered scans also take the paths for hot groups."""

import os

import pytest
from oracle import compare, connect

from tracelode.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
# These take half a minute each even on the smallest tables; a query over the same plan stands for them by default.
HEAVY = {"system_alarms", "alarm_events", "pair_calibration", "field_reports", "field_report_summary", "session_solution_scores", "ranked_fields"}
NAMES = [name for name in ORACLES if os.environ.get("TRACELODE_ALL") or name not in HEAVY]
SCANS = [
    "sessionize_gap", "stream_sessions", "asof_backward", "downsample_rate", "or_fusion", "acf_by_lag", "arrival_sessions", "window_totals", "window_of_point",
    "columns_changing_in_windows", "resample_limit_null",
]


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    problems, _, _ = compare(spark, duck, FOLDER, QUERIES[name], ORACLES[name])
    assert not [p for p in problems if p != "no rows"]


@pytest.mark.parametrize("name", SCANS)
def test_hot_group_paths_match_sql(chunked, duck, name):
    problems, _, _ = compare(chunked, duck, FOLDER, QUERIES[name], ORACLES[name])
    assert not problems


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_name_unions_reduce_before_they_collect(spark, duck):
    problems, _, _ = compare(spark, duck, FOLDER, QUERIES["name_unions"], ORACLES["name_unions"])
    plan = QUERIES["name_unions"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert not problems and "collect_list" in plan and plan.index("collect_list") < plan.index("min(struct(event_id")
