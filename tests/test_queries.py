"""A cross-section of registered queries against their SQL oracle on the smallest data."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check
from spanloom.plans import ENTRIES
from spanloom.sources.fixtures import TABLES

D = "/root/testdata/sf0.001"
NAMES = [
    "application_overview", "agent_duration_percentiles", "first_exports", "graph_edges", "graph_bridges", "orphaned_edges",
    "period_averages", "group_list", "workflow_efficiency", "sampling_plan", "reasoning_timeline", "group_delta", "wl_graph_distance",
    "waterfall", "session_status_stream", "graph_upsert_edges",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_oracle(spark, con, name):
    ok, note, _ = check.compare(spark, con, name, D)
    assert ok, note


def test_every_entry_names_a_survey_line():
    assert all(e.lines for e in ENTRIES.values())
