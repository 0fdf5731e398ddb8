"""Trajectory files as lines, arrays and envelopes, and what makes a file unusable."""

import json

from spanloom.sources.readers import read_trajectories, trajectory_conflicts

SPANS = [
    {"SpanId": "a", "SpanName": "x.agent", "Timestamp": "2025-01-01 00:00:00", "SessionId": "s1", "SpanAttributes": {"k": "v"}},
    {"span_id": "b", "name": "y.tool", "timestamp": "2025-01-01 00:00:01", "attributes": {"session.id": "s1"}},
    {"span_id": "c", "name": "z", "timestamp": "", "ResourceAttributes": {"session.id": "s1"}},
]
WANT = [("a", "x.agent", "s1"), ("b", "y.tool", "s1"), ("c", "z", "s1")]


def rows(df):
    return sorted(map(tuple, df.select("span_id", "span_name", "session_id").collect()))


def test_layouts(spark, tmp_path):
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "f.json").write_text("\n".join(map(json.dumps, SPANS)) + "\n\n")
    (tmp_path / "array.json").write_text(json.dumps(SPANS, indent=1))
    (tmp_path / "held.json").write_text(json.dumps({"meta": 1, "spans": SPANS}, indent=1))
    assert rows(read_trajectories(spark, f"{tmp_path}/lines")) == WANT
    assert rows(read_trajectories(spark, f"{tmp_path}/array.json", "array")) == WANT
    assert rows(read_trajectories(spark, f"{tmp_path}/held.json", "envelope")) == WANT
    assert trajectory_conflicts(read_trajectories(spark, f"{tmp_path}/array.json", "array")).count() == 0


def test_conflicts(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps([*SPANS, SPANS[0] | {"SessionId": "s2"}]))
    found = trajectory_conflicts(read_trajectories(spark, f"{tmp_path}/one.json", "array")).collect()
    assert sorted((r.problem, r.detail) for r in found) == [("duplicate span", "a"), ("mixed sessions", "s1 / s2")]
