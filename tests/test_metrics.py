"""Hand-made cases for metrics that are easy to get wrong at the edges."""

import pytest
from pyspark.sql import functions as F

from spanloom.operators import groups as gr
from spanloom.operators import metrics as m
from spanloom.operators import session_metrics as sm
from spanloom.operators import trajectory as tr
from spanloom.sources import sinks as sk
from spanloom.streaming import jobs


def steps(spark, *sessions):
    rows = [(f"s{i}", n, a, f"x{n}") for i, seq in enumerate(sessions) for n, a in enumerate(seq)]
    return spark.createDataFrame(rows, "session_key string, idx int, agent string, signature string")


@pytest.mark.parametrize("seq,want", [("ABAB", 1), ("ABABAB", 2), ("ABC", 0), ("AAAA", 1), ("ABCABCX", 1), ("", 0)])
def test_count_cycles(seq, want):
    assert sm.count_cycles([ord(c) for c in seq]) == want


def test_cycles_and_efficiency(spark):
    df = steps(spark, "ABAC", "ABABAB", "A")
    got = {r["session_key"]: r["cycles"] for r in sm.cycles(df, ["session_key"], ["idx"]).collect()}
    assert got == {"s0": 0, "s1": 2, "s2": 0}
    eff = {r["session_key"]: r["efficiency"] for r in sm.workflow_efficiency(df, ["session_key"], ["idx"]).collect()}
    assert eff == {"s0": 1.0, "s1": 0.4, "s2": 0.0}


@pytest.mark.parametrize("values,want", [([5, 7, 9], 4.0), ([5, 9, 2, 4], 8.0), ([5, 9, 2, 4, 1], 9.0), ([3], 0.0)])
def test_counter_totals(spark, values, want):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], "agent string, t int, v double")
    assert m.counter_totals(df, ["agent"], ["t"], "v").first()["total"] == want
    assert m.counter_totals(df, ["agent"], ["t"], "v", min_rows=0).first()["total"] == want


def test_equal_or_few_values_have_no_outliers(spark):
    rows = [("same", str(i), 4.0) for i in range(9)] + [("one", "a", 1.0)] + [("wide", str(i), float(i % 3)) for i in range(30)] + [("wide", "far", 99.0), ("wide", "nan", float("nan"))]
    df = spark.createDataFrame(rows, "g string, id string, value double")
    for found in (gr.robust_outliers(df, ["g"]), gr.isolation_outliers(df, ["g"])):
        out = {(r["g"], r["id"]) for r in found.where("outlier").collect()}
        assert ("wide", "far") in out and not {g for g, _ in out} - {"wide"}


def test_normal_ranges(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 5]], "g string, value double")
    r = gr.normal_ranges(df, ["g"]).first()
    assert r["mean"] == 3 and abs(r["g_upper"] - (3 + 2 * 2**0.5)) < 1e-9 and abs(r["q_lower"] - 1.2) < 1e-9


def test_work_outcome(spark):
    cases = {"": "no_response", "I can't access it": "declined", "We will wait": "waiting", "ok": "completed", '{"error": "x"}': "failed"}
    df = spark.createDataFrame([(k,) for k in cases], "r string")
    got = {r["r"]: r["o"] for r in df.select("r", tr.work_outcome(F.col("r"), F.lit(False)).alias("o")).collect()}
    assert got == cases


def test_merge_properties_keeps_what_the_batch_leaves_out(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, t string")
    new = spark.createDataFrame([("a", None, "z"), ("c", 3, None)], "id string, n int, t string")
    got = sorted(tuple(r) for r in sk.merge_properties(old, new, ["id"]).collect())
    assert got[0] == ("a", 1, "z") and got[1] == ("b", 2, "y") and got[2][:2] == ("c", 3)


def test_tool_edges_follow_the_stack(spark):
    ev = [("topology.node.started", "a", ""), ("topology.node.started", "b", ""), ("tool.started", "", "t1"), ("topology.node.completed", "b", ""),
          ("tool.started", "", "t2"), ("topology.node.completed", "a", ""), ("tool.started", "", "t3")]
    df = spark.createDataFrame([("s", n, a, t, i, i) for i, (n, a, t) in enumerate(ev)], "session_key string, event_name string, agent string, tool string, ts int, event_id int")
    assert sorted((r["agent"], r["tool"]) for r in jobs.tool_edges(df).collect()) == [("a", "t2"), ("b", "t1")]


def test_refused_when_the_group_changed(spark):
    members = spark.createDataFrame([("g", "s1")], "group_id string, session_key string")
    hashes = gr.content_hashes(members)
    asked = hashes.select("group_id", F.lit("s2").alias("session_key"), "hash").unionByName(
        hashes.select("group_id", F.lit("s3").alias("session_key"), F.lit("old").alias("hash")))
    kept, refused = jobs.attach_sessions(members, hashes, asked)
    assert sorted(r["session_key"] for r in kept.collect()) == ["s1", "s2"]
    assert [r["session_key"] for r in refused.collect()] == ["s3"]
