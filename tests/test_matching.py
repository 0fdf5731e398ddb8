"""Matching in rounds against the serial greedy order."""

import random

import pytest

from spanloom.operators.matching import carried, greedy_matching


def serial(edges):
    cur, prev, out = set(), set(), set()
    for w, c, p in sorted((w, c, p) for c, p, w in edges):
        if c not in cur and p not in prev:
            cur.add(c)
            prev.add(p)
            out.add((c, p))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_take_what_a_serial_pass_takes(spark, seed):
    r = random.Random(seed)
    edges = list({(f"c{r.randrange(25)}", f"p{r.randrange(25)}"): r.randrange(6) / 10 for _ in range(150)}.items())
    edges = [(c, p, w) for (c, p), w in edges]
    got = greedy_matching(spark.createDataFrame(edges, "cur string, prev string, cost double")).collect()
    assert {(x.cur, x.prev) for x in got} == serial(edges) and len(got) == len(serial(edges))


def test_medoids_match_what_overlap_leaves(spark):
    members = "group_id string, session_key string"
    now = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("b", "4"), ("c", "5"), ("d", "6")], members)
    was = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "3"), ("y", "9"), ("z", "8")], members)
    vec = "group_id string, vector array<double>"
    new = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.1, 1.0]), ("d", [-1.0, 0.0])], vec)
    old = spark.createDataFrame([("x", [0.0, 1.0]), ("y", [0.0, 2.0]), ("z", [1.0, 0.01])], vec)
    got = {r.cur: (r.prev, round(r.jaccard, 6), None if r.distance is None else round(r.distance, 4)) for r in carried(now, was, new, old, block_rows=2).collect()}
    assert got == {"a": ("x", 1.0, None), "b": ("y", 0.333333, 0.0)}
    none = now.limit(0)
    assert carried(none, was, new.limit(0), old).count() == 0 and carried(now, none, new, old.limit(0)).count() == 0
