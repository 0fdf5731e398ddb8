"""Local outlier factors of all metrics against brute force on the smallest data."""

from collections import defaultdict

import numpy as np
import pytest

from spanloom.operators import groups as gr
from spanloom.plans import ENTRIES
from spanloom.plans.group_queries import values

D = "/root/testdata/sf0.001"


def brute(points, k):
    near = {}
    for i, x in points:
        near[i] = sorted((np.sqrt((y - x) ** 2), j) for j, y in points if j != i)[:k]
    far = {i: n[-1][0] for i, n in near.items() if n}
    density = {i: 1 / (np.mean([max(d, far[j]) for d, j in n]) + 1e-10) for i, n in near.items() if n}
    return {i: np.mean([density[j] for _, j in near[i]]) / density[i] for i in density}


def test_all_metrics_have_factors(spark):
    groups = defaultdict(list)
    for r in gr.finite(values(spark, D)).collect():
        groups[f"{r.group_id}|{r.metric}"].append((r.id, r.value))
    want = {(g, i): v for g, points in groups.items() for i, v in brute(points, 5).items()}
    got = {(r.grp, r.id): r.lof for r in ENTRIES["metric_outliers_lof_all"].run(spark, D).collect()}
    assert got.keys() == want.keys() and len({g.split("|")[1] for g, _ in got}) > 1
    assert [got[x] for x in want] == pytest.approx(list(want.values()), rel=1e-4, abs=1e-4)
