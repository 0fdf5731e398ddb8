"""Replicate weights against explicit resampling of rows and pairs."""

import hashlib
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanloom.operators import resampling as rs

REPLICATES, DRAWS = 40, 6


def number(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def replicates(ids):
    ordered = sorted(ids, key=lambda i: (number(i), i))
    for b in range(REPLICATES):
        yield [ordered[number(f"7|{d}") % len(ordered)] for d in range(b * DRAWS, (b + 1) * DRAWS)]


def interval(values):
    lo, hi = np.percentile(values, [2.5, 97.5])
    return [1 - np.mean(values), 1 - hi, 1 - lo]


def unit(x):
    n = np.linalg.norm(x)
    return x / n if n else x


def test_texts(spark):
    rng = np.random.default_rng(5)
    data = {f"s{i}": rng.normal(size=4) + [2, 0, 0, 0] for i in range(25)} | {"zero": np.zeros(4)}
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "s": list(data), "vector": [v.tolist() for v in data.values()]}), "g string, s string, vector array<double>")
    got = rs.text_consistency(df.union(df.where("s = 's1'").withColumn("g", F.lit("one"))), ["g"], "s", REPLICATES, DRAWS).collect()
    rows = {r.g: [r.consistency, r.ci_low, r.ci_high] for r in got}
    want = [1 - min(1, np.linalg.norm(sum(unit(data[i]) for i in ids)) / DRAWS) for ids in replicates(data)]
    assert rows["a"] == pytest.approx(interval(want)) and rows["one"] == pytest.approx([1, 1, 1])


def test_graphs(spark):
    rng = np.random.default_rng(6)
    data = {f"s{i}": rng.poisson(1, size=5) for i in range(12)} | {"none": np.zeros(5, int)}
    labels = [("a", s, f"l{j}", int(c)) for s, row in data.items() for j, c in enumerate(row) if c]
    graphs = spark.createDataFrame([("a", s) for s in data], "g string, s string")
    got = rs.graph_consistency(spark.createDataFrame(labels, "g string, s string, label string, c long"), graphs, ["g"], "s", REPLICATES, DRAWS).first()
    want = [np.mean([1 - unit(data[x]) @ unit(data[y]) for x, y in combinations(ids, 2)]) for ids in replicates(data)]
    assert [got.consistency, got.ci_low, got.ci_high] == pytest.approx(interval(want))
