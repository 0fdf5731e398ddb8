"""Local outlier factors of numbers over their distinct values, against all pairs."""

import numpy as np
import pytest

from spanloom.operators import neighbours as nb


def brute(rows, k):
    """{id: lof} of one group from rows (id, value): every pair of different ids, nearest k, ties by id."""
    near, reach, density = {}, {}, {}
    for a in {i for i, _ in rows}:
        near[a] = sorted((abs(v - w), b) for i, v in rows if i == a for b, w in rows if b != a)[:k]
        reach[a] = max((d for d, _ in near[a]), default=0)
    for a, found in near.items():
        if found:
            density[a] = 1 / (np.mean([max(d, reach[b]) for d, b in found]) + 1e-10)
    return {a: np.mean([density[b] for _, b in found]) / density[a] for a, found in near.items() if found}


def data():
    rng = np.random.default_rng(8)
    few = [(f"a{i:03d}", float(v)) for i, v in enumerate(rng.integers(0, 9, 120))]
    many = [(f"b{i:03d}", float(v)) for i, v in enumerate(np.round(rng.exponential(3, 150), 2))]
    even = [(f"c{i:03d}", float(i) / 4) for i in rng.permutation(40)]
    return {"few": few, "many": many, "even": even, "two": [("x", 1.0), ("y", 5.0)], "one": [("z", 1.0)], "twice": [*few[:20], *few[:5], ("a000", 40.0)]}


@pytest.mark.parametrize("k, piece", [(5, 7), (20, 8192)])
def test_same_as_all_pairs(spark, k, piece):
    groups = data()
    df = spark.createDataFrame([(g, i, [v]) for g, rows in groups.items() for i, v in rows], "g string, id string, vector array<double>")
    near = nb.group_neighbours(df, "g", k, piece=piece)
    got = {(r.g, r.id): r.lof for r in nb.local_outlier_factor(near, "g", k, piece=piece).collect()}
    want = {(g, i): lof for g, rows in groups.items() for i, lof in brute(rows, k).items()}
    assert got.keys() == want.keys()
    for at, lof in want.items():
        assert got[at] == pytest.approx(lof, rel=1e-9), at


def test_equal_rows_are_one(spark):
    """Ten values, however many rows: no row a pair of rows is made."""
    df = spark.range(4000).selectExpr("'g' AS g", "concat('r', id) AS id", "array(cast(id % 10 AS double)) AS vector")
    near = nb.group_neighbours(df, "g", 5)
    assert near.pairs is None and near.line.count() == 10
    assert nb.local_outlier_factor(near, "g", 5).where("abs(lof - 1) < 1e-9").count() == 4000
