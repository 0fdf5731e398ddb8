"""Chunked windows must equal plain ones, also across chunk borders and with equal order values."""

import pandas as pd
import pytest

from spanloom.functions.ordered import Sequence, quantiles, rank_select


@pytest.fixture(scope="module")
def rows():
    import random

    rnd = random.Random(5)
    out = []
    for i in range(3000):
        key = "hot" if i % 3 else f"k{i % 40}"
        out.append((key, rnd.randrange(400), i, rnd.randrange(5), rnd.choice([None, i])))
    return pd.DataFrame(out, columns=["key", "t", "id", "v", "x"])


@pytest.mark.parametrize("min_rows", [10, 10**9])
def test_sequence(spark, rows, min_rows):
    df = spark.createDataFrame(rows.astype({"x": object}).where(rows.notna(), None), "key string, t int, id int, v int, x int")
    seq = Sequence(df, ["key"], ["t", "id"], min_rows=min_rows)
    assert seq.cut == (min_rows == 10)
    seq.prev(pid="id", pv="v").next(nid="id").number("n").number("back", reverse=True).running_sum("s", "v").last_seen("seen", "x")
    got = seq.done().toPandas().sort_values(["key", "t", "id"]).reset_index(drop=True)
    want = rows.sort_values(["key", "t", "id"]).reset_index(drop=True)
    g = want.groupby("key", sort=False)
    assert got["id"].tolist() == want["id"].tolist()
    same = lambda a, b: pd.testing.assert_series_equal(a.astype(float), b.astype(float), check_names=False)
    same(got["pid"], g["id"].shift(1))
    same(got["pv"], g["v"].shift(1))
    same(got["nid"], g["id"].shift(-1))
    same(got["n"], g.cumcount() + 1)
    same(got["back"], g.cumcount(ascending=False) + 1)
    same(got["s"], g["v"].cumsum())
    same(got["seen"], want.assign(f=g["x"].ffill()).groupby("key", sort=False)["f"].shift(1))


def test_order_statistics(spark, rows):
    df = spark.createDataFrame(rows[["key", "t"]])
    got = rank_select(df, ["key"], "t", {"a": lambda n: n - n + 1, "b": lambda n: n}).toPandas().set_index("key").sort_index()
    g = rows.groupby("key")["t"]
    assert (got["a"] == g.min()).all() and (got["b"] == g.max()).all() and (got["n"] == g.size()).all()
    q = quantiles(df, ["key"], "t", {"q05": 0.05, "q50": 0.5}).toPandas().set_index("key").sort_index()
    assert abs(q["q05"] - g.quantile(0.05)).max() < 1e-9
    assert abs(q["q50"] - g.quantile(0.5)).max() < 1e-9
