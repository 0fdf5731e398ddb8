"""Graphs in one pass against joins round by round, and against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import groups as gr
from spanloom.operators import packed as pk

KEYS = ["app", "s"]


def graphs():
    """{(app, session): (agents by node, edges)}: chains, a loop, a single node, and graphs that are not plain."""
    rng = np.random.default_rng(9)
    out = {("a", f"c{i}"): ({n: f"x{rng.integers(3)} y" for n in range(rng.integers(1, 9))}, None) for i in range(12)}
    out = {k: (nodes, [(n, n + 1) for n in range(len(nodes) - 1)]) for k, (nodes, _) in out.items()}
    out["b", "loop"] = ({1: "x", 2: "y"}, [(1, 2), (2, 1)])
    out["b", "none"] = ({1: "x", 2: None, 3: "x"}, [(1, 2), (2, 3), (3, 9)])
    out["b", "fork"] = ({1: "x", 2: "y", 3: "y", 4: "z"}, [(1, 2), (1, 3), (2, 4), (3, 4)])
    out["b", None] = ({1: "x", 2: "y"}, [(1, 2)])
    return out


def frames(spark):
    data = graphs()
    nodes = [(*k, n, a) for k, (agents, _) in data.items() for n, a in agents.items()] + [("b", "twice", 1, "x"), ("b", "twice", 1, "y"), ("b", "twice", 2, "x")]
    edges = [(*k, i, j) for k, (_, found) in data.items() for i, j in found] + [("b", "twice", 1, 2), ("b", "twice", 2, 1)]
    return spark.createDataFrame(nodes, "app string, s string, node bigint, agent string"), spark.createDataFrame(edges, "app string, s string, src bigint, dst bigint")


def by_joins(monkeypatch, call):
    """The same with no graph taken as plain."""
    real = pk.Graphs.__init__

    def odd(self, table, keys):
        real(self, table, keys)
        self.odd = np.arange(len(self.row))
        self.graph, self.next, self.value = self.graph[:0], self.next[:0], self.value[:0]

    monkeypatch.setattr(gr, "per_graph", lambda n, e, k, *a: (lambda out: (out[0].limit(0), n.select(*k).distinct()))(pk.per_graph(n, e, k, *a)))
    return call()


def rows(df, *columns):
    return Counter((r.app, r.s, *(r[c] for c in columns)) for r in df.collect())


def test_labels(spark, monkeypatch):
    nodes, edges = frames(spark)
    got = rows(gr.wl_labels(nodes, edges, KEYS, 3).withColumn("length", F.round("length", 9)), "label", "c", "length")
    assert got == rows(by_joins(monkeypatch, lambda: gr.wl_labels(nodes, edges, KEYS, 3).withColumn("length", F.round("length", 9))), "label", "c", "length")


def test_plain_graphs_need_no_round(spark, monkeypatch):
    """No join a round and nothing kept of one: the tables of all rounds were what filled the disk."""
    nodes, edges = (df.where("app = 'a'") for df in frames(spark))
    monkeypatch.setattr(gr, "cut_lineage", lambda df: pytest.fail("a round was written"))
    assert gr.path_tokens(nodes, edges, KEYS).count() and gr.wl_labels(nodes, edges, KEYS).count()


def test_distance_with_and_without_lengths(spark):
    nodes, edges = frames(spark)
    labels = gr.wl_labels(nodes, edges, KEYS)
    shown = lambda df: {r.app: (r.n, round(r.distance, 9)) for r in gr.mean_graph_distance(df, nodes, ["app"], "s").collect()}
    assert shown(labels) == shown(labels.drop("length"))


def test_path_tokens(spark, monkeypatch):
    nodes, edges = frames(spark)
    got = rows(gr.path_tokens(nodes, edges, KEYS, 4), "token", "c")
    assert got == rows(by_joins(monkeypatch, lambda: gr.path_tokens(nodes, edges, KEYS, 4)), "token", "c")
    agents, _ = graphs()["a", "c3"]
    names = [a.replace(" ", "_") for a in agents.values()]
    want = Counter("__".join(names[i : i + n]) for n in range(1, 5) for i in range(len(names) - n + 1))
    assert {t: c for (_, s, t, c) in got if s == "c3"} == dict(want)
    assert ("b", "fork", "x__y__z", 2) in got


@pytest.mark.parametrize("most", [3, 30])
def test_long_graphs_go_by_joins(spark, most):
    nodes, edges = (df.where("app = 'a'") for df in frames(spark))
    made = lambda found: (found.graph, {"v": found.value})
    done, odd = pk.per_graph(nodes.repartition(1), edges, KEYS, F.col("agent"), made, "v string", "t", 2, most)
    size = {k: 2 * len(n) - 1 for k, (n, _) in graphs().items() if k[0] == "a"}
    named = {(r.app, r.s) for r in odd.collect()} if odd else set()
    assert named <= {k for k in size if size[k] > most} and {(r.app, r.s) for r in done.collect()} == set(size) - named
