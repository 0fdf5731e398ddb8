from spanloom.operators.traverse import closure
from spanloom.operators.views import subtree_bounds


def test_deep_chain_and_equal_ids_in_two_sessions(spark):
    rows = [("s", i, i - 1 if i else None, 100 - i, i) for i in range(70)] + [("t", 0, None, 5, 5), ("t", 1, 0, 4, 9)]
    df = spark.createDataFrame(rows, "session_id string, span_id int, up int, a int, b int")
    got = {(r.session_id, r.span_id): (r.a, r.b) for r in subtree_bounds(df, ["session_id", "span_id"], "up").collect()}
    assert got == {("s", i): (31, 69) for i in range(70)} | {("t", 0): (4, 9), ("t", 1): (4, 9)}


def test_circle_ends(spark):
    df = spark.createDataFrame([("s", 0, 1, 1, 1), ("s", 1, 2, 2, 2), ("s", 2, 0, 3, 3)], "session_id string, span_id int, up int, a int, b int")
    assert {(r.a, r.b) for r in subtree_bounds(df, ["session_id", "span_id"], "up").collect()} == {(1, 3)}


def test_closure_has_no_bound(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(60, 0)], "p int, c int")
    got = closure(chain, "p", "c")
    assert got.count() == 61 * 61 and got.where("depth <> CASE WHEN descendant > ancestor THEN descendant - ancestor ELSE descendant - ancestor + 61 END").count() == 0
    assert closure(chain, "p", "c", max_hops=5).count() == 61 * 5
