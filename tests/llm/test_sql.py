import glob
import os

import duckdb
import pytest

from spanloom.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = QUERIES[name](spark, FOLDER)
    cur = con.execute(SQL[name])
    order = [c[0] for c in cur.description]
    assert sorted(map(tuple, got.select(*order).collect())) == sorted(cur.fetchall())
