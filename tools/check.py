"""Run registered queries on Spark and their oracles on DuckDB, and compare.

usage: python tools/check.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spanloom.plans import ENTRIES  # noqa: E402
from spanloom.session import build_session  # noqa: E402
from spanloom.sources.fixtures import TABLES  # noqa: E402


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        return f"{round(v, 6):.6f}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return f"{v:.6f}"
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "tzinfo") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, d):
    e = ENTRIES[name]
    t0 = time.time()
    df = e.run(spark, d)
    cols = df.columns
    if len(set(cols)) != len(cols):
        return False, f"duplicate columns {cols}", 0.0
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    if e.sql is None:
        return len(got) > 0, f"rows only: {len(got)}", took
    cur = con.execute(e.sql)
    want_cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(want_cols):
        return False, f"columns {sorted(cols)} != {sorted(want_cols)}", took
    types = dict(zip(want_cols, [str(c[1]) for c in cur.description]))
    a, b = rows_of(cols, got), rows_of(want_cols, want)
    if a != b:
        only_a = [x for x in a if x not in set(b)][:3]
        only_b = [x for x in b if x not in set(a)][:3]
        return False, f"{len(a)} vs {len(b)} rows; cols {sorted(cols)}; spark-only {only_a}; oracle-only {only_b}", took
    huge = [c for c, t in types.items() if "HUGEINT" in t or "DECIMAL" in t]
    note = f" (oracle types to tidy: {huge})" if huge else ""
    return True, f"{len(a)} rows" + (" EMPTY" if not a else "") + note, took


def main(argv):
    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2 :]
    d = f"/root/testdata/sf{sf}"
    names = [n for n in ENTRIES if not argv or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    cores = os.environ.get("CORES", "8")
    spark = build_session(master=f"local[{cores}]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    bad = 0
    for n in names:
        try:
            ok, note, took = compare(spark, con, n, d)
        except Exception as exc:  # report and go on
            ok, note, took = False, f"{type(exc).__name__}: {str(exc)[:600]}", 0.0
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {n} {took:.1f}s {note}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree", flush=True)
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
