import re
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from spanloom.llm.runs import RunLimits, op12_runs, periodic_runs, run_report

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, limits=RunLimits()):
    found = []
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            part = w[i:i + size]
            if size >= limits.length(q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                found.append((i, size, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute(key, text, alter=False):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(key).encode()) if alter and key is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None,) * 3
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (key, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha256(lines.encode()).hexdigest(),
            sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4), st.sampled_from([RunLimits(), RunLimits(2, 3), RunLimits(17, 3), RunLimits(9, 5)]))
def test_runs_like_brute_force(docs, limits):
    x = np.array([v for d in docs for v in d], np.int64)
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(int)
    want = [(first[i] + s, n, q) for i, d in enumerate(docs) for s, n, q in brute_runs(d, limits)]
    assert list(zip(*(v.tolist() for v in periodic_runs(x, doc, limits)))) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 9), st.integers(0, 8)), min_size=1, max_size=6))
def test_nested_and_touching_runs(parts):
    x = [v for p, times, cut in parts for v in (p * times)[:len(p) * times - min(cut, len(p))]]
    got = periodic_runs(np.array(x * 3, np.int64), np.zeros(3 * len(x), np.int64))
    assert list(zip(*(v.tolist() for v in got))) == brute_runs(x * 3)


def test_two_periods_are_not_enough():
    with pytest.raises(ValueError):
        periodic_runs(np.zeros(3, np.int64), np.zeros(3, np.int64), RunLimits(6, 2))


def test_long_run_and_long_period():
    rng = np.random.default_rng(5)
    block = rng.integers(0, 1 << 40, 5000)
    x = np.concatenate([np.zeros(200_000, np.int64), np.tile(block, 5), rng.integers(1 << 41, 1 << 42, 1000)])
    got = periodic_runs(np.unique(x, return_inverse=True)[1], np.zeros(len(x), np.int64))
    assert list(zip(*(v.tolist() for v in got))) == [(0, 200_000, 1), (200_000, 25_000, 5000)]


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()), key=str)


def test_odd_rows(spark, odd):
    some = odd.where("doc_id IS NULL OR doc_id <> 9")
    assert rows(run_report(some)) == sorted((brute(r.doc_id, r.text) for r in some.collect()), key=str)
    long = run_report(odd.where("doc_id = 9")).collect()[0]
    assert (long.n_runs, long.start, long.length, long.period, long.exponent_milli) == (1, 0, 3000, 1, 3_000_000)
    assert long.collapsed_sha256 == sha256(b"ab").hexdigest()
    assert run_report(odd.limit(0)).count() == 0


def test_texts_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "x " + "a b c " * 4 + "y", 7, "h")], "doc_id long, text string, n_runs int, k string")
    got = run_report(docs.withColumn("t", F.lit(1)).withColumn("h", F.lit(0)), texts=True).collect()[0]
    assert [tuple(r) for r in got.runs] == [(1, 12, 3)] and got.collapsed == "x a b c y" and got.n_runs == 1


def test_query_like_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    made = [(i, " ".join(f"w{v}" for v in rng.integers(0, 40, int(rng.integers(0, 120))))) for i in range(300)] + [(None, "a " * 9), (300, None), (7, "a " * 9)]
    spark.createDataFrame(made, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(op12_runs(spark, str(tmp_path)))
    assert got == sorted((brute(k, t, True) for k, t in made), key=str)
    assert sum(r[1] > 0 for r in got) > 15
