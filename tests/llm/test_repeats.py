import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

import spanloom.llm.repeats as P
from spanloom.llm.common import bytes_of
from spanloom.llm.repeats import anchored_runs, column_wise, drop_repeats

R = random.Random(8)


def some(n, letters="abcdefgh "):
    return "".join(R.choice(letters) for _ in range(n))


def brute(rows, length):
    """n_removed, spans and digest by row; rows in order."""
    seen, out = set(), []
    for _, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            w = raw[i:i + length]
            if w in seen:
                gone[i:i + length] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    parts = [some(R.randint(20, 260)) for _ in range(12)] + ["é漢𝒳" * 40, "-" * 300, "ab" * 150]
    rows = []
    for i in range(70):
        t = "".join(R.choice(parts) if R.random() < .6 else some(R.randint(1, 90)) for _ in range(R.randint(1, 7)))
        rows.append((i, t))
    shared = some(150)
    rows += [(100 + i, some(R.randint(5, 80)) + shared + some(R.randint(5, 80))) for i in range(60)]  # a passage that many share
    return rows + [(200 + i, rows[0][1]) for i in range(5)] + [(300, None), (301, ""), (302, "short")]


@pytest.mark.parametrize("length", [40, 100])
def test_like_brute_force(spark, monkeypatch, length):
    monkeypatch.setattr(P, "TOGETHER", 50)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, 2) for r in R.sample(rows, len(rows))], "doc_id long, text string, start int, place int").repartition(5)
    got = {r.doc_id: r for r in drop_repeats(docs, length=length, kept=True).collect()}
    assert len(got) == len(rows)
    for (k, t), want in zip(rows, brute(rows, length)):
        r = got[k]
        assert (r.n_removed, r.n_spans, r.kept_sha256) == want, k
        assert r.n_bytes == len((t or "").encode()) and hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


@pytest.mark.parametrize("length", [33, 40, 100])
def test_runs_cover_every_window_once_and_equal_windows_alike(length):
    texts = [t for _, t in corpus() if t][:60] + ["x" * 99, "-" * 500, "abc" * 100]
    raw, offsets = bytes_of(pa.array(texts))
    r = anchored_runs(raw, offsets, length)
    seen, covered = {}, 0
    for s, e, q, a, w in zip(*(r[c].tolist() for c in ("start", "end", "at", "anchor", "whole"))):
        assert s <= e <= q <= s + length - P.ANCHOR
        for p in range(s, e + 1):
            covered += 1
            window = raw[p:p + length].tobytes()
            assert seen.setdefault(window, (q - p, a)) == (q - p, a)
    assert covered == sum(max(0, len(t.encode()) - length + 1) for t in texts)


def test_column_wise_from_a_file_and_in_memory(spark, monkeypatch):
    monkeypatch.setattr(P, "IN_MEMORY", 0)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in drop_repeats(docs).collect()}
    assert [got[k] for k, _ in rows] == [x[0] for x in brute(rows, 100)]


def test_columns():
    texts = ["xxabcab", "yyabcab", "zaabcab", "xxabcaa"]
    columns = np.array([[ord(c) for c in t] for t in texts]).T
    row, c = column_wise(columns, np.zeros(4, int), np.arange(4), np.zeros(4, int), np.full(4, 3), 4)
    assert sorted(zip(row.tolist(), c.tolist())) == [(1, 2), (1, 3), (2, 2), (2, 3), (3, 0), (3, 1), (3, 2)]


def test_odd_rows(spark, odd):
    rows = sorted([(r.doc_id, r.text) for r in odd.collect()], key=lambda r: (r[0] is not None, r[0]))
    want = sorted((str(k), n, s, h) for (k, _), (n, s, h) in zip(rows, brute(rows, 100)))
    got = sorted((str(r.doc_id), r.n_removed, r.n_spans, r.kept_sha256) for r in drop_repeats(odd).collect())
    assert got == want
    assert drop_repeats(odd.limit(0)).count() == 0
    twice = odd.where("doc_id = 8").union(odd.where("doc_id = 8"))
    assert len({r.n_removed for r in drop_repeats(twice).collect()}) == 1
