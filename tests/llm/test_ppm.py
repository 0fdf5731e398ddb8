import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.llm.ppm import Ppm, PpmSettings, adaptive_length, score_texts, windows


def lines(texts, order):
    return [bytes([0xFE]) * order + t.encode() + b"\xff" for t in texts]


def trained(texts, order):
    seen: dict = {}
    for line in lines(texts, order):
        for i in range(order, len(line)):
            for d in range(order + 1):
                seen.setdefault(line[i - d:i], Counter())[line[i]] += 1
    return seen


def brute(seen, text, order):
    total = 0.0
    for line in lines([text], order):
        for i in range(order, len(line)):
            excluded: set = set()
            for d in range(order, -1, -1):
                kinds = seen.get(line[i - d:i])
                open_ = {s: c for s, c in (kinds or {}).items() if s not in excluded}
                if not open_:
                    continue
                whole = sum(open_.values()) + len(open_)
                if line[i] in open_:
                    total += math.log10(open_[line[i]] / whole)
                    break
                total += math.log10(len(open_) / whole)
                excluded |= kinds.keys()
            else:
                total -= math.log10(256 - len(excluded))
    return total


def model(seen, order):
    rows = [(len(c), int.from_bytes(c + bytes([s]), "big"), n) for c, k in seen.items() for s, n in k.items()]
    d, e, n = map(np.array, zip(*rows)) if rows else (np.zeros(0, int),) * 3
    return Ppm(d, e, n, order)


def score(m, texts, order):
    w, owner = windows(pa.array(texts), order)
    return np.bincount(owner, m.log_probabilities(w), len(texts))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abé ", max_size=12), min_size=0, max_size=6), st.lists(st.text("abcé ", max_size=12), min_size=1, max_size=4))
def test_like_brute_force(learn, texts):
    seen = trained(learn, 3)
    assert score(model(seen, 3), texts, 3) == pytest.approx([brute(seen, t, 3) for t in texts])


def test_probabilities_of_all_next_bytes_sum_to_one():
    seen = trained(["abracadabra", "abab", "cab"], 2)
    m = model(seen, 2)
    for context in (b"ab", b"br", b"zz", b"zb", b"\xfe\xfe"):
        keys = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)])
        assert (10 ** m.log_probabilities(keys)).sum() == pytest.approx(1)


def test_adaptive_learns():
    assert adaptive_length(b"ab" * 100) > 3 * adaptive_length(bytes(range(65, 125)) * 3)
    assert adaptive_length(b"") == pytest.approx(-math.log10(256))


def words(t):
    return [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [" "]


@pytest.mark.parametrize("head", [1, 1 << 19])
def test_table(spark, odd, head):
    got = score_texts(odd.selectExpr("*", "1 AS score", "2 AS row", "3 AS k"), F.crc32(F.col("doc_id").cast("string")) % 5 != 1,
                      settings=PpmSettings(head_words=head)).collect()
    rows = odd.collect()
    learn = [r for r in rows if r.doc_id is None or crc32(str(r.doc_id).encode()) % 5 != 1]
    c = Counter(w for r in learn for w in words(r.text))
    n, v = sum(c.values()), len(c)
    seen = trained([r.text or "" for r in learn], 5)
    want = sorted((str(r.doc_id), r.doc_id is not None and crc32(str(r.doc_id).encode()) % 5 == 1, len(words(r.text)), sum(c[w] > 0 for w in words(r.text)), n,
                   round(sum(math.log10((c[w] + .5) / (n + .5 * (v + 1))) for w in words(r.text)), 6), round(brute(seen, r.text or "", 5), 6)) for r in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == want


def test_small_capacity_keeps_whole_contexts(spark, odd):
    got = score_texts(odd, F.lit(True), settings=PpmSettings(capacity=40)).collect()
    assert len(got) == odd.count() and all(math.isfinite(r.score) for r in got)


@pytest.mark.parametrize("capacity", [1, 40, 1 << 20])
def test_capacity_drops_no_context(spark, odd, capacity):
    got = score_texts(odd, F.crc32(F.col("doc_id").cast("string")) % 5 != 1, settings=PpmSettings(capacity=capacity)).collect()
    rows = odd.collect()
    seen = trained([r.text or "" for r in rows if r.doc_id is None or crc32(str(r.doc_id).encode()) % 5 != 1], 5)
    want = sorted((str(r.doc_id), round(brute(seen, r.text or "", 5), 6)) for r in rows)
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == want


def test_nothing_to_learn_and_no_rows(spark, odd):
    got = score_texts(odd, F.lit(False)).collect()
    assert {r.n_known for r in got} == {0} and {r.train_tokens for r in got} == {0}
    assert score_texts(odd.limit(0), F.lit(True)).count() == 0
