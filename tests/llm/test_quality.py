import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm.quality import RepeatLimits, keep_good, longest_repeats, measure, repeat_measures


def brute(text: str, span: int = 8) -> tuple:
    w = re.findall(r"[^\x20\x09-\x0D]+", text)

    def windows(n: int) -> set:
        at: dict = {}
        for i in range(len(w) - n + 1):
            at.setdefault(tuple(w[i:i + n]), []).append(i)
        return {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + n)}

    longest = max([0, *(n for n in range(1, len(w)) if windows(n))])
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(windows(5)), len(windows(span)), longest)


def rows(got: dict) -> list[tuple]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]
    return list(zip(*(got[n].tolist() for n in names)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \n#é", max_size=60), min_size=1, max_size=6))
def test_measures_like_brute_force(texts):
    assert rows(measure(pa.array(texts), 8)) == [brute(t) for t in texts]


def test_longest_repeats_stay_inside_a_document():
    x, doc = np.array([1, 2, 3, 1, 2, 3]), np.array([0, 0, 0, 1, 1, 1])
    assert not longest_repeats(x, doc).any()
    assert longest_repeats(np.zeros(40, int), np.zeros(40, int)).tolist() == [max(39 - i, i and 40 - i) for i in range(40)]


def test_odd_rows(spark, odd):
    got = {r.doc_id: r for r in repeat_measures(odd, spans=True).collect()}
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert repeat_measures(odd).count() == odd.count()
    for k, t in texts.items():
        r = got[k]
        if len(t) < 1000:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.covered_words, r.longest_repeat) == brute(t)
    assert not got[0].kept and got[0].n_words == 0
    assert repeat_measures(odd.limit(0)).count() == 0


def test_pipeline_form_keeps_the_same_rows(spark, odd):
    extra = odd.selectExpr("*", "1 AS kept", "2 AS n_words", "3 AS k", "4 AS t")
    kept = keep_good(extra)
    assert kept.columns == extra.columns
    want = sorted(r.doc_id for r in repeat_measures(odd).where("kept").collect())
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_limits(spark):
    line = " ".join(f"w{i}" for i in range(30))
    other = " ".join(f"v{i}" for i in range(300))
    docs = spark.createDataFrame([(1, other), (2, f"{line} {other} {line}")], "doc_id long, text string")
    assert [r.kept for r in repeat_measures(docs).orderBy("doc_id").collect()] == [True, True]
    tight = RepeatLimits(longest_words=29)
    assert [r.kept for r in repeat_measures(docs, limits=tight).orderBy("doc_id").collect()] == [True, False]
