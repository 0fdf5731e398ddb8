import itertools
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm.pieces import MODEL, SPACE, Coder, Pieces, decode_ids, encode_texts

SMALL = [("a", -2.0), ("b", -3.0), ("ab", -3.5), ("ba", -4.0), ("aba", -5.25), ("bb", -4.0), (SPACE, -1.0), (SPACE + "a", -2.5), ("abab", -7.0)]


def coder(extra=()):
    return Coder(Pieces(tuple((256 + i, p, s) for i, (p, s) in enumerate([*SMALL, *extra])), 0, 400))


def best(c: Coder, text: str) -> float:
    """Score of the best of all segmentations."""
    pieces = {p: s for p, s in SMALL}
    top = float("-inf")
    for cuts in itertools.product([0, 1], repeat=max(0, len(text) - 1)):
        parts, last = [], 0
        for i, x in enumerate([*cuts, 1], 1):
            if x:
                parts.append(text[last:i])
                last = i
        if all(p in pieces or len(p) == 1 for p in parts):
            top = max(top, sum(pieces.get(p, c.unknown) for p in parts))
    return top


def score(c: Coder, ids) -> float:
    by = {256 + i: s for i, (_, s) in enumerate(SMALL)}
    return sum(by[i] if i in by else c.unknown for i in ids)  # an unknown of one byte


@settings(max_examples=150, deadline=None)
@given(st.text("ab z", min_size=1, max_size=10))
def test_best_of_all_segmentations(text):
    c = coder()
    ids = c.encode(text).tolist()
    assert c.decode(ids) == text
    assert score(c, ids) == best(c, SPACE + text.replace(" ", SPACE))


def test_crossing_pieces_are_found():
    c = Coder(Pieces(((256, "a" + SPACE + "b", -0.5), (257, "a", -1.0), (258, "b", -1.0), (259, SPACE, -1.0)), 0, 400))
    assert c.encode("a b").tolist() == [259, 256]


def test_ids_come_before_the_end_and_the_window_stays_small():
    c, taken = coder(), 0

    def chars():
        nonlocal taken
        for ch in "abz" * 1000:
            taken += 1
            yield ch

    stream = c.stream(chars())
    next(stream)
    assert taken < 100


def test_endless_word_is_exact():
    c = coder()
    for text in ("ab" * 400 + "z", "aba" * 301, "b" * 777):
        assert c.decode(c.encode(text).tolist()) == text


@pytest.mark.skipif(not os.path.exists(MODEL), reason="needs the vocabulary file")
def test_odd_rows(spark, odd):
    rows = encode_texts(odd.selectExpr("*", "1 AS ids", "2 AS k", "3 AS t"))
    got = rows.collect()
    assert len(got) == odd.count() and all(r.round_trip for r in got)
    assert {r.doc_id: r.n_ids for r in got if r.doc_id in (0, 1)} == {0: 0, 1: 0}
    texts = {r.doc_id: r.text for r in decode_ids(rows).collect()}
    assert texts == {r.doc_id: r.text or "" for r in odd.collect()}
    assert encode_texts(odd.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists(MODEL), reason="needs the vocabulary file")
@settings(max_examples=80, deadline=None)
@given(st.text(max_size=80))
def test_round_trip(text):
    assert _real().decode(_real().encode(text).tolist()) == text


_REAL = []


def _real():
    if not _REAL:
        _REAL.append(Coder(Pieces.load(MODEL)))
    return _REAL[0]
