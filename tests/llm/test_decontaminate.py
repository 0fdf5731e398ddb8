import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm.decontaminate import Block, LeakSettings, align, drop_leaks, find_leaks, leaks_in, plain_words

R = random.Random(5)
VOCAB = [f"w{i}{chr(97 + i % 26)}" for i in range(400)]


def some(n):
    return [R.choice(VOCAB) for _ in range(n)]


ITEMS = [(i, some(R.randint(14, 40))) for i in range(12)] + [(12, ["too", "short"]), (13, [])]


def edited(words, share):
    return [R.choice(VOCAB) if R.random() < share else w for w in words if R.random() > share / 4]


def documents():
    rows = [(i, some(120)) for i in range(20)]
    for i, words in ITEMS[:12]:
        rows += [(100 + i, some(60) + words + some(50)), (200 + i, some(80) + edited(words, 0.15) + some(9)), (300 + i, words)]
    rows += [(400 + i, some(30) + ITEMS[0][1]) for i in range(40)]  # an item that most documents copy
    return [(k, " ".join(w).capitalize() + ".") for k, w in rows]


def brute(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment():
    for _ in range(60):
        a, b = (np.array([R.randint(0, 5) for _ in range(R.randint(1, 15))]) for _ in range(2))
        score, start, end = align(a, b)
        assert score == brute(a, b) and (not score or brute(a, b[start:end]) == score)


@pytest.mark.parametrize("block", [1_000_000, 90])
def test_like_brute_force(spark, odd, block):
    rows, s = documents(), LeakSettings(block_words=block)
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in ITEMS] + [(14, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in find_leaks(docs.selectExpr("*", "1 AS score", "2 AS i", "3 AS k"), items, settings=s).collect()}
    want = {}
    for d, t in rows:
        words, _ = plain_words(pa.array([t]))
        words = words.to_pylist()
        for i, item in ITEMS[:12]:
            if set(item) & set(words):
                score = brute(item, words)
                if score >= min(s.least_score, s.least_share * len(item)) and score > s.least_words:
                    want[d, i] = score
    assert {k: r.score for k, r in got.items()} == want
    assert all(len(range(r.first_word, r.end_word)) >= r.score for r in got.values())
    leaked = {d for d, _ in want}
    assert {100, 200, 300, 400} <= leaked and not leaked & set(range(20))
    kept = drop_leaks(docs, items, settings=s)
    assert kept.count() == docs.where(~docs.doc_id.isin(sorted(leaked)) | docs.doc_id.isNull()).count()
    assert find_leaks(docs.limit(0), items).count() == 0 and find_leaks(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("together", [1 << 20, 7])
def test_many_copies_of_a_part_are_all_found(spark, together, monkeypatch):
    monkeypatch.setattr("spanloom.llm.decontaminate.TOGETHER", together)
    item = [f"part{i}" for i in range(40)]
    rows = [(i, " ".join(some(R.randint(0, 30)) + item[:24] + some(R.randint(0, 30)))) for i in range(1000)]
    docs = spark.createDataFrame([*rows, (1000, " ".join(some(60)))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.score for r in find_leaks(docs, items).collect()}
    assert got == {i: 24 for i in range(1000)}
    assert [r.doc_id for r in drop_leaks(docs, items).collect()] == [1000]
    block = Block([1], [" ".join(item)], LeakSettings())
    assert len(leaks_in(block, pa.array([t for _, t in rows]), LeakSettings())) == 1000


@pytest.mark.parametrize("size", [6, 60, 400])
def test_no_copy_is_lost_however_common_its_words_are(size):
    r = random.Random(size)
    vocabulary, s = [f"w{i}" for i in range(size)], LeakSettings()
    items = [[r.choice(vocabulary) for _ in range(n)] for n in (3, 4, 5, 9, 20, 40, 70)]
    texts = [[r.choice(vocabulary) for _ in range(n)] for n in (0, 1, 2, 30, 300)]
    for item in items:
        for share in (0.1, 0.2, 0.3, 0.4):
            copy = [r.choice(vocabulary) if r.random() < share else w for w in item]
            texts.append([r.choice(vocabulary) for _ in range(r.randint(0, 200))] + copy + [r.choice(vocabulary) for _ in range(r.randint(0, 90))])
    got = {(d, i): score for d, i, score, *_ in leaks_in(Block(list(range(7)), [" ".join(x) for x in items], s), pa.array([" ".join(x) for x in texts]), s)}
    scores = {(d, i): brute(x, t) for d, t in enumerate(texts) for i, x in enumerate(items)}
    assert got == {k: n for k, n in scores.items() if n >= s.least(len(items[k[1]]))}


def test_every_third_word_replaced():
    item = [f"part{i}" for i in range(40)]
    text = some(30) + [w if i % 3 < 2 else "other" for i, w in enumerate(item)] + some(30)
    found = leaks_in(Block([1], [" ".join(item)], LeakSettings()), pa.array([" ".join(text)]), LeakSettings())
    assert [x[2:] for x in found] == [(14, 14 / 40, 30, 68)]  # the last kept word stands behind a replaced one


def test_an_item_of_many_words_is_aligned_in_two_rows():
    tracemalloc.start()
    item = np.arange(6000)
    assert align(item, np.concatenate([item + 9000, item, item + 9000])) == (6000, 6000, 12000)
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()
