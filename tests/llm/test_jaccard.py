import random
import re

import numpy as np
import pyarrow as pa
import pytest

import spanloom.llm.jaccard as J
from spanloom.llm.components import connected
from spanloom.llm.jaccard import JaccardSettings, Plan, jaccard_classes, keys_of, shingle_sets

R = random.Random(11)


def shingles(text, n):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, s):
    sets = [(k, shingles(t, s.words)) for k, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            both = len(a & b)
            if a and b and 100 * both >= s.percent * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (k, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, len(a), least[find(i)]) for i, (k, a) in enumerate(sets))


def corpus(n):
    words = [f"w{i}" for i in range(300)]
    base = [[R.choice(words) for _ in range(R.choice([1, 2, 3, 5, 9, 12, 20, 40, 90, 200]))] for _ in range(n)]
    rows = []
    for i in range(6 * n):
        w = list(R.choice(base))
        for _ in range(R.choice([0, 0, 1, 1, 2, 3, 6])):
            k = R.randrange(len(w) + 1)
            w[k:k + R.choice([0, 1])] = [R.choice(words)] if R.random() < .7 else []
        rows.append((i, " ".join(w).title() if R.random() < .2 else " ".join(w)))
    center = [R.choice(words) for _ in range(150)]
    for i in range(150):  # one large group around a center
        w = list(center)
        for _ in range(R.randint(0, 5)):
            w[R.randrange(len(w))] = R.choice(words)
        rows.append((10_000 + i, " ".join(w)))
    return rows


@pytest.mark.parametrize("s", [JaccardSettings(), JaccardSettings(5, 80)])
@pytest.mark.parametrize("block", [4096, 16])
def test_like_brute_force(spark, monkeypatch, s, block):
    monkeypatch.setattr(J, "BLOCK", block)
    rows = corpus(25)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, v int, component_id int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_classes(docs, settings=s).collect())
    assert got == brute(rows, s)


@pytest.mark.parametrize("s", [JaccardSettings(), JaccardSettings(5, 80), JaccardSettings(3, 50)])
@pytest.mark.parametrize("docs", [None, 10 ** 9])
def test_linked_sets_share_a_key(s, docs):
    largest = 500
    plan = Plan(largest, s.percent, dict.fromkeys(range(200), docs) if docs else None)
    if docs:
        assert plan.wide.any()
    g = np.random.default_rng(1)
    for _ in range(300):
        n = int(g.integers(1, 220))
        a = g.integers(0, 1 << 62, n, dtype=np.uint64)
        m = n
        while 100 * n < s.percent * (m + 1) or 100 * (m + 1) * 0 + 100 * n >= s.percent * (m + 1) and g.random() < .9 and m < largest:
            if 100 * n < s.percent * (m + 1):
                break
            m += 1
        b = np.concatenate([a, g.integers(0, 1 << 62, m - n, dtype=np.uint64)])
        swap = int(g.integers(0, max(1, n)))
        while swap and 100 * (n - swap) < s.percent * (n + m - (n - swap)):
            swap -= 1
        b[:swap] = g.integers(0, 1 << 62, swap, dtype=np.uint64)
        both = len(np.intersect1d(a, b))
        assert 100 * both >= s.percent * (len(a) + len(b) - both)
        x, y = (set(keys_of(plan, np.unique(z), np.array([len(z)]))[0].tolist()) for z in (a, b))
        assert x & y


def test_shingles():
    texts = ["A b C d", "one", "Two words", "", " \t\n", "É é x", "a b c a b c"]
    sets, sizes = shingle_sets(pa.array(texts), 3)
    assert sizes.tolist() == [len(shingles(t, 3)) for t in texts]
    assert shingle_sets(pa.array(["a b C D"]), 3)[0].tolist() == shingle_sets(pa.array(["A B c d"]), 3)[0].tolist()


def test_odd_rows(spark, odd):
    got = jaccard_classes(odd.selectExpr("*", "1 AS n", "2 AS k", "3 AS v")).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[0].component_id == 0 and by[0].n_shingles == 0 and by[1].component_id == 1
    assert {r.component_id for r in got if r.doc_id in (3, 4)} == {3}
    assert jaccard_classes(odd.limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 105), (103, 105), (103, 104)] + [(200, 200 + i) for i in range(1, 50)] + [(300, 300)]
    got = {r.v: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | dict.fromkeys([100, 103, 104, 105], 100) | {200 + i: 200 for i in range(50)}
    assert got == want


@pytest.mark.parametrize("words", range(8))
def test_fewer_words_in_all_than_a_shingle(words):
    texts = pa.array([" ".join(f"w{i}" for i in range(words))])
    assert shingle_sets(texts, 5)[1].tolist() == [min(words, max(1, words - 4))]


def test_keep_one_of_one_short_document(spark):
    one = spark.createDataFrame([(1, "two words")], "doc_id long, text string")
    assert [tuple(r) for r in J.keep_one(one).collect()] == [(1, "two words")]


def test_sets_are_made_for_likely_pairs_only(spark, monkeypatch):
    from spanloom.llm import jaccard

    tables = {}

    def kept(df, name, write=jaccard.written):
        tables.setdefault(name, []).append(write(df, name))
        return tables[name][-1]

    monkeypatch.setattr(jaccard, "written", kept)
    draw = random.Random(5)
    rows = [(i, " ".join(f"w{draw.randrange(5000)}" for _ in range(60))) for i in range(200)]
    rows.append((200, rows[7][1] + " more"))
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), settings=JaccardSettings(5, 80))
    assert sorted(r.doc_id for r in got.where("doc_id <> component_id").collect()) == [200]
    assert tables["jaccard-cells"][0].count() > 50  # by chance, many sets share a key with another
    assert 2 <= sum(t.count() for t in tables["jaccard-sets"]) < 20
