import random

import pytest
from pyspark.sql import functions as F

from spanloom.llm.lines import LineSettings, agreeing, alike, banded_distance, drop_copied_lines, earlier_copies, keyed, letter_counts

R = random.Random(3)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(line, n):
    for _ in range(n):
        k = R.randrange(len(line) + 1)
        line = R.choice([line[:k] + line[k + 1:], line[:k] + R.choice("xyzé𝒳") + line[k:], line[:k] + R.choice("xyz") + line[k + 1:]])
    return line


def corpus():
    base = ["".join(R.choice("abcdefgh é") for _ in range(R.randint(8, 60))) for _ in range(40)]
    docs = []
    for i in range(60):
        lines = [changed(R.choice(base), R.choice([0, 0, 1, 2, 3, 4])) for _ in range(R.randint(1, 6))]
        docs.append((i, "\n".join(lines)))
    docs += [(1000 + i, f"visitor number {i:07d} has been here, and says hello") for i in range(40)]
    return docs


def brute(rows, s):
    """Ids of lines with an earlier copy; rows are in order."""
    lines = [(d, n, x) for d, t in rows for n, x in enumerate((t or "").split("\n"))]
    out = set()
    for k, (d, n, x) in enumerate(lines):
        for _, _, y in lines[:k]:
            if len(x) >= s.least_chars and (x == y or min(len(x), len(y)) >= s.near_chars and distance(x, y) <= s.edits):
                out.add((d, n))
                break
    return out


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    words = [(a, b) for a in ["", "a", "kitten", "abcabcabc", "aaaa"] for b in ["", "b", "sitten", "kitting", "abcabc", "bcabcabca", "aaaaa"]]
    words += [(x, changed(x, R.randint(0, 4))) for x in ["".join(R.choice("ab") for _ in range(R.randint(0, 12))) for _ in range(150)]]
    df = spark.createDataFrame(words, "a string, b string").withColumn("d", banded_distance(F.split(F.col("a"), ""), F.split(F.col("b"), ""), edits))
    for r in df.collect():
        d = distance(r.a, r.b)
        if r.a and r.b:
            assert r.d == (d if d <= edits else None), (r.a, r.b)


@pytest.mark.parametrize("edits", [1, 2])
def test_like_brute_force(spark, odd, edits):
    s = LineSettings(edits=edits)
    rows = corpus()
    docs = spark.createDataFrame(R.sample(rows, len(rows)), "doc_id long, text string")
    got = earlier_copies(docs.selectExpr("*", "1 AS nr", "2 AS line", "3 AS key", "4 AS first"), settings=s).collect()
    lines = {(d, n): x for d, t in rows for n, x in enumerate(t.split("\n"))}
    assert len(got) == len({(r.doc, r.nr) for r in got})
    assert {(r.doc, r.nr) for r in got} == brute(rows, s)
    for r in got:
        assert distance(lines[r.doc, r.nr], lines[r.of_doc, r.of_nr]) == r.edits <= edits and (r.of_doc, r.of_nr) < (r.doc, r.nr)


def test_texts_without_the_copies(spark, odd):
    s = LineSettings()
    rows = corpus()
    docs = spark.createDataFrame([(d, t, len(t), 7) for d, t in rows], "doc_id long, text string, n_chars long, first int")
    gone = brute(rows, s)
    want = {d: "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone) for d, t in rows}
    got = drop_copied_lines(docs, settings=s)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == {d: t for d, t in want.items() if t.strip()}
    assert got.where("n_chars <> length(text)").count() == 0


def test_odd_rows(spark, odd):
    kept = drop_copied_lines(odd)
    was, now = [r.text for r in odd.collect()], [r.text for r in kept.collect()]
    assert sorted(map(repr, was)) == sorted(map(repr, now))  # no line here has an earlier copy that is long enough
    assert earlier_copies(odd.limit(0)).count() == 0 and drop_copied_lines(odd.limit(0)).count() == 0
    twice = odd.where("doc_id = 12").union(odd.where("doc_id = 12")).withColumn("doc_id", F.lit(None).cast("long"))
    assert drop_copied_lines(twice).count() == 2  # rows alike in key and text are one document


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_large_group_meets_in_small_ones(spark, edits):
    template = "visitor number {} of {} was here in the year {}, and left a word: {}"
    rows = [(i, template.format(R.randrange(10 ** 6), R.choice(["Rome", "Oslo", "Lima"]), R.randrange(1900, 2000), "".join(R.choice("abcdefgh") for _ in range(6)))) for i in range(300)]
    rows += [(300 + i, changed(x, R.randint(0, edits))) for i, x in rows[:60]]
    lines = spark.createDataFrame(rows, "nr long, line string").withColumn("key", F.lit(1)).withColumn("letters", letter_counts(F.col("line")))
    right = lines.select("key", F.col("nr").alias("n2"), F.col("letters").alias("l2"))
    got = [(r.nr, r.n2) for r in alike(lines, right, edits, F.col("nr") > F.col("n2")).collect()]
    text = dict(rows)
    near = {(a, b) for a in text for b in text if a > b and a >= 300 and distance(text[a], text[b]) <= edits}
    assert len(got) == len(set(got)) and near <= set(got)
    assert len(got) < len(rows) ** 2 / 2 / 20  # of all pairs of the group few are left
    masks = agreeing(edits)
    assert len(masks) == 2 * edits + 1 and sum(m & (1 << 64) - 1 for m in masks) == (1 << 64) - 1


def test_keys_do_not_depend_on_the_width_of_characters(spark):
    base = "a line of forty characters, no more, no."
    rows = [(1, 1, i, x, len(x)) for i, x in enumerate([base, "é" + base[1:], base[:-1] + "𝒳"])]
    keys = keyed(spark.createDataFrame(rows, "doc long, place long, nr int, line string, size int"), LineSettings(), True).where("NOT whole")
    by = {}
    for r in keys.collect():
        by.setdefault(r.nr, []).append(r.key)
    assert len(set(by[0]) & set(by[1])) == len(set(by[0]) & set(by[2])) == 2
