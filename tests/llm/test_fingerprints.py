import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

import spanloom.llm.fingerprints as fp
from spanloom.llm.fingerprints import edited_fingerprints, fingerprint_texts, followed, likeness, op13_fingerprints, signatures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def jaccard(a, b):
    x, y = Counter(WORD.findall(a)), Counter(WORD.findall(b))
    return sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0


def brute(rows):
    """(key, n_chars, sha256 of the edited text, likeness to it, likeness to the next) of (key, text), keys all different."""
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for (k, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        out[k] = (len(t), sha256(edited.encode()).hexdigest(), jaccard(t, edited), jaccard(t, nxt))
    return out


def made(n, seed=1):
    rng = np.random.default_rng(seed)
    ids = rng.choice(10 * n, n, replace=False).tolist()
    base = [f"w{v}" for v in rng.integers(0, 300, 400)]
    rows = []
    for i in ids:
        text = list(base[:int(rng.integers(0, 400))])
        for at in rng.integers(0, max(1, len(text)), len(text) // 3):
            if text:
                text[at] = f"é𝒳{int(rng.integers(0, 60))}"
        rows.append((i, " ".join(text) + "\n" * int(rng.integers(0, 2))))
    return rows


@pytest.mark.parametrize("task_bytes", [fp.TASK_BYTES, 2000])
def test_like_brute_force(spark, monkeypatch, task_bytes):
    monkeypatch.setattr(fp, "TASK_BYTES", task_bytes)
    rows = made(150) + [(None, "last of all é")]
    want = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in edited_fingerprints(docs).collect()}
    assert {k: (r.n_chars, r.edited_sha256) for k, r in got.items()} == {k: w[:2] for k, w in want.items()}
    off = [got[k].near_edited - w[2] for k, w in want.items()] + [got[k].near_next - w[3] for k, w in want.items()]
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.075 and max(map(abs, off)) < 0.3
    assert all(len(r.fingerprint) == (8 * fp.SAMPLES if WORD.search(t) else 0) for (k, t), r in ((x, got[x[0]]) for x in rows))
    assert followed(docs).select("bucket").distinct().count() > 4 and followed(docs).where("NOT border AND next_t IS NULL").count() == 0


def test_collision_rate_is_the_weighted_similarity(spark):
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 9, 40), rng.integers(0, 5, 40)
    terms = spark.createDataFrame([(t, int(x) or None, int(y) or None) for t, (x, y) in enumerate(zip(a, b))], "t long, a long, b long")
    trials = spark.range(60).select(F.col("id").alias("trial")).crossJoin(terms).withColumn("t", F.xxhash64("t", "trial"))
    got = signatures(trials, ["trial"], "t", ["a", "b"]).select(F.avg(likeness(F.col("a"), F.col("b"))).alias("x")).first().x
    assert abs(got - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03
    with pytest.raises(ValueError):
        signatures(trials, ["trial"], "t", ["a"], 30)


def test_fractional_weights_scale_out(spark):
    terms = spark.createDataFrame([(1, i, float(w), w / 1024) for i, w in enumerate([1, 5, 2, 9, 40])], "k long, t long, a double, b double")
    r = signatures(terms.withColumn("t", F.xxhash64("t")), ["k"], "t", ["a", "b"]).first()
    assert len(r.a) == len(r.b) == fp.SAMPLES and sum(x == y for x, y in zip(r.a, r.b)) < 20  # weights count, not shares


def test_equal_texts_equal_fingerprints(spark, odd):
    got = fingerprint_texts(odd.where("doc_id IS NOT NULL AND doc_id <> 3"))
    by = {r.doc_id: r.fingerprint for r in got.collect()}
    assert by[0] is None and by[1] is None and by[2] is None and by[4] is not None
    assert by[5] == by[5] and by[9] != by[5]
    twice = spark.createDataFrame([(1, "a b b c"), (2, "a b b c"), (3, "a b c"), (4, "c b\ta b")], "doc_id long, text string")
    by = {r.doc_id: tuple(r.fingerprint) for r in fingerprint_texts(twice).collect()}
    assert by[1] == by[2] == by[4] != by[3]


def test_odd_rows(spark, odd):
    wide = odd.selectExpr("*", "1 AS k", "2 AS t", "3 AS bucket", "4 AS border", "5 AS own")
    got = edited_fingerprints(wide).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r.doc_id is None, r.doc_id or 0) for r in odd.collect())
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    same = [r for r in got if r.doc_id == 3]  # one is followed by its copy, the other by what comes after
    assert len({r.fingerprint for r in same}) == 1 and 1.0 in {r.near_next for r in same}
    assert next(r for r in got if r.doc_id == 1).near_next == 1.0  # empty, then null
    assert edited_fingerprints(odd.limit(0)).count() == 0
    one = edited_fingerprints(spark.createDataFrame([(7, "only one here")], "doc_id long, text string")).collect()[0]
    assert one.near_next == 1.0 and one.edited_sha256 == sha256(b"only ononly o").hexdigest()
    none = edited_fingerprints(spark.createDataFrame([(None, "a b"), (None, "a b c"), (None, "x")], "doc_id long, text string")).collect()
    assert len(none) == 3 and all(r.edited_sha256 and r.near_next is not None for r in none)


def test_query(spark, tmp_path):
    rows = made(40, 3)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(rows)
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in op13_fingerprints(spark, str(tmp_path)).collect()} == {k: w[:2] for k, w in want.items()}
