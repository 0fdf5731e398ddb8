import os

import pytest

import corpus_pipeline
from spanloom.llm.jaccard import keep_one
from spanloom.llm.pieces import MODEL
from test_jaccard import brute, corpus
from spanloom.llm.jaccard import JaccardSettings


def test_one_of_each_group(spark, odd):
    rows = corpus(20)
    docs = spark.createDataFrame([(k, t, 5) for k, t in rows], "doc_id long, text string, root int")
    s = JaccardSettings(5, 80)
    kept = keep_one(docs, settings=s)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, n, c in brute(rows, s) if n})
    twice = odd.union(odd)
    got = [r.text for r in keep_one(twice).collect()]
    assert sum(not (t or "").strip() for t in got) == 2 * sum(not (r.text or "").strip() for r in odd.collect())
    assert got.count("one two") == 1 and got.count("a") == 1


@pytest.mark.skipif(not os.path.exists(MODEL), reason="needs the vocabulary file")
def test_stages(spark, odd, tmp_path):
    spark.createDataFrame([(0, "any five words of test")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, names = odd, odd.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == names and out.schema == odd.schema, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).where("NOT round_trip").count() == 0
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "decontamination", "pieces"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0
