"""Streams over tables that are one file or a folder of part files, and over none."""

import pytest
from pyspark.sql import functions as F

from spanloom.streaming import jobs

SCHEMA = "session_key string, application_id string, vector array<double>"


@pytest.mark.parametrize("files", [1, 3])
def test_nearest_groups_of_a_table(spark, tmp_path, files):
    rows = [(f"s{i}", "a", [1.0, i / 10]) for i in range(9)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(files)
    at = tmp_path / "embeddings.parquet"
    table.write.parquet(str(at if files > 1 else tmp_path / "one"))
    if files == 1:
        next((tmp_path / "one").glob("part-*")).rename(at)
    table.limit(1).write.parquet(str(tmp_path / "other.parquet"))
    refs = spark.createDataFrame([("g1", "a", [1.0, 0.0]), ("g2", "a", [1.0, 0.8])], "ref_id string, application_id string, vector array<double>")
    got = jobs.nearest_groups(jobs.stream_files(spark, str(tmp_path), "embeddings.parquet", table.schema), refs, 0.9)
    want = jobs.nearest_groups(table, refs, 0.9)
    shown = lambda df: sorted((r.session_key, r.ref_id) for r in df.collect())
    assert shown(got) == shown(want) and len(shown(got)) == 9


def test_a_stream_without_rows(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    none.write.parquet(str(tmp_path / "embeddings.parquet"))
    stream = jobs.stream_files(spark, str(tmp_path), "embeddings.parquet", none.schema).where(F.col("session_key") == "x")
    refs = spark.createDataFrame([("g1", "a", [1.0, 0.0])], "ref_id string, application_id string, vector array<double>")
    assert jobs.nearest_groups(stream, refs, 0.9).collect() == []
    counts = stream.groupBy("session_key").count()
    assert jobs.run_available(stream).count() == jobs.run_available(counts, "update", keys=["session_key"]).count() == jobs.run_available(counts, "complete").count() == 0
