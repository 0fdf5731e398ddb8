"""Upserts as merges of the stored table with a batch; the result replaces the table.

A merge is one aggregation over the union of both sides, where a batch row outranks a stored one,
so neither side is broadcast or looked up row by row. ``save`` writes the result as a new version of
the table and is meant for a single writer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanloom.functions.scalar import digest, short_id


def upsert(stored: DataFrame, batch: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Whole-row replacement by key; within the batch the largest ``order`` wins."""
    rest = [c for c in stored.columns if c not in keys]
    rank = F.col(order) if order else F.lit(0)
    both = stored.withColumn("_r", F.lit(0)).unionByName(batch.select(stored.columns).withColumn("_r", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_r", rank)).alias("_v")).select(*keys, "_v.*").select(stored.columns)


def merge_properties(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Property by property: a value in the batch overwrites, NULL keeps what is stored."""
    rest = [c for c in stored.columns if c not in keys]
    both = stored.withColumn("_r", F.lit(0)).unionByName(batch.select(stored.columns).withColumn("_r", F.lit(1)))
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_r"))).alias(c)
    return both.groupBy(*keys).agg(*[latest(c) for c in rest]).select(stored.columns)


def remove(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is not listed."""
    return stored.join(keys.distinct(), keys.columns, "left_anti")


def save(df: DataFrame, path: str) -> int:
    """Write ``df`` as the next version of the table at ``path``; the number of the version.

    The version counts once it is in the log, which is written last: a reader sees the old table or the new
    one, a row that is gone from ``df`` is gone from the table, and a write that failed leaves nothing
    but an unlisted folder. Older versions stay readable.
    """
    version = (latest(df.sparkSession, path) or 0) + 1
    df.write.mode("overwrite").parquet(f"{path}/v{version}")
    df.sparkSession.createDataFrame([(version,)], "version int").write.mode("append").parquet(f"{path}/log")
    return version


def latest(spark: SparkSession, path: str) -> int | None:
    """Number of the newest version, None where there is no table yet."""
    try:
        return spark.read.schema("version int").parquet(f"{path}/log").agg(F.max("version")).first()[0]
    except AnalysisException:
        return None


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version of a saved table, or the one asked for."""
    return spark.read.parquet(f"{path}/v{version or latest(spark, path)}")


def export(df: DataFrame, path: str, layout: str = "json") -> None:
    """Rows as JSON lines or CSV with a header."""
    if layout == "csv":
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        df.write.mode("overwrite").json(path)


# -- graph ----------------------------------------------------------------------------------


def upsert_graph(
    stored: tuple[DataFrame, DataFrame], batch: tuple[DataFrame, DataFrame], override_sessions: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Merge nodes by (type, id) and edges by (type, from, to).

    Edges of the batch are kept only between nodes of the batch. ``override_sessions`` first drops
    what is stored of these sessions.
    """
    (old_nodes, old_edges), (nodes, edges) = stored, batch
    if override_sessions is not None:
        gone = old_nodes.join(override_sessions, "session_id", "left_semi").select("id").distinct()
        old_nodes = old_nodes.join(override_sessions, "session_id", "left_anti")
        for end in ("from_id", "to_id"):
            old_edges = old_edges.join(gone.withColumnRenamed("id", end), end, "left_anti")
    ids = nodes.select("id").distinct()
    for end in ("from_id", "to_id"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
    columns = ["edge_type", "from_id", "to_id"]
    return merge_properties(old_nodes, nodes, ["node_type", "id"]), old_edges.select(columns).unionByName(edges.select(columns)).distinct()


# -- results, labels, reports ---------------------------------------------------------------


def metric_result_rows(results: DataFrame) -> DataFrame:
    """Results with the id of their metric definition and of themselves."""
    return results.withColumns({
        "metric_id": short_id("metric", F.col("metric"), F.col("provider")),
        "result_id": short_id("result", F.col("metric"), F.col("provider"), F.col("resource_id"))})


def upsert_metric_results(stored: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    return upsert(stored, metric_result_rows(batch), ["result_id"], order)


def newest_labels(labels: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Append-only label rows read as the newest one per session, without deleted sessions."""
    rest = [c for c in labels.columns if c != "session_id"]
    newest = labels.groupBy("session_id").agg(F.max_by(F.struct(*rest), F.struct("updated_at", *[c for c in rest if c != "updated_at"])).alias("v")).select("session_id", "v.*")
    return newest if deleted is None else remove(newest, deleted)


def report_rows(reports: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reports with their id, links to groups whose hash still matches, links to outlier sessions)."""
    rows = reports.withColumn("report_id", digest(F.col("group_id"), F.col("data_type"), F.col("metric")))
    current = rows.join(groups.select("group_id", F.col("hash").alias("group_hash")), ["group_id", "group_hash"], "left_semi")
    links = current.select("report_id", "group_id")
    outliers = rows.select("report_id", F.explode("outliers").alias("session_key")) if "outliers" in rows.columns else None
    return rows, links, outliers


def apply_group_delta(groups: DataFrame, links: DataFrame, delta: DataFrame, new_links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add, update and remove groups; links of touched groups are rebuilt from the new ones."""
    touched = delta.select("group_id").distinct()
    kept = groups.join(touched, "group_id", "left_anti")
    live = delta.where("action <> 'remove'").select(groups.columns)
    removed = delta.where("action = 'remove'").select(F.col("group_id").alias("target"))
    rest = links.join(touched, "group_id", "left_anti").join(removed, "target", "left_anti")
    fresh = new_links.join(live.select("group_id"), "group_id", "left_semi").select(links.columns)
    return kept.unionByName(live), rest.unionByName(fresh).distinct()


def upsert_insights(insights: DataFrame, links: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge insights; drop links of the batch's (target, template) to insights not in it, then insights nobody links to."""
    scope = batch.select("target", "template").distinct()
    current = batch.select("target", "template", "id").distinct()
    untouched = links.join(scope, ["target", "template"], "left_anti")
    new_links = untouched.select("target", "template", "id").unionByName(current).distinct()
    merged = upsert(insights, batch, ["id"])
    return merged.join(new_links.select("id").distinct(), "id", "left_semi"), new_links


def remove_groups(groups: DataFrame, links: DataFrame, reports: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove groups with their links (both ends) and reports."""
    ids = gone.select("group_id").distinct()
    return (
        groups.join(ids, "group_id", "left_anti"),
        links.join(ids, "group_id", "left_anti").join(ids.withColumnRenamed("group_id", "target"), "target", "left_anti"),
        reports.join(ids, "group_id", "left_anti"))


def composite_id(*parts: Column | str) -> Column:
    return F.concat_ws("_", *[F.col(p) if isinstance(p, str) else p for p in parts])


def upsert_feature_scores(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows keyed by session, target, rank and feature."""
    keyed = lambda df: df.withColumn("id", composite_id("session_key", "quality_target", F.col("rank").cast("string"), "feature"))
    return upsert(keyed(stored), keyed(batch), ["id"])


def upsert_embeddings(stored: DataFrame, batch: DataFrame) -> DataFrame:
    return upsert(stored, batch, ["state_id", "model"])


def replace_contexts(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """One context row per transition, replaced whole."""
    return upsert(stored, batch, ["transition"])


def merge_concepts(stored: DataFrame, batch: DataFrame) -> DataFrame:
    return upsert(stored, batch, ["owner", "name"])


def write_protocol_reports(
    reports: DataFrame, executions: DataFrame, results: DataFrame, batch: DataFrame, batch_executions: DataFrame, batch_results: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One report per session and one per executed protocol; old metrics of these executions go first."""
    cleared = remove(results, batch_executions.select("session_key", "protocol"))
    return (
        upsert(reports, batch, ["session_key"]), upsert(executions, batch_executions, ["session_key", "protocol"]),
        cleared.unionByName(batch_results.select(cleared.columns)))


def upsert_failure_reports(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """One report per (session, code, call)."""
    keyed = lambda df: df.withColumn("id", digest(F.col("session_key"), F.lit("|"), F.col("code"), F.lit("|"), F.col("call")))
    return upsert(keyed(stored), keyed(batch), ["id"])


def activate_model(models: DataFrame, variables: DataFrame, depends: DataFrame, batch: tuple[DataFrame, DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Store a symbolic model: it becomes its application's only active one; its dependencies are replaced."""
    new_models, new_variables, new_depends = batch
    apps = new_models.select("application_id").distinct()
    idle = models.join(apps, "application_id", "left_semi").withColumn("active", F.lit(False)).unionByName(models.join(apps, "application_id", "left_anti"))
    merged = upsert(idle, new_models.withColumn("active", F.lit(True)), ["model_id"])
    kept = remove(depends, new_models.select("model_id"))
    return merged, upsert(variables, new_variables, ["model_id", "variable"]), kept.unionByName(new_depends.select(depends.columns)).distinct()


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
