"""Insights: each template is a query over reports, followed by text substitution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

# Thresholds and texts of the insight templates.
INCONSISTENT, CRITICAL, LOW, RATIO = 0.70, 0.45, 0.60, 1.5
TEMPLATES = {
    "graph_inconsistency": (
        'Unreliable execution patterns in group "$groupName"',
        'Traces about "$groupName" have unreliable execution patterns (consistency=$meanValue, below the threshold $threshold).',
        "Reliability", "P2", "$groupId"),
    "metric_inconsistency": (
        'Unreliable metric results in group "$groupName"',
        'Sessions about "$groupName" have the following unreliable metrics: $metricsList (consistency threshold: $threshold)',
        "Reliability", "P2", "$groupId"),
    "text_inconsistency": (
        'Unreliable textual outcomes in group "$groupName"',
        'Traces about "$groupName" have unreliable textual outcomes (consistency=$meanValue, below the threshold $threshold).',
        "Reliability", "P2", "$groupId"),
    "graph_anomaly": (
        "Anomalous execution graph for session $sessionId",
        'Session $sessionId has an anomalous execution graph pattern in semantic group "$groupName".',
        "Anomaly", "P2", "$sessionId"),
    "metric_drop": (
        "Unexpected drop in $metricName",
        "$metricName value for session $sessionId is lower than expected ($metricValue instead of $normal)",
        "Performance,Anomaly", "P3", "$sessionId"),
    "metric_spike": (
        "Unexpected spike in $metricName",
        "$metricName value for session $sessionId is higher than expected ($metricValue instead of $normal)",
        "Performance,Anomaly", "P3", "$sessionId"),
    "critical_risk": (
        "High metric consistency risk on $metricName",
        "Session $sessionId has non-anomalous $metricName=$metricValue, but group consistency is critically low ($meanValue < $threshold).",
        "Reliability", "P2", "$sessionId"),
    "low_risk": (
        "Low metric consistency risk on $metricName",
        "Session $sessionId has non-anomalous $metricName=$metricValue, and group consistency is low ($meanValue < $threshold).",
        "Consistency,Metric,Reliability", "P3", "$sessionId"),
    "text_anomaly": (
        "Anomalous textual output for session $sessionId",
        'Session $sessionId has anomalous textual output: "$sessionOutput".\nExpected session query: "$medoidOutput".',
        "Anomaly", "P2", "$sessionId"),
}


def fill(rows: DataFrame, template: str) -> DataFrame:
    """(id, template, target, name, description, labels, priority); ``$name`` takes the column's text.

    Longer names are replaced first, so one name may start with another.
    """
    name, description, labels, priority, target = TEMPLATES[template]
    columns = sorted(rows.columns, key=len, reverse=True)

    def put(text: str):
        return reduce(lambda c, v: F.replace(c, F.lit("$" + v), F.coalesce(F.col(v).cast("string"), F.lit(""))), columns, F.lit(text))

    out = rows.select(put(target).alias("target"), put(name).alias("name"), put(description).alias("description"))
    return out.select(
        F.sha2(F.concat(F.lit(template), "target", "name"), 256).alias("id"), F.lit(template).alias("template"), "target", "name",
        "description", F.lit(labels).alias("labels"), F.lit(priority).alias("priority")).dropDuplicates(["id"])


def inconsistent_groups(reports: DataFrame, groups: DataFrame, layer: str) -> DataFrame:
    """Groups whose consistency of a layer is below the threshold; metrics are listed by name."""
    weak = reports.where((F.col("data_type") == layer) & (F.col("mean") < INCONSISTENT)).join(groups.select("group_id", "name"), "group_id")
    base = weak.select(F.col("group_id").alias("groupId"), F.col("name").alias("groupName"), "metric", F.round("mean", 4).alias("meanValue"))
    if layer != "metric":
        return base.select("groupId", "groupName", "meanValue", F.lit("0.7").alias("threshold"))
    return base.groupBy("groupId", "groupName").agg(F.array_join(F.array_sort(F.collect_set("metric")), ", ").alias("metricsList")).withColumn(
        "threshold", F.lit("0.7"))


def _with_normal(outliers: DataFrame, results: DataFrame, normal: DataFrame) -> DataFrame:
    rows = results.join(outliers.select("group_id", "session_key", "metric").distinct(), ["session_key", "metric"])
    return rows.join(normal.select("group_id", "metric", "centroid"), ["group_id", "metric"])


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("session_key").alias("sessionId"), F.col("metric").alias("metricName"), F.round("result", 2).alias("metricValue"), F.round("centroid", 2).alias("normal"))


def spikes(outliers: DataFrame, results: DataFrame, normal: DataFrame) -> DataFrame:
    rows = _with_normal(outliers, results, normal)
    return _shown(rows.where(F.try_divide("result", "centroid") > RATIO))


def drops(outliers: DataFrame, results: DataFrame, normal: DataFrame) -> DataFrame:
    rows = _with_normal(outliers, results, normal)
    return _shown(rows.where((F.col("result") == 0) | (F.try_divide("centroid", "result") > RATIO)))


def consistency_risks(reports: DataFrame, members: DataFrame, results: DataFrame, outliers: DataFrame, low: float | None, high: float) -> DataFrame:
    """Results of non-outlier sessions in groups whose consistency for that metric is in (low, high]."""
    weak = reports.where((F.col("data_type") == "metric") & (F.col("mean") <= high))
    if low is not None:
        weak = weak.where(F.col("mean") > low)
    weak = weak.select("group_id", "metric", "mean")
    rows = members.select("group_id", "session_key").join(weak, "group_id").join(results.select("session_key", "metric", "result"), ["session_key", "metric"])
    calm = rows.join(outliers.select("group_id", "session_key", "metric").distinct(), ["group_id", "session_key", "metric"], "left_anti")
    return calm.select(
        F.col("session_key").alias("sessionId"), F.col("metric").alias("metricName"), F.round("result", 4).alias("metricValue"),
        F.round("mean", 4).alias("meanValue"), F.lit(str(high)).alias("threshold"))


def graph_anomalies(outliers: DataFrame, groups: DataFrame) -> DataFrame:
    return outliers.join(groups.select("group_id", "name"), "group_id").select(F.col("session_key").alias("sessionId"), F.col("name").alias("groupName"))


def text_anomalies(outliers: DataFrame, medoids: DataFrame, outputs: DataFrame) -> DataFrame:
    own = outputs.select("session_key", F.col("output").alias("sessionOutput"))
    other = outputs.select(F.col("session_key").alias("medoid"), F.col("output").alias("medoidOutput"))
    rows = outliers.join(medoids.select("group_id", "medoid"), "group_id").join(own, "session_key", "left").join(other, "medoid", "left")
    return rows.select(F.col("session_key").alias("sessionId"), "sessionOutput", "medoidOutput")


def all_insights(filled: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, filled).dropDuplicates(["id"])
