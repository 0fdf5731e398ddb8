"""Readers: span exports, metric documents and trajectory files, with schemas given and nothing inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from spanloom.schema import EXPORT_LINE
from spanloom.functions.scalar import nanoseconds, text


def read_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines, malformed): one span per JSON line; blank lines are skipped by the reader."""
    lines = spark.read.schema(EXPORT_LINE).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    bad = lines.where("_corrupt_record IS NOT NULL").select("_corrupt_record")
    return lines.where("_corrupt_record IS NULL").drop("_corrupt_record"), bad


def spans_from_export(lines: DataFrame) -> DataFrame:
    """Export lines in the canonical span shape; nanoseconds are kept beside the timestamp."""
    attrs = F.coalesce("SpanAttributes", F.create_map().cast("map<string,string>"))
    parallel = F.arrays_zip(
        F.coalesce("`Events.Timestamp`", F.array().cast("array<string>")).alias("t"), F.coalesce("`Events.Name`", F.array().cast("array<string>")).alias("n"),
        F.coalesce("`Events.Attributes`", F.array().cast("array<map<string,string>>")).alias("a"))
    events = F.transform(parallel, lambda e: F.struct(
        F.try_to_timestamp(e["t"]).cast("timestamp_ntz").alias("ts"), e["n"].alias("name"), e["a"].alias("attributes")))
    pick = lambda key: text(attrs.getItem(key))
    filled = lambda *cols: F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))
    return lines.select(
        F.try_to_timestamp(F.col("Timestamp")).cast("timestamp_ntz").alias("ts"), nanoseconds(F.col("Timestamp")).alias("ts_ns"),
        text(F.col("TraceId")).alias("trace_id"), text(F.col("SpanId")).alias("span_id"), text(F.col("SpanName")).alias("span_name"),
        filled(pick("application_id"), F.col("ServiceName")).alias("application_id"), filled(F.col("SessionId"), pick("session.id")).alias("session_id"),
        filled(F.col("AgentId"), pick("agent_id")).alias("agent_id"), F.coalesce("Duration", F.lit(0)).alias("duration"),
        text(F.col("StatusCode")).alias("status_code"), text(F.col("StatusMessage")).alias("status_message"),
        text(F.col("ParentSpanId")).alias("parent_span_id"), text(F.col("ServiceName")).alias("service_name"), attrs.alias("attrs"), events.alias("events"))


def read_metric_documents(spark: SparkSession, path: str) -> DataFrame:
    """CSV with one JSON document per row in ``Metrics``; quotes inside are doubled."""
    names = ["ID", "SpanId", "TraceId", "SessionId", "Timestamp", "Metrics", "AppName", "AppId", "Scope", "agent_id"]
    shape = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.schema(shape).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return rows.select(
        F.col("ID").alias("id"), F.col("SessionId").alias("session_id"), F.try_to_timestamp(F.col("Timestamp")).alias("ts"),
        F.col("Metrics").alias("metrics"), text(F.col("AppId")).alias("application_id"), text(F.col("agent_id")).alias("agent_id"))


# Where a trajectory file may state its session, in the order tried: own keys, then keys of a map.
SESSION_KEYS = ["SessionId", "session_id", "sessionId"]
SESSION_MAPS = [("SpanAttributes", "session.id"), ("attributes", "session.id"), ("ResourceAttributes", "session.id")]
_MAP = "map<string,string>"


def read_trajectories(spark: SparkSession, path: str, layout: str = "lines", envelope: str = "spans") -> DataFrame:
    """Spans of trajectory files: JSON lines, one JSON array per file, or an object that holds the array.

    Exports differ in the case of their keys, so spans are read as maps and keys looked up exactly.
    """
    raw = spark.read.text(path, wholetext=layout != "lines").withColumn("file", F.input_file_name())
    raw = raw.where(F.trim("value") != "")
    if layout == "lines":
        rows = raw.select("file", F.from_json("value", _MAP).alias("s"))
    else:
        text_ = F.col("value") if layout == "array" else F.get_json_object("value", f"$.{envelope}")
        rows = raw.select("file", F.explode(F.from_json(text_, f"array<{_MAP}>")).alias("s"))
    one = lambda *keys: F.coalesce(*[F.nullif(F.col("s").getItem(k), F.lit("")) for k in keys], F.lit(""))
    nested = [F.nullif(F.from_json(F.col("s").getItem(m), _MAP).getItem(k), F.lit("")) for m, k in SESSION_MAPS]
    return rows.select(
        one("SpanId", "span_id").alias("span_id"), one("SpanName", "name").alias("span_name"), one("Timestamp", "timestamp").alias("timestamp"),
        F.coalesce(F.nullif(one(*SESSION_KEYS), F.lit("")), *nested, F.lit("")).alias("session_id"),
        F.from_json(F.coalesce(F.col("s").getItem("SpanAttributes"), F.col("s").getItem("attributes")), _MAP).alias("attrs"), "file")


def trajectory_conflicts(rows: DataFrame) -> DataFrame:
    """What makes a file unusable: span ids that repeat, and more than one session in it."""
    twice = rows.groupBy("file", "span_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("file", F.lit("duplicate span").alias("problem"), F.col("span_id").alias("detail"))
    mixed = rows.where("session_id <> ''").groupBy("file").agg(F.min("session_id").alias("a"), F.max("session_id").alias("b")).where("a <> b").select(
        "file", F.lit("mixed sessions").alias("problem"), F.concat_ws(" / ", "a", "b").alias("detail"))
    return twice.unionByName(mixed)


# -- texts of attributes --------------------------------------------------------------------


def parse_attributes(raw: Column) -> Column:
    """Attribute text -> map: JSON, or ``{'k':'v'}`` whose pairs are picked by pattern."""
    as_json = F.from_json(raw, "map<string,string>", {"mode": "PERMISSIVE"})
    pattern = r"'([^']*?)'\s*:\s*'((?:[^'\\]|\\.|'')*)'"
    pairs = F.arrays_zip(F.regexp_extract_all(raw, F.lit(pattern), 1), F.regexp_extract_all(raw, F.lit(pattern), 2))
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(
        F.map_filter(m, lambda k, _: k != p["0"]), F.create_map(p["0"], p["1"])))
    is_json = raw.rlike(r'^\s*\{\s*("|\})')
    return F.when(is_json, as_json).otherwise(last)


def parse_event_maps(raw: Column) -> Column:
    """``{'{k=v, k2=v2}', ...}`` -> array of maps; a value may hold ``, `` but no ``=``."""
    blocks = F.regexp_extract_all(raw, F.lit(r"'\{([^}]*)\}'"), 1)
    parts = lambda b: F.filter(F.split(b, r", (?=[^,=]*=)"), lambda p: p.contains("="))
    as_map = lambda b: F.map_from_entries(F.transform(parts(b), lambda p: F.struct(
        F.trim(F.substring_index(p, "=", 1)), F.trim(F.substr(p, F.length(F.substring_index(p, "=", 1)) + 2)))))
    return F.transform(blocks, as_map)


def flattened_messages(attrs: Column, prefix: str) -> Column:
    """``<prefix>.N.role`` and ``<prefix>.N.content`` keys -> messages in order of N."""
    role = "assistant" if "completion" in prefix else "user"
    pattern = "^" + prefix.replace(".", r"\.") + r"\.(\d+)\.(role|content|tool_call_id)$"
    keys = F.filter(F.map_keys(attrs), lambda k: k.rlike(pattern))
    numbers = F.array_sort(F.array_distinct(F.transform(keys, lambda k: F.regexp_extract(k, pattern, 1).cast("int"))))
    at = lambda i, part: attrs.getItem(F.concat(F.lit(prefix + "."), i.cast("string"), F.lit("." + part)))
    made = F.transform(numbers, lambda i: F.struct(
        F.coalesce(F.lower(F.trim(at(i, "role"))), F.lit(role)).alias("role"), F.coalesce(at(i, "content"), F.lit("")).alias("content"),
        F.coalesce(F.trim(at(i, "tool_call_id")), F.lit("")).alias("tool_call_id")))
    return F.filter(made, lambda m: (m["content"] != "") | (m["role"].isin("tool", "function") & (m["tool_call_id"] != "")))


# USD per token shown in the detail view.
COST_PER_TOKEN = 2.5e-6


def span_view(attrs: Column, status: Column, events: Column) -> Column:
    """Input, output, token count and error message of a span as shown in its detail view."""
    first = lambda *names: F.coalesce(*[F.nullif(F.nullif(attrs.getItem(n), F.lit("")), F.lit('""')) for n in names], F.lit(""))
    failed = F.filter(events, lambda e: e["attributes"].getItem("exception.message").isNotNull())
    message = F.when((status == "Error") & (F.size(failed) > 0), F.get(failed, 0)["attributes"].getItem("exception.message")).otherwise("")
    tokens = F.coalesce(attrs.getItem("gen_ai.usage.input_tokens").try_cast("bigint"), F.lit(0))
    return F.struct(
        first("gen_ai.input.messages", "gen_ai.tool.call.arguments", "ioa_observe.entity.input", "traceloop.entity.input").alias("input"),
        first("gen_ai.output.messages", "gen_ai.tool.call.result", "ioa_observe.entity.output", "traceloop.entity.output").alias("output"),
        tokens.alias("input_tokens"), (tokens * COST_PER_TOKEN).alias("input_cost"), message.alias("error"))
