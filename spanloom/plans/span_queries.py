"""Queries over raw spans."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from spanloom.functions.scalar import instant, sorted_text
from spanloom.operators import spans as ops
from spanloom.plans.registry import query
from spanloom.sources.fixtures import spans, table

NUM = "CASE WHEN try_cast({0} AS DOUBLE) IS NULL THEN 0.0 ELSE try_cast({0} AS DOUBLE) END"
TOK = f"({NUM.format('input_tokens')} + {NUM.format('output_tokens')})"
BASE = "split_part(agent_id, '.', 1)"
START, END = "2024-01-05 00:00:00", "2024-01-20 12:00:00"
RANGE = f"ts >= TIMESTAMP '{START}' AND ts <= TIMESTAMP '{END}'"
WINDOW = {"start": datetime.fromisoformat(START), "end": datetime.fromisoformat(END)}


def r6(col):
    return F.round(col, 6)


@query("session_spans", "2.1.2", "2.2.32", sql="""
SELECT span_id, session_id, ts, span_name FROM flat WHERE kind IN ('chat', 'tool')""")
def _(s, d):
    return ops.session_spans(spans(s, d), kinds=["chat", "tool"]).select("span_id", "session_id", "ts", "span_name")


@query("session_ids", "2.2.1", sql="SELECT session_id, min(ts) AS first_ts FROM flat WHERE session_id <> '' GROUP BY 1")
def _(s, d):
    return ops.distinct_ids(spans(s, d))


@query("application_ids", "2.2.2", sql=f"""
SELECT application_id, min(ts) AS first_ts FROM flat WHERE application_id <> '' AND {RANGE} GROUP BY 1""")
def _(s, d):
    return ops.distinct_ids(spans(s, d), "application_id", **WINDOW)


@query("trace_list", "2.2.3", sql="""
SELECT trace_id, min(application_id) AS application_id, min(ts) AS first_ts, max(ts) AS last_ts FROM flat GROUP BY 1""")
def _(s, d):
    return ops.traces(spans(s, d))


@query("session_summaries", "2.2.4", sql=f"""
SELECT session_id, application_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_spans FROM flat
WHERE {RANGE} GROUP BY 1, 2""")
def _(s, d):
    return ops.session_summaries(spans(s, d), **WINDOW)


@query("session_agents", "2.2.5", sql="""
SELECT session_id, span_name AS agent, ts, span_id FROM flat WHERE span_name LIKE '%.agent'""")
def _(s, d):
    return ops.session_agents(spans(s, d))


@query("session_page_in_window", "2.2.6", sql=f"""
SELECT session_id, min(ts) AS first_ts FROM flat WHERE session_id <> '' AND {RANGE} GROUP BY 1
ORDER BY first_ts DESC, session_id LIMIT 20 OFFSET 10""")
def _(s, d):
    return ops.distinct_ids(spans(s, d), **WINDOW).offset(10).limit(20)


@query("application_list", "2.2.7", sql="SELECT application_id, min(ts) AS first_ts, max(ts) AS last_ts FROM flat GROUP BY 1")
def _(s, d):
    return ops.application_list(spans(s, d))


@query("application_sessions", "2.2.8", sql="SELECT application_id, session_id, max(ts) AS last_ts FROM flat GROUP BY 1, 2")
def _(s, d):
    return ops.application_sessions(spans(s, d))


@query("application_overview", "2.2.9", "2.3.1", sql=f"""
WITH st AS (SELECT application_id, session_id, max(ts) AS last_ts FROM flat WHERE {RANGE} GROUP BY 1, 2),
 tk AS (SELECT session_id, sum({TOK}) AS total_tokens FROM flat WHERE span_name LIKE '%.chat' GROUP BY 1),
 ag AS (SELECT application_id, string_agg(DISTINCT {BASE}, ',' ORDER BY {BASE}) AS agents FROM flat WHERE {RANGE} GROUP BY 1),
 lm AS (SELECT application_id, string_agg(DISTINCT model, ',' ORDER BY model) AS llms FROM flat
        WHERE {RANGE} AND span_name LIKE '%.chat' GROUP BY 1)
SELECT st.application_id, st.session_id, last_ts, total_tokens, agents, llms FROM st
LEFT JOIN tk USING (session_id) LEFT JOIN ag USING (application_id) LEFT JOIN lm USING (application_id)""")
def application_overview(s, d):
    out = ops.application_overview(spans(s, d), **WINDOW)
    return out.withColumns({"agents": sorted_text("agents"), "llms": sorted_text("llms")})


@query("model_names", "2.2.10", sql="SELECT DISTINCT application_id, model FROM flat WHERE span_name LIKE '%.chat'")
def _(s, d):
    return ops.model_names(spans(s, d))


@query("agent_names", "2.2.11", sql=f"SELECT DISTINCT application_id, {BASE} AS agent FROM flat")
def _(s, d):
    return ops.agent_names(spans(s, d))


@query("span_detail", "2.2.12", sql="""
SELECT span_id, coalesce(model, '') AS model, CASE WHEN kind = 'note' THEN 1 ELSE 0 END AS n_events FROM flat""")
def _(s, d):
    return ops.span_detail(spans(s, d)).select(
        "span_id", F.coalesce(F.col("attrs").getItem("gen_ai.request.model"), F.lit("")).alias("model"),
        F.size("events").cast("bigint").alias("n_events"),
    )


@query("agent_spans", "2.2.13", sql=f"""
SELECT application_id, session_id, {BASE} AS agent, count(*) AS n FROM flat WHERE span_name NOT LIKE '%\\_\\_init\\_run%' ESCAPE '\\'
GROUP BY 1, 2, 3""")
def _(s, d):
    found = ops.agent_spans(spans(s, d))
    return found.groupBy("application_id", "session_id", ops.base_name("agent_id").alias("agent")).agg(F.count(F.lit(1)).alias("n"))


@query("agent_descriptions", "2.2.13", "2.2.37", sql=f"""
SELECT application_id, {BASE} AS agent, arg_min(concat('does ', CAST(k % 3 AS VARCHAR)), struct_pack(a := ts, b := span_id)) AS description
FROM flat WHERE kind = 'note' GROUP BY 1, 2""")
def _(s, d):
    return ops.agent_descriptions(spans(s, d))


@query("agent_start_events", "2.2.37", sql="""
SELECT session_id, application_id, span_id, ts, agent_id, concat('does ', CAST(k % 3 AS VARCHAR)) AS description
FROM flat WHERE kind = 'note'""")
def _(s, d):
    return ops.agent_start_events(spans(s, d))


@query("agent_tokens", "2.2.14", sql=f"""
SELECT session_id, {BASE} AS agent, sum({NUM.format('input_tokens')}) AS input_tokens,
 sum({NUM.format('output_tokens')}) AS output_tokens, string_agg(DISTINCT model, ',' ORDER BY model) AS models
FROM flat WHERE kind = 'chat' GROUP BY 1, 2""")
def _(s, d):
    return ops.agent_tokens(spans(s, d)).withColumn("models", sorted_text("models"))


@query("root_span_range", "2.2.15", sql="""
SELECT application_id, min(ts) AS first_ts, max(ts) AS last_ts FROM tree WHERE parent_span_id = '' GROUP BY 1""")
def _(s, d):
    return ops.root_span_range(spans(s, d), ["application_id"])


@query("conversation_counts", "2.2.16", sql=f"""
SELECT application_id, count(DISTINCT {BASE} || '|' || session_id) AS n_conversations FROM flat WHERE kind = 'chat' GROUP BY 1""")
def _(s, d):
    return ops.conversation_count(spans(s, d), ["application_id"])


@query("agent_counts", "2.2.17", sql=f"SELECT session_id, count(DISTINCT {BASE}) AS n_agents FROM flat GROUP BY 1")
def _(s, d):
    return ops.agent_count(spans(s, d), ["session_id"])


@query("agent_activity", "2.2.18", "2.2.20", "2.2.22", "2.2.23", sql=f"""
SELECT application_id, {BASE} AS agent, count(*) AS n_spans, count(*) FILTER (status_code = 'Error') AS n_failures,
 count(DISTINCT session_id) AS n_sessions, round(avg(CASE WHEN kind = 'agent' THEN duration END), 6) AS mean_duration
FROM flat GROUP BY 1, 2""")
def _(s, d):
    return ops.agent_activity(spans(s, d)).withColumn("mean_duration", r6("mean_duration"))


@query("top_agent", "2.2.19", sql=f"SELECT {BASE} AS agent, count(*) AS n_spans FROM flat GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def _(s, d):
    return ops.top_agent(spans(s, d))


@query("agent_costs", "2.2.21", sql=f"""
WITH price AS (SELECT concat('MODEL', CAST(p_partkey AS VARCHAR)) AS model, p_retailprice / 1e9 AS ip, p_retailprice / 5e8 AS op FROM part WHERE p_partkey <> 1),
 d AS (SELECT ip, op FROM price WHERE model = 'MODEL7')
SELECT application_id, {BASE} AS agent, sum({NUM.format('input_tokens')}) AS input_tokens, sum({NUM.format('output_tokens')}) AS output_tokens,
 round(sum({NUM.format('input_tokens')} * coalesce(p.ip, d.ip) + {NUM.format('output_tokens')} * coalesce(p.op, d.op)), 6) AS cost
FROM flat f LEFT JOIN price p ON lower(f.model) = lower(p.model) CROSS JOIN d WHERE kind = 'chat' GROUP BY 1, 2""")
def _(s, d):
    return ops.agent_costs(spans(s, d), price_list(s, d), "model7").withColumn("cost", r6("cost"))


def price_list(s, d):
    """Prices per model, one row per part; model names in upper case as some lists have them."""
    part = table(s, d, "part").where("p_partkey <> 1")
    return part.select(
        F.concat(F.lit("MODEL"), F.col("p_partkey").cast("string")).alias("model"),
        (F.col("p_retailprice") / 1e9).alias("input_price"), (F.col("p_retailprice") / 5e8).alias("output_price"),
    )


@query("mean_session_duration", "2.2.24", sql="""
SELECT application_id, round(avg((epoch_us(b) - epoch_us(a)) / 1e6), 6) AS mean_seconds FROM
 (SELECT application_id, session_id, min(ts) AS a, max(ts) AS b FROM flat GROUP BY 1, 2) GROUP BY 1""")
def _(s, d):
    return ops.mean_session_duration(spans(s, d), ["application_id"]).withColumn("mean_seconds", r6("mean_seconds"))


@query("span_counts", "2.2.16", "2.2.25", sql="""
SELECT application_id, session_id, count(*) AS n_spans, count(*) FILTER (kind = 'chat') AS n_llm,
 count(*) FILTER (kind = 'tool') AS n_tool, count(*) FILTER (status_code = 'Error') AS n_errors FROM flat GROUP BY 1, 2""")
def _(s, d):
    return ops.span_counts(spans(s, d), ["application_id", "session_id"])


@query("token_sums", "2.2.26", "2.12.2", sql=f"SELECT session_id, sum({TOK}) AS tokens FROM flat WHERE kind = 'chat' GROUP BY 1")
def _(s, d):
    return ops.token_sums(spans(s, d))


@query("agents_per_session", "2.2.27", sql=f"SELECT DISTINCT session_id, {BASE} AS agent FROM flat")
def _(s, d):
    return ops.agents_per_session(spans(s, d))


@query("llm_spans_by_attribute", "2.2.28", sql="""
SELECT session_key, count(*) AS n, CAST(sum(k) AS BIGINT) AS checksum FROM flat WHERE kind = 'chat' GROUP BY 1""")
def _(s, d):
    found = ops.llm_spans(spans(s, d))
    tokens = F.col("attrs").getItem("gen_ai.usage.input_tokens").cast("bigint")
    return found.groupBy("session_key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(tokens / 10)).alias("checksum"))


@query("sessions_of_agents", "2.2.29", sql=f"""
SELECT DISTINCT application_id, {BASE} AS agent, session_id FROM flat WHERE {RANGE}""")
def _(s, d):
    return ops.sessions_of_agents(spans(s, d), **WINDOW)


@query("tool_details", "2.2.30", "2.2.31", sql="""
SELECT application_id, split_part(span_name, '.', 1) AS tool, round(avg(CASE WHEN status_code = 'Error' THEN 0.0 ELSE 1.0 END), 6) AS success,
 count(DISTINCT session_id) AS n_sessions, round(avg(duration / 1e6), 6) AS mean_ms FROM flat WHERE kind = 'tool' GROUP BY 1, 2""")
def _(s, d):
    out = ops.tool_details(spans(s, d), ["application_id"])
    return out.withColumns({"success": r6("success"), "mean_ms": r6("mean_ms")})


@query("frequent_errors", "2.2.33", sql="""
SELECT application_id, status_message AS error, count(*) AS n FROM flat WHERE status_code = 'Error' AND status_message <> '' GROUP BY 1, 2""")
def _(s, d):
    return ops.frequent_errors(spans(s, d), ["application_id"])


@query("agent_duration_percentiles", "2.2.34", sql="""
SELECT application_id, n, max(CASE WHEN rn = least(CAST(floor(n * 0.9) AS BIGINT), n - 1) + 1 THEN duration END) AS p90,
 max(CASE WHEN rn = least(CAST(floor(n * 0.95) AS BIGINT), n - 1) + 1 THEN duration END) AS p95 FROM
 (SELECT application_id, duration, row_number() OVER (PARTITION BY application_id ORDER BY duration) AS rn,
  count(*) OVER (PARTITION BY application_id) AS n FROM flat WHERE kind = 'agent') GROUP BY 1, 2""")
def _(s, d):
    return ops.agent_duration_percentiles(spans(s, d))


@query("graph_sessions", "2.2.36", sql="""
SELECT session_id, application_id, min(ts) AS first_ts, max(ts) AS last_ts FROM flat WHERE kind = 'graph' GROUP BY 1, 2""")
def _(s, d):
    return ops.graph_sessions(spans(s, d))


@query("span_types", "2.2.38", "2.12.1", sql="""
SELECT span_id, CASE kind WHEN 'chat' THEN 'llm' WHEN 'tool' THEN 'tool' WHEN 'agent' THEN 'agent' ELSE 'other' END AS span_type FROM flat""")
def _(s, d):
    return spans(s, d).select("span_id", ops.span_type(F.col("span_name"), F.col("attrs")).alias("span_type"))


@query("first_exports", "2.2.39", sql="""
SELECT session_id, ts, span_id, copies FROM (
 SELECT *, count(*) OVER (PARTITION BY session_id, fp) AS copies, row_number() OVER (PARTITION BY session_id, fp ORDER BY ts, span_id) AS rn FROM (
  SELECT session_id, ts, span_id, CASE
   WHEN kind = 'agent' AND in_text || out_text <> '' THEN concat('a|', entity_name, '|', in_text, '|', out_text)
   WHEN kind = 'chat' AND in_text || out_text <> '' THEN concat('c|', in_text, '|', out_text) ELSE span_id END AS fp FROM flat))
WHERE rn = 1""")
def _(s, d):
    return ops.first_exports(spans(s, d)).select("session_id", "ts", "span_id", "copies")


@query("time_range_normalisation", "2.2.40", sql="""
SELECT span_id, CAST(epoch_us(ts) AS BIGINT) // 1000 AS ms_in, CAST(epoch_us(ts) AS BIGINT) // 1000 AS ms_out, CAST(epoch_us(date_trunc('second', ts)) AS BIGINT) // 1000000 AS s_out, CAST(epoch_us(date_trunc('second', ts)) AS BIGINT) // 1000000 AS iso_out FROM flat""")
def _(s, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ms = F.floor(us / 1000)
    iso = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return spans(s, d).select(
        "span_id", ms.alias("ms_in"), F.unix_millis(instant(ms)).alias("ms_out"),
        F.unix_seconds(instant(F.floor(us / 1_000_000))).alias("s_out"), F.unix_seconds(instant(iso)).alias("iso_out"),
    )
