"""Queries that turn spans into the graph, part by part and end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.scalar import short_id
from spanloom.operators import graph_build as gb
from spanloom.plans.graph_tables import call_table, graph
from spanloom.plans.registry import query
from spanloom.sources.fixtures import spans, table


@query("span_fields", "2.5.1", sql="""
SELECT span_id, application_id AS application, session_key AS session, agent_id AS agent, status_code <> 'Error' AS success,
 round(epoch_us(ts) / 1e6, 6) AS start, round(epoch_us(ts) / 1e6 + duration / 1e9, 6) AS end_time, duration / 1e6 AS duration_ms FROM flat""")
def _(s, d):
    f = gb.fields(spans(s, d))
    return f.select("span_id", "application", "session", "agent", "success", F.round("start", 6).alias("start"),
                    F.round("end", 6).alias("end_time"), "duration_ms")


@query("short_ids", "2.5.2", sql="""
SELECT span_id, 'x:' || substr(sha1(application_id || chr(31) || session_id || chr(31) || span_id), 1, 12) AS id FROM flat""")
def _(s, d):
    return spans(s, d).select("span_id", short_id("x", F.col("application_id"), F.col("session_id"), F.col("span_id")).alias("id"))


@query("graph_sessions_and_containers", "2.5.3", sql="""
SELECT node_type, id, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, round(duration, 3) AS duration, CASE success WHEN TRUE THEN 'y' WHEN FALSE THEN 'n' ELSE '?' END AS success
FROM g_nodes WHERE node_type IN ('Session', 'MASCall')""")
def _(s, d):
    nodes, _, _ = gb.containers(spans(s, d), call_table(s, d))
    ok = F.when(F.col("success"), "y").when(~F.col("success"), "n").otherwise("?")
    return nodes.select("node_type", "id", F.round("start_time", 6).alias("start_time"), F.round("end_time", 6).alias("end_time"),
                        F.round("duration", 3).alias("duration"), ok.alias("success"))


@query("graph_calls", "2.5.4", "2.5.5", "2.5.6", sql="""
SELECT call_id, kind, session, agent, target, success, in_text, out_text, s0 AS initial, s1 AS final, tr AS transition,
 CASE WHEN kind = 'llm' THEN CAST(k * 10 AS BIGINT) ELSE -1 END AS prompt_tokens, CASE WHEN kind = 'llm' AND k % 7 <> 6 THEN k WHEN kind = 'llm' THEN 0 ELSE -1 END AS completion_tokens
FROM g_calls""")
def _(s, d):
    return call_table(s, d).select(
        "call_id", "kind", "session", "agent", "target", "success", "in_text", "out_text", "initial", "final", "transition",
        F.coalesce("prompt_tokens", F.lit(-1)).alias("prompt_tokens"), F.coalesce("completion_tokens", F.lit(-1)).alias("completion_tokens"))


@query("graph_call_owners", "2.5.5", "2.5.6", sql="""
SELECT edge_type, from_id, to_id FROM g_edges WHERE edge_type IN ('hasLLMCall', 'hasToolCall')""")
def _(s, d):
    return gb.owner_edges(call_table(s, d))


@query("graph_declared_structure", "2.5.7", sql="""
SELECT DISTINCT agent AS id, app AS application FROM g_declared""")
def _(s, d):
    _, _, edges = gb.declared_structure(spans(s, d))
    return edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("application"))


@query("graph_declared_names", "2.5.7", "2.5.15", sql="""
WITH dj AS (SELECT agent, arg_min(name, struct_pack(t := ts, s := span_id, n := name)) AS name FROM (
  SELECT 'agent' || CAST(k % 4 AS VARCHAR) || '.invoke' AS agent, 'Lead' AS name, ts, span_id FROM flat WHERE kind = 'graph' AND k % 4 <> user_id % 6
  UNION ALL SELECT 'agent' || CAST(user_id % 6 AS VARCHAR) || '.invoke', 'Aide ' || CAST(user_id % 6 AS VARCHAR), ts, span_id FROM flat WHERE kind = 'graph') GROUP BY 1)
SELECT a.agent AS id, coalesce(dj.name, a.name) AS name, dj.name IS NOT NULL AS declared FROM
 (SELECT agent, max(name) AS name FROM (SELECT agent, entity AS name FROM g_calls WHERE kind = 'agent' UNION ALL SELECT agent, NULL FROM g_declared) GROUP BY 1) a LEFT JOIN dj ON dj.agent = a.agent""")
def _(s, d):
    # The fixture's JSON repeats a key when both agents are the same one; the last entry stands.
    nodes, _ = graph(s, d)
    return nodes.where("node_type = 'Agent'").select("id", "name", "declared")


@query("graph_state_pairs", "2.5.8", sql="""
SELECT node_type, id, session_id, coalesce(content, '') AS content FROM g_nodes WHERE node_type = 'State'""")
def _(s, d):
    nodes = gb.call_nodes(call_table(s, d)).where("node_type = 'State'")
    return nodes.select("node_type", "id", "session_id", F.coalesce("content", F.lit("")).alias("content"))


@query("graph_bridges", "2.5.9", "2.5.11", "2.5.12", "2.3.16", sql="""
SELECT bridge, session, attach, a_state AS from_state, b_state AS to_state, call_id, tr AS transition, round(p0, 6) AS start, round(p1, 6) AS end_time FROM g_bridges""")
def _(s, d):
    b = gb.bridges(call_table(s, d))
    return b.select("bridge", "session", "attach", "from_state", "to_state", "call_id", "transition",
                    F.round("start", 6).alias("start"), F.round("end", 6).alias("end_time"))


@query("graph_explicit_handoffs", "2.5.10", "2.3.16", sql="""
SELECT s.call_id AS source, t.call_id AS target FROM g_calls t JOIN g_calls s ON s.kind = 'agent' AND s.span_id = t.source_span WHERE t.source_span <> ''""")
def _(s, d):
    pairs, _ = gb.explicit_handoffs(call_table(s, d))
    return pairs.select(F.col("s.call_id").alias("source"), F.col("t.call_id").alias("target"))


@query("graph_container_states", "2.5.13", sql="""
SELECT DISTINCT unnest(['hasInitialState', 'hasState', 'hasFinalState', 'hasState', 'inputTo', 'leadsTo', 'correspondsToTransition', 'representsExecution']) AS edge_type,
 unnest([owner, owner, owner, owner, s0, tr, owner, tr]) AS from_id, unnest([s0, s0, s1, s1, tr, s1, tr, owner]) AS to_id FROM g_box""")
def _(s, d):
    _, edges = gb.container_states(call_table(s, d))
    return edges.select("edge_type", "from_id", "to_id").distinct()


@query("graph_nodes", "2.5.14", sql="""
SELECT node_type, id, coalesce(session_id, '') AS session_id, coalesce(span_id, '') AS span_id, coalesce(content, '') AS content, round(coalesce(duration, -1), 3) AS duration FROM g_nodes""")
def _(s, d):
    nodes, _ = gb.build_graph(spans(s, d), call_table(s, d))
    none = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return nodes.select("node_type", "id", none("session_id"), none("span_id"), none("content"),
                        F.round(F.coalesce("duration", F.lit(-1.0)), 3).alias("duration"))


@query("graph_edges", "2.5.14", sql="SELECT edge_type, from_id, to_id FROM g_edges")
def _(s, d):
    return gb.build_graph(spans(s, d), call_table(s, d))[1]


@query("first_registered", "2.5.15", sql="""
SELECT session_id, label, labeler FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY CASE labeler WHEN 'b' THEN 0 ELSE 1 END, updated_at) AS rn FROM label_rows) WHERE rn = 1""")
def _(s, d):
    rows = table(s, d, "label_rows").withColumn("rank", F.when(F.col("labeler") == "b", 0).otherwise(1))
    return gb.first_registered(rows, ["session_id"], "rank", ["updated_at"]).select("session_id", "label", "labeler")
