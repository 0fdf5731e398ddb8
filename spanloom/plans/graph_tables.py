"""Graph tables of a data folder, built once per session, and the oracle's version of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.operators.graph_build import build_graph, calls
from spanloom.sources.fixtures import oracle_define, spans, stored

def call_table(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "calls", lambda: calls(spans(spark, d)))


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    made = lambda i: lambda: build_graph(spans(spark, d), call_table(spark, d))[i]
    return stored(spark, d, "nodes", made(0)), stored(spark, d, "edges", made(1))


def _id(prefix: str, *parts: str) -> str:
    joined = " || chr(31) || ".join(parts)
    return f"('{prefix}:' || substr(sha1({joined}), 1, 12))"


oracle_define("g_calls", f"""
SELECT span_id, parent_span_id, ts, session_key AS session, application_id AS application, agent_id AS agent,
 CASE kind WHEN 'chat' THEN 'llm' ELSE kind END AS kind, status_code <> 'Error' AS success,
 epoch_us(ts) / 1e6 AS t0, duration / 1e6 AS dur, epoch_us(ts) / 1e6 + duration / 1e9 AS t1, k, in_text, out_text,
 coalesce(provider, '') AS provider, coalesce(model, '') AS model, coalesce(entity_name, '') AS entity,
 CASE kind WHEN 'agent' THEN {_id('agentcall', 'agent_id', 'span_id')} WHEN 'chat' THEN {_id('llmcall', 'provider', 'model', 'span_id')}
  ELSE {_id('toolcall', 'entity_name', 'span_id')} END AS call_id,
 CASE kind WHEN 'agent' THEN agent_id WHEN 'chat' THEN 'llm-' || provider || '-' || model ELSE entity_name END AS target,
 {_id('state', 'span_id', "'initial'", 'in_text')} AS s0, {_id('state', 'span_id', "'final'", 'out_text')} AS s1,
 {_id('transition', 'span_id', 'in_text', 'out_text')} AS tr, last_agent_span,
 CASE WHEN kind <> 'agent' THEN last_agent_span ELSE '' END AS owner_span,
 CASE WHEN kind = 'agent' AND k % 6 = 0 THEN last_agent_span ELSE '' END AS source_span
FROM tree WHERE kind IN ('agent', 'chat', 'tool')""")

oracle_define("g_owned", """
SELECT c.*, o.call_id AS o_call, o.s0 AS o_s0, o.s1 AS o_s1, o.in_text AS o_in, o.out_text AS o_out, o.t0 AS o_t0, o.t1 AS o_t1
FROM g_calls c JOIN g_calls o ON o.kind = 'agent' AND o.span_id = c.owner_span WHERE c.kind <> 'agent'""")

oracle_define("g_top", """
SELECT c.* FROM g_calls c WHERE kind = 'agent' AND NOT EXISTS (SELECT 1 FROM g_calls p WHERE p.kind = 'agent' AND p.span_id = c.parent_span_id AND p.session = c.session)""")

oracle_define("g_pairs", """
SELECT 'handoff' AS bridge, t.session, 'mascall:' || t.session AS attach, s.s1 AS a_state, s.out_text AS a, t.s0 AS b_state, t.in_text AS b, s.t1 AS p0, t.t0 AS p1
FROM g_calls t JOIN g_calls s ON s.kind = 'agent' AND s.span_id = t.source_span WHERE t.source_span <> ''
UNION ALL
SELECT 'handoff-fallback', session, 'mascall:' || session, ps1, pout, s0, in_text, pt1, t0 FROM (
 SELECT *, lag(s1) OVER w AS ps1, lag(out_text) OVER w AS pout, lag(t1) OVER w AS pt1 FROM g_top WINDOW w AS (PARTITION BY session ORDER BY t0, span_id))
WHERE ps1 IS NOT NULL AND source_span = ''
UNION ALL
SELECT 'capability-chain', session, o_call, ps1, pout, s0, in_text, pt1, t0 FROM (
 SELECT *, lag(s1) OVER w AS ps1, lag(out_text) OVER w AS pout, lag(t1) OVER w AS pt1 FROM g_owned
 WINDOW w AS (PARTITION BY o_call ORDER BY t0, kind, span_id)) WHERE ps1 IS NOT NULL
UNION ALL
SELECT 'capability-chain-boundary', session, o_call, o_s0, o_in, s0, in_text, o_t0, t0 FROM (
 SELECT *, row_number() OVER (PARTITION BY o_call ORDER BY t0, kind, span_id) AS rn FROM g_owned) WHERE rn = 1
UNION ALL
SELECT 'capability-chain-boundary', session, o_call, s1, out_text, o_s1, o_out, t1, o_t1 FROM (
 SELECT *, row_number() OVER (PARTITION BY o_call ORDER BY t0 DESC, kind DESC, span_id DESC) AS rn FROM g_owned) WHERE rn = 1""")

oracle_define("g_bridges", f"""
SELECT *, {_id('processingcall', 'bridge', 'a_state', 'b_state')} AS call_id, {_id('transition', 'bridge', 'a_state', 'b_state')} AS tr
FROM g_pairs WHERE a <> b""")

oracle_define("g_sessions", """
SELECT c.session, c.app, c.c0, c.first_span, c.marked, a.a0, a.a_app, e.e1, e.e_ok, c.start_ok FROM (
 SELECT session, min(struct_pack(t := t, s := span_id)) AS f, arg_min(app, struct_pack(t := t, s := span_id)) AS app,
  min(t) AS c0, arg_min(span_id, struct_pack(t := t, s := span_id)) AS first_span, arg_min(marked, struct_pack(t := t, s := span_id)) AS marked,
  arg_min(ok, struct_pack(t := t, s := span_id)) AS start_ok FROM (
  SELECT session_key AS session, epoch_us(ts) / 1e6 AS t, span_id, application_id AS app, span_name = 'session.start' AS marked, status_code <> 'Error' AS ok
  FROM flat WHERE span_name = 'session.start' OR kind = 'agent') GROUP BY 1) c
LEFT JOIN (SELECT session, min(t0) AS a0, arg_min(application, struct_pack(t := t0, s := span_id)) AS a_app FROM g_calls WHERE kind = 'agent' GROUP BY 1) a ON a.session = c.session
LEFT JOIN (SELECT m.session_key AS session, arg_max(epoch_us(m.ts) / 1e6, struct_pack(t := m.ts, s := m.span_id)) AS e1,
  arg_max(m.status_code <> 'Error', struct_pack(t := m.ts, s := m.span_id)) AS e_ok
  FROM flat m JOIN (SELECT session_key, min(struct_pack(t := ts, s := span_id)) AS f FROM flat WHERE span_name = 'session.start' OR kind = 'agent' GROUP BY 1) x
   ON x.session_key = m.session_key AND m.span_name = 'session.end' AND struct_pack(t := m.ts, s := m.span_id) > x.f GROUP BY 1) e ON e.session = c.session""")

oracle_define("g_box", f"""
SELECT session, owner, s0, s1, {_id('transition', "'container-boundary'", 'owner', 's0', 's1')} AS tr FROM (
 SELECT session, s0, s1, unnest([session, 'mascall:' || session]) AS owner FROM (
  SELECT session, arg_min(s0, struct_pack(t := t0, s := span_id)) AS s0, arg_max(s1, struct_pack(t := t0, s := span_id)) AS s1
  FROM g_calls WHERE kind = 'agent' GROUP BY 1))""")

oracle_define("g_declared", """
SELECT DISTINCT application_id AS app, unnest(['agent' || CAST(k % 4 AS VARCHAR) || '.invoke', 'agent' || CAST(user_id % 6 AS VARCHAR) || '.invoke']) AS agent FROM flat WHERE kind = 'graph'""")

oracle_define("g_nodes", """
SELECT CASE kind WHEN 'agent' THEN 'AgentCall' WHEN 'llm' THEN 'LLMCall' ELSE 'ToolCall' END AS node_type, call_id AS id, session AS session_id,
  t0 AS start_time, t1 AS end_time, dur AS duration, success, span_id, NULL AS content FROM g_calls
UNION ALL SELECT 'State', s0, session, NULL, NULL, NULL, NULL, NULL, CASE WHEN in_text = '' THEN '(no content recorded)' ELSE in_text END FROM g_calls
UNION ALL SELECT 'State', s1, session, NULL, NULL, NULL, NULL, NULL, CASE WHEN out_text = '' THEN '(no content recorded)' ELSE out_text END FROM g_calls
UNION ALL SELECT 'Transition', tr, session, NULL, NULL, NULL, NULL, NULL, NULL FROM g_calls
UNION ALL SELECT 'Transition', tr, session, NULL, NULL, NULL, NULL, NULL, NULL FROM g_box
UNION ALL SELECT 'Transition', tr, session, NULL, NULL, NULL, NULL, NULL, NULL FROM g_bridges
UNION ALL SELECT 'ProcessingCall', call_id, session, p0, p1, greatest(0.0, (p1 - p0) * 1000), NULL, NULL, NULL FROM g_bridges
UNION ALL SELECT DISTINCT 'Processing', 'processing:' || bridge, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM g_bridges
UNION ALL SELECT 'Session', session, session, c0, coalesce(e1, c0), greatest(0.0, (coalesce(e1, c0) - c0) * 1000),
  coalesce(e_ok, CASE WHEN marked THEN start_ok END), CASE WHEN marked THEN first_span END, NULL FROM g_sessions
UNION ALL SELECT 'MASCall', 'mascall:' || session, session, a0, a0, 0.0, NULL, NULL, NULL FROM g_sessions WHERE a0 IS NOT NULL
UNION ALL SELECT DISTINCT CASE kind WHEN 'llm' THEN 'LLM' ELSE 'Tool' END, target, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM g_calls WHERE kind <> 'agent'
UNION ALL SELECT 'Agent', agent, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT agent FROM g_calls WHERE kind = 'agent' UNION SELECT agent FROM g_declared)
UNION ALL SELECT 'MAS', app, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT app FROM g_sessions UNION SELECT application_id FROM flat WHERE kind = 'graph')""")

oracle_define("g_states_of", """
SELECT call_id AS owner, s0, s1, tr FROM g_calls UNION ALL SELECT owner, s0, s1, tr FROM g_box UNION ALL SELECT call_id, a_state, b_state, tr FROM g_bridges""")

oracle_define("g_edges", """
SELECT DISTINCT edge_type, from_id, to_id FROM (
SELECT CASE kind WHEN 'agent' THEN 'executesAgent' WHEN 'llm' THEN 'executesLLM' ELSE 'executesTool' END AS edge_type, call_id AS from_id, target AS to_id FROM g_calls
UNION ALL SELECT 'hasAgentCall', 'mascall:' || session, call_id FROM g_calls WHERE kind = 'agent'
UNION ALL SELECT CASE kind WHEN 'llm' THEN 'hasLLMCall' ELSE 'hasToolCall' END, o_call, call_id FROM g_owned
UNION ALL SELECT CASE kind WHEN 'llm' THEN 'usesLLM' ELSE 'usesTool' END, agent, target FROM g_calls WHERE kind <> 'agent'
UNION ALL SELECT 'belongsToMAS', agent, application FROM g_calls WHERE kind = 'agent'
UNION ALL SELECT 'belongsToMAS', agent, app FROM g_declared
UNION ALL SELECT 'executesSession', session, app FROM g_sessions
UNION ALL SELECT 'hasMASCall', session, 'mascall:' || session FROM g_sessions WHERE a0 IS NOT NULL
UNION ALL SELECT 'executesMAS', 'mascall:' || session, a_app FROM g_sessions WHERE a0 IS NOT NULL
UNION ALL SELECT 'executesProcessing', call_id, 'processing:' || bridge FROM g_bridges
UNION ALL SELECT 'hasProcessingCall', attach, call_id FROM g_bridges
UNION ALL SELECT 'hasInitialState', owner, s0 FROM g_states_of UNION ALL SELECT 'hasState', owner, s0 FROM g_states_of
UNION ALL SELECT 'hasFinalState', owner, s1 FROM g_states_of UNION ALL SELECT 'hasState', owner, s1 FROM g_states_of
UNION ALL SELECT 'inputTo', s0, tr FROM g_states_of UNION ALL SELECT 'leadsTo', tr, s1 FROM g_states_of
UNION ALL SELECT 'correspondsToTransition', owner, tr FROM g_states_of UNION ALL SELECT 'representsExecution', tr, owner FROM g_states_of)""")
