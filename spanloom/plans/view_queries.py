"""Queries for the views of sessions and applications."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import metrics as m
from spanloom.operators import spans as sp
from spanloom.operators import views as v
from spanloom.operators.graph_build import fields
from spanloom.plans.graph_tables import graph
from spanloom.plans.metric_queries import docs, series_sql
from spanloom.plans.registry import query
from spanloom.plans.span_queries import BASE, NUM
from spanloom.sources.fixtures import oracle_define, spans, table


def r6(c):
    return F.round(c, 6)


oracle_define("tree_bounds", """
SELECT session_id, span_id, span_name, parent_span_id AS p, epoch_us(ts) AS a, epoch_us(ts) + CAST(floor(duration / 1e6) AS BIGINT) * 1000 AS b, status_code = 'Error' AS error FROM tree""")
WF = """WITH RECURSIVE d(anc, id) AS (SELECT span_id, span_id FROM tree_bounds UNION ALL SELECT d.anc, t.span_id FROM d JOIN tree_bounds t ON t.p = d.id),
 w AS (SELECT d.anc AS span_id, min(t.a) AS a, max(t.b) AS b FROM d JOIN tree_bounds t ON t.span_id = d.id GROUP BY 1),
 o AS (SELECT t.session_id, t.span_id, t.span_name, CASE WHEN t.p = '' THEN 'root' ELSE t.p END AS parent, CASE WHEN t.p = '' THEN 'agent' ELSE list_last(string_split(t.span_name, '.')) END AS icon, w.a AS starts_us, w.b AS ends_us, (w.b - w.a) // 1000 AS duration_ms, error FROM tree_bounds t JOIN w USING (span_id))"""


@query("waterfall", "2.10.1", sql=WF + " SELECT * FROM o")
def _(s, d):
    return v.waterfall(spans(s, d))


@query("waterfall_roots", "2.10.1", "2.10.2", sql=WF + """
SELECT session_id, coalesce(min(starts_us) FILTER (span_name NOT IN ('session.end')), min(starts_us)) AS starts_us, coalesce(max(ends_us) FILTER (span_name NOT IN ('session.end')), max(ends_us)) AS ends_us,
 (coalesce(max(ends_us) FILTER (span_name NOT IN ('session.end')), max(ends_us)) - coalesce(min(starts_us) FILTER (span_name NOT IN ('session.end')), min(starts_us))) // 1000 AS duration_ms FROM o WHERE parent = 'root' GROUP BY 1""")
def _(s, d):
    return v.root_bounds(v.waterfall(spans(s, d)))


@query("state_machine", "2.10.3", sql="""
WITH c AS (SELECT call_id AS id, session, CASE kind WHEN 'agent' THEN 'agent' ELSE 'call' END AS level, CASE kind WHEN 'agent' THEN '' ELSE kind END AS ct FROM g_calls UNION ALL SELECT call_id, session, 'call', 'processing' FROM g_bridges
 UNION ALL SELECT owner, session, CASE WHEN owner LIKE 'mascall:%' THEN 'mas' ELSE 'session' END, '' FROM g_box)
SELECT DISTINCT c.session AS session_id, s.tr AS transition, s.s0 AS from_state, CASE WHEN s.s0 = b.s0 THEN 'initial' WHEN s.s0 = b.s1 THEN 'final' ELSE 'intermediate' END AS from_role, s.s1 AS to_state,
 CASE WHEN s.s1 = b.s0 THEN 'initial' WHEN s.s1 = b.s1 THEN 'final' ELSE 'intermediate' END AS to_role, c.level, c.ct AS call_type FROM g_states_of s JOIN c ON c.id = s.owner LEFT JOIN g_box b ON b.owner = c.session""")
def _(s, d):
    out = v.state_machine(*graph(s, d))
    return out.select("session_id", "transition", "from_state", "from_role", "to_state", "to_role", "level", F.coalesce("call_type", F.lit("")).alias("call_type"))


@query("state_machine_agents", "2.10.3", sql="SELECT session AS session_id, tr AS transition FROM g_calls WHERE kind = 'agent'")
def _(s, d):
    return v.state_machine(*graph(s, d), levels=["agent"]).select("session_id", "transition")


@query("execution_hierarchy", "2.10.4", sql="""
WITH a AS (SELECT session, call_id AS id, t0 AS start, 1 AS rank, NULL AS own FROM g_calls WHERE kind = 'agent'),
 l AS (SELECT c.session, c.call_id AS id, c.t0 AS start, 2 AS rank, o.o_call AS own FROM g_calls c LEFT JOIN (SELECT call_id, o_call FROM g_owned) o ON o.call_id = c.call_id WHERE c.kind <> 'agent'),
 r AS (SELECT session, 'mascall:' || session AS id, a0 AS start, 0 AS rank, session AS parent FROM g_sessions WHERE a0 IS NOT NULL
  UNION ALL SELECT session, id, start, rank, 'mascall:' || session FROM a
  UNION ALL SELECT l.session, l.id, l.start, 2, coalesce(l.own, (SELECT arg_max(a.id, struct_pack(t := a.start, i := a.id)) FROM a WHERE a.session = l.session AND a.start <= l.start), (SELECT arg_min(a.id, struct_pack(t := a.start, i := a.id)) FROM a WHERE a.session = l.session)) FROM l)
SELECT session, id, parent, row_number() OVER (PARTITION BY session ORDER BY rank, start, id) AS pos FROM r WHERE parent IS NOT NULL""")
def _(s, d):
    return v.execution_hierarchy(*graph(s, d)).select("session", "id", "parent", "pos")


@query("conversation", "2.10.5", sql="""
SELECT session, turn, id, kind, row_number() OVER (PARTITION BY turn ORDER BY nested, t0, id) - 1 AS place FROM (
 SELECT c.session, coalesce(o.o_call, c.call_id) AS turn, c.call_id AS id, c.kind, c.t0, CASE WHEN o.o_call IS NULL THEN 0 ELSE 1 END AS nested FROM g_calls c LEFT JOIN (SELECT call_id, o_call FROM g_owned) o ON o.call_id = c.call_id)""")
def _(s, d):
    return v.conversation(*graph(s, d)).select("session", "turn", "id", "kind", "place")


NEW = "(SELECT {0}, arg_max(k, struct_pack(t := ts, s := span_id)) AS k, arg_max(user_id, struct_pack(t := ts, s := span_id)) AS u FROM flat WHERE kind = 'graph' GROUP BY 1)"


@query("application_topology", "2.10.6", sql=f"""
SELECT application_id, unnest([a, '__end__']) AS agent, unnest(['__start__', a]) AS source FROM (SELECT application_id, 'agent' || CAST(k % 4 AS VARCHAR) || '.invoke' AS a FROM {NEW.format('application_id')})""")
def _(s, d):
    _, edges = v.topology(spans(s, d), "application_id")
    return edges.select("application_id", F.col("target").alias("agent"), "source")


@query("session_topology_nodes", "2.10.6", sql=f"""
SELECT DISTINCT session_id, unnest(['__start__', '__end__', 'agent' || CAST(k % 4 AS VARCHAR) || '.invoke', 'agent' || CAST(u % 6 AS VARCHAR) || '.invoke']) AS node FROM {NEW.format('session_id')}""")
def _(s, d):
    nodes, _ = v.topology(spans(s, d), "session_id")
    return nodes.select("session_id", "node").distinct()


@query("agent_details", "2.10.7", sql=f"""
SELECT a.session_id, a.agent, a.n, round(a.md, 6) AS mean_duration, coalesce(t.i, 0) AS input_tokens, coalesce(x.ds, '') AS description FROM (SELECT session_id, application_id, {BASE} AS agent, count(*) AS n, avg(duration) AS md FROM flat GROUP BY 1, 2, 3) a
LEFT JOIN (SELECT session_id, {BASE} AS agent, sum({NUM.format('input_tokens')}) AS i FROM flat WHERE kind = 'chat' GROUP BY 1, 2) t ON t.session_id = a.session_id AND t.agent = a.agent
LEFT JOIN (SELECT application_id, {BASE} AS agent, arg_min(concat('does ', CAST(k % 3 AS VARCHAR)), struct_pack(a := ts, b := span_id)) AS ds FROM flat WHERE kind = 'note' GROUP BY 1, 2) x ON x.application_id = a.application_id AND x.agent = a.agent""")
def _(s, d):
    sps = spans(s, d)
    out = v.agent_details(sps, sp.agent_descriptions(sps), sp.agent_tokens(sps).select("session_id", "agent", "input_tokens"))
    return out.select("session_id", "agent", F.col("n_spans").alias("n"), r6("mean_duration").alias("mean_duration"),
                      F.coalesce("input_tokens", F.lit(0.0)).alias("input_tokens"), F.coalesce("description", F.lit("")).alias("description"))


@query("session_contributions", "2.10.7", sql="""
SELECT session_key, metric, agent, round(avg(v), 6) AS value FROM (SELECT session_key, 'm' || CAST(k % 2 AS VARCHAR) AS metric, 'agent' || CAST(k % 4 AS VARCHAR) AS agent, (k % 9) / 10.0 AS v FROM flat WHERE kind = 'chat'
 UNION ALL SELECT session_key, 'm' || CAST(k % 2 AS VARCHAR), 'agent' || CAST((k + 1) % 4 AS VARCHAR), 0.5 FROM flat WHERE kind = 'chat') GROUP BY 1, 2, 3""")
def _(s, d):
    c = table(s, d, "contributions")
    own = c.select(F.col("session_key").alias("group_id"), "session_key").distinct()
    return m.impact_per_group(c, own).select(F.col("group_id").alias("session_key"), "metric", "agent", r6("value").alias("value"))


# Periods of spans per application.
oracle_define("span_slots", """
SELECT f.*, b.p_start, b.p_size, CAST(floor((epoch_us(f.ts) / 1e6 - b.p_start) / b.p_size) AS BIGINT) AS period FROM flat f JOIN (
 SELECT application_id, greatest(lo - (hi - lo) / 10, 0.0) AS p_start, (hi + (hi - lo) / 10 - greatest(lo - (hi - lo) / 10, 0.0)) / 12 AS p_size FROM (
  SELECT application_id, min(epoch_us(ts) / 1e6) AS lo, CASE WHEN max(epoch_us(ts) / 1e6) - min(epoch_us(ts) / 1e6) < 10 THEN min(epoch_us(ts) / 1e6) + 10 ELSE max(epoch_us(ts) / 1e6) END AS hi FROM flat GROUP BY 1)) b USING (application_id)""")


def points(s, d):
    f = table(s, d, "flat").select("application_id", "session_key", "ts")
    return m.with_epoch(f)


def session_documents(s, d):
    """Per (application, session): sums over its metric documents."""
    x = docs(s, d).withColumnRenamed("doc_session", "key")
    agents = m.agent_document_totals(x, ["application_id", "key"]).groupBy("application_id", "key").agg(
        F.sum("llm_duration").alias("llm_duration"), F.sum("llm_cost").alias("llm_cost"))
    done = x.where("metric = 'TaskCompletion'").groupBy("application_id", "key").agg((F.avg(F.col("value_text").try_cast("double")) * 100).alias("completion"))
    return agents.join(done, ["application_id", "key"], "full_outer").withColumnRenamed("key", "session_key")


@query("general_chart", "2.10.8", sql="""
WITH act AS (SELECT DISTINCT application_id, period, session_key FROM span_slots WHERE period BETWEEN 0 AND 11),
 dv AS (SELECT application_id, session_key, sum(k + 1) FILTER (doc_metric = 'PassiveEvalAgents') AS dur, sum(k % 5 + 0.75) FILTER (doc_metric = 'PassiveEvalAgents') AS cost, avg((k % 10) / 10.0 * 100) FILTER (doc_metric = 'TaskCompletion') AS comp FROM derived GROUP BY 1, 2)
SELECT g.application_id, CAST(i AS BIGINT) AS period, count(a.session_key) AS n_sessions, CAST(coalesce(sum(dur), 0) AS DOUBLE) AS llm_duration, round(coalesce(sum(cost), 0), 6) AS llm_cost, round(coalesce(avg(comp), 0), 6) AS completion
FROM (SELECT DISTINCT application_id FROM flat) g CROSS JOIN (SELECT unnest(range(12)) AS i) LEFT JOIN act a ON a.application_id = g.application_id AND a.period = i LEFT JOIN dv ON dv.application_id = a.application_id AND dv.session_key = a.session_key GROUP BY 1, 2""")
def _(s, d):
    out = v.bucketed_values(points(s, d), ["application_id"], session_documents(s, d), {"llm_duration": "sum", "llm_cost": "sum", "completion": "avg"})
    return out.withColumns({"llm_cost": r6("llm_cost"), "completion": r6("completion")})


@query("tool_chart_cards", "2.10.9", sql="""
SELECT t.application_id, split_part(span_name, '.', 1) AS tool, round(count(DISTINCT session_id) / max(n_all) * 100, 6) AS utilisation, round(avg(CASE WHEN status_code = 'Error' THEN 0.0 ELSE 1.0 END) * 100, 6) AS success,
 round((1 - avg(CASE WHEN status_code = 'Error' THEN 0.0 ELSE 1.0 END)) * 100, 6) AS error, 0.0::DOUBLE AS retry, 0.0::DOUBLE AS accuracy FROM flat t JOIN (SELECT application_id, count(DISTINCT session_id) AS n_all FROM flat GROUP BY 1) a USING (application_id) WHERE kind = 'tool' GROUP BY 1, 2""")
def _(s, d):
    cards, _ = v.tool_chart(spans(s, d), ["application_id"])
    return cards.withColumns({c: r6(c) for c in ("utilisation", "success", "error")})


@query("tool_chart_series", "2.10.9", sql="""
WITH t AS (SELECT application_id, split_part(span_name, '.', 1) AS tool, session_id, duration / 1e6 AS ms, epoch_us(ts) / 1e6 AS e FROM flat WHERE kind = 'tool'),
 b AS (SELECT application_id, greatest(lo - (hi - lo) / 10, 0.0) AS s0, (hi + (hi - lo) / 10 - greatest(lo - (hi - lo) / 10, 0.0)) / 12 AS sz FROM (SELECT application_id, min(e) AS lo, max(e) AS hi FROM t GROUP BY 1)),
 p AS (SELECT t.*, CAST(floor((e - s0) / sz) AS BIGINT) AS period FROM t JOIN b USING (application_id)), g AS (SELECT DISTINCT application_id, tool FROM t)
SELECT g.application_id, g.tool, CAST(i AS BIGINT) AS period, round(coalesce(avg(ms), 0), 6) AS value, count(DISTINCT session_id) AS n_sessions FROM g CROSS JOIN (SELECT unnest(range(12)) AS i) LEFT JOIN p ON p.application_id = g.application_id AND p.tool = g.tool AND p.period = i GROUP BY 1, 2, 3""")
def _(s, d):
    _, series = v.tool_chart(spans(s, d), ["application_id"])
    return series.drop("starts_at").withColumn("value", r6("value"))


CHART_SQL = "(SELECT * FROM (VALUES " + ", ".join(str(c) for c in v.CHARTS) + ") t(chart, series, metric, operation, unit))"


@query("metric_charts", "2.10.10", "2.10.11", sql=f"""
SELECT g.application_id, c.chart, c.series, CAST(i AS BIGINT) AS period, round(coalesce(CASE WHEN c.operation = 'sum' THEN sum(result) ELSE avg(result) END, 0), 6) AS value, count(DISTINCT session_key) AS n_sessions
FROM (SELECT DISTINCT application_id FROM slots) g CROSS JOIN {CHART_SQL} c CROSS JOIN (SELECT unnest(range(12)) AS i) LEFT JOIN slots s ON s.application_id = g.application_id AND s.metric = c.metric AND s.period = i GROUP BY 1, 2, 3, 4, c.operation""")
def _(s, d):
    out = v.metric_charts(m.with_epoch(table(s, d, "metric_rows")), ["application_id"])
    return out.drop("unit").withColumn("value", r6("value"))


def app_sums(s, d, by):
    fields_ = {"llm_fails": "eval.app.llm_fails", "tool_fails": "eval.app.tool_fails", "llm_calls": "eval.app.llm_calls", "tool_calls": "eval.app.tool_calls", "duration": "eval.app.duration"}
    return m.app_field_sums(docs(s, d), by, fields_)


@query("performance_cards", "2.10.12", sql="""
WITH q AS (SELECT application_id, max(CASE WHEN rn = least(CAST(floor(n * 0.9) AS BIGINT), n - 1) + 1 THEN duration END) AS p90, max(CASE WHEN rn = least(CAST(floor(n * 0.95) AS BIGINT), n - 1) + 1 THEN duration END) AS p95 FROM (
 SELECT application_id, duration, row_number() OVER (PARTITION BY application_id ORDER BY duration) AS rn, count(*) OVER (PARTITION BY application_id) AS n FROM flat WHERE kind = 'agent') GROUP BY 1)
SELECT q.*, e.errors FROM q JOIN (SELECT application_id, CAST(sum(k % 2 + k % 3) AS DOUBLE) AS errors FROM derived WHERE doc_metric = 'PassiveEvalApp' GROUP BY 1) e USING (application_id)""")
def _(s, d):
    fails = app_sums(s, d, ["application_id"]).select("application_id", (F.col("llm_fails") + F.col("tool_fails")).alias("errors"))
    return v.performance_cards(spans(s, d), fails, ["application_id"])


@query("performance_series", "2.10.12", sql="""
WITH act AS (SELECT DISTINCT application_id, period, session_key FROM span_slots WHERE period BETWEEN 0 AND 11),
 dv AS (SELECT application_id, session_key, sum(k * 3) AS duration, sum(k + k % 17) AS calls, sum(k % 2 + k % 3) AS fails FROM derived WHERE doc_metric = 'PassiveEvalApp' GROUP BY 1, 2),
 x AS (SELECT g.application_id, CAST(i AS BIGINT) AS period, count(a.session_key) AS n_sessions, coalesce(avg(duration), 0) AS latency, coalesce(sum(duration), 0) AS du, coalesce(sum(calls), 0) AS ca, coalesce(sum(fails), 0) AS fa FROM (SELECT DISTINCT application_id FROM flat) g CROSS JOIN (SELECT unnest(range(12)) AS i)
  LEFT JOIN act a ON a.application_id = g.application_id AND a.period = i LEFT JOIN dv ON dv.application_id = a.application_id AND dv.session_key = a.session_key GROUP BY 1, 2)
SELECT application_id, period, n_sessions, round(latency, 6) AS latency, round(CASE WHEN du > 0 THEN ca / du * 1000 ELSE 0 END, 6) AS throughput, round(CASE WHEN ca > 0 THEN fa / ca ELSE 0 END, 6) AS error_rate FROM x""")
def _(s, d):
    per = m.app_values(docs(s, d)).withColumnRenamed("doc_session", "key")
    get = lambda f: F.coalesce(F.col("v").getItem(f"eval.app.{f}"), F.lit(0.0))
    per = per.groupBy("application_id", F.col("key").alias("session_key")).agg(
        F.sum(get("duration")).alias("duration"), F.sum(get("tool_calls") + get("llm_calls")).alias("calls"), F.sum(get("tool_fails") + get("llm_fails")).alias("fails"))
    out = v.performance_series(points(s, d), ["application_id"], per.withColumn("latency", F.col("duration")))
    return out.withColumns({c: r6(c) for c in ("latency", "throughput", "error_rate")})


@query("latent_space", "2.10.13")
def _(s, d):
    return v.latent_space(table(s, d, "vectors"), ["session_key", "group_id"])
