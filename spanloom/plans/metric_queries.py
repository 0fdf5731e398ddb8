"""Queries over metric results, metric documents, groups, waste and counters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from spanloom import schema
from spanloom.functions.scalar import sorted_text
from spanloom.operators import metrics as m
from spanloom.operators import spans as sp
from spanloom.operators import traverse as tv
from spanloom.plans.graph_tables import call_table, graph
from spanloom.plans.registry import query
from spanloom.plans.span_queries import END, RANGE, START, TOK
from spanloom.plans.traverse_queries import state_embeddings
from spanloom.sources.fixtures import counter, oracle_define, spans, table


def r6(c):
    return F.round(c, 6)


def quoted(names):
    return ", ".join(f"'{n}'" for n in names)


NAMES = ["AnswerRelevancy", "Groundedness", "Cost"]
QUALITY = quoted(schema.QUALITY_METRICS)


@query("session_metric_map", "2.4.1", sql="SELECT DISTINCT session_key, metric, result, provider, reasoning FROM metric_rows")
def _(s, d):
    return m.result_map(table(s, d, "metric_rows"), "session_key")


@query("span_metric_map", "2.4.2", sql="SELECT DISTINCT span_id, metric, result, provider, reasoning FROM metric_rows")
def _(s, d):
    return m.result_map(table(s, d, "metric_rows"), "span_id")


@query("neighbourhood", "2.4.3", sql="""
WITH u AS (SELECT from_id AS a, to_id AS b FROM g_edges UNION SELECT to_id, from_id FROM g_edges), s AS (SELECT id FROM g_nodes WHERE node_type = 'MAS'),
 h1 AS (SELECT s.id AS seed, u.b AS id FROM s JOIN u ON u.a = s.id), h2 AS (SELECT seed, u.b AS id FROM h1 JOIN u ON u.a = h1.id)
SELECT seed, id, min(depth) AS depth FROM (SELECT id AS seed, id, 0 AS depth FROM s UNION ALL SELECT seed, id, 1 FROM h1 UNION ALL SELECT seed, id, 2 FROM h2) GROUP BY 1, 2""")
def _(s, d):
    nodes, edges = graph(s, d)
    return tv.neighbourhood(nodes, edges, tv.of_type(nodes, "MAS").select("id"), 2)


@query("metrics_by_application", "2.4.4", sql=f"""
SELECT application_id, session_key, metric, ts, result FROM metric_rows x WHERE metric IN ({quoted(NAMES)}) AND {RANGE}
AND EXISTS (SELECT 1 FROM g_calls c WHERE c.kind = 'agent' AND c.session = x.session_key AND c.agent = 'agent1.invoke')""")
def _(s, d):
    who = tv.sessions_with_agent(*graph(s, d)).where("agent = 'agent1.invoke'").select(F.col("session").alias("session_key"))
    out = m.named_results(table(s, d, "metric_rows"), NAMES, datetime.fromisoformat(START), datetime.fromisoformat(END), who)
    return out.select("application_id", "session_key", "metric", "ts", "result")


CATEGORIES = [("quality", n) for n in schema.QUALITY_METRICS] + [("errors", n) for n in schema.ERROR_METRICS]


@query("category_series", "2.4.5", sql=f"""
SELECT application_id, CASE WHEN metric IN ({QUALITY}) THEN 'quality' ELSE 'errors' END AS category, count(*) AS n, round(avg(result), 6) AS mean FROM metric_rows
WHERE metric IN ({QUALITY}, {quoted(schema.ERROR_METRICS)}) GROUP BY 1, 2""")
def _(s, d):
    out = m.category_results(table(s, d, "metric_rows"), s.createDataFrame(CATEGORIES, "category string, metric string"))
    return out.groupBy("application_id", "category").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("result")).alias("mean"))


@query("application_session_counts", "2.4.6", sql="SELECT application_id, count(DISTINCT session_key) AS n_sessions FROM metric_rows GROUP BY 1")
def _(s, d):
    return m.session_counts(table(s, d, "metric_rows"), ["application_id"])


@query("failure_totals", "2.4.7", sql="""
SELECT application_id, CAST(sum(CAST(json_extract_string(reasoning, '$.total_fatal') AS BIGINT)) AS BIGINT) AS fatal, CAST(sum(CAST(json_extract_string(reasoning, '$.total_minor') AS BIGINT)) AS BIGINT) AS minor FROM verdicts GROUP BY 1""")
def _(s, d):
    v = table(s, d, "verdicts")
    # Half of the reasonings are stored as JSON inside a JSON string.
    wrapped = F.concat(F.lit('"'), F.replace("reasoning", F.lit('"'), F.lit('\\"')), F.lit('"'))
    return m.failure_totals(v.withColumn("reasoning", F.when(F.col("result") == 1.0, wrapped).otherwise(F.col("reasoning"))), ["application_id"])


@query("session_metric_ids", "2.4.8", sql="SELECT DISTINCT application_id, session_key, metric FROM metric_rows")
def _(s, d):
    return table(s, d, "metric_rows").select("application_id", "session_key", "metric").distinct()


@query("application_metric_pairs", "2.4.8", sql="SELECT DISTINCT application_id, metric FROM metric_rows")
def _(s, d):
    return table(s, d, "metric_rows").select("application_id", "metric").distinct()


@query("metric_over_time", "2.4.9", sql="""
SELECT metric, date_trunc('day', ts)::TIMESTAMP AS bucket, round(avg(result), 6) AS avg_value, min(result) AS min_value, max(result) AS max_value, count(*) AS n FROM metric_rows GROUP BY 1, 2""")
def _(s, d):
    return m.over_time(table(s, d, "metric_rows"), "day", ["metric"]).withColumn("avg_value", r6("avg_value"))


oracle_define("starts", "SELECT session_key, min(ts) AS started FROM span_rows GROUP BY 1")


def starts(s, d):
    return table(s, d, "span_rows").groupBy("session_key").agg(F.min("ts").alias("started"))


@query("metric_timeline", "2.4.10", sql=f"""
SELECT application_id, metric, result_id, row_number() OVER (PARTITION BY application_id, metric ORDER BY started, session_key, result_id) AS pos FROM metric_rows JOIN starts USING (session_key) WHERE metric IN ({quoted(NAMES)})""")
def _(s, d):
    rows = m.named_results(table(s, d, "metric_rows"), NAMES)
    return m.timeline(rows, starts(s, d), ["application_id", "metric"]).select("application_id", "metric", "result_id", "pos")


REL = """
SELECT application_id, CASE data_type WHEN 'metric' THEN 'MetricConsistency' WHEN 'graph' THEN 'GraphConsistency' ELSE 'TextConsistency' END AS name, round(avg(mean), 6) AS value FROM reports JOIN groups USING (group_id) GROUP BY 1, 2
UNION ALL SELECT application_id, 'CompletionRate', round(1 - avg(result), 6) FROM metric_rows WHERE metric IN ('LLMErrorRate', 'ToolErrorRate') GROUP BY 1"""


@query("reliability_summary", "2.4.11", sql=REL)
def _(s, d):
    reports = table(s, d, "reports").join(table(s, d, "groups").select("group_id", "application_id"), "group_id")
    return m.reliability(reports, table(s, d, "metric_rows"), ["application_id"]).withColumn("value", r6("value"))


PB = """SELECT application_id, greatest(lo - pad, 0.0) AS p_start, (hi + pad - greatest(lo - pad, 0.0)) / 12 AS p_size FROM (SELECT *, (hi - lo) / 10 AS pad FROM (
 SELECT application_id, min(epoch_us(ts) / 1e6) AS lo, CASE WHEN max(epoch_us(ts) / 1e6) - min(epoch_us(ts) / 1e6) < 10 THEN min(epoch_us(ts) / 1e6) + 10 ELSE max(epoch_us(ts) / 1e6) END AS hi FROM metric_rows GROUP BY 1))"""
oracle_define("slots", f"SELECT x.*, p_start, p_size, CAST(floor((epoch_us(ts) / 1e6 - p_start) / p_size) AS BIGINT) AS period FROM metric_rows x JOIN ({PB}) b USING (application_id)")


def series_sql(agg):
    return f"""WITH g AS (SELECT DISTINCT application_id, metric, p_start, p_size FROM slots)
SELECT g.application_id, g.metric, i AS period, round(g.p_start + i * g.p_size, 3) AS starts_at, round(coalesce({agg}(result), 0.0), 6) AS value, count(DISTINCT session_key) AS n_sessions
FROM g CROSS JOIN (SELECT unnest(range(12)) AS i) LEFT JOIN slots s ON s.application_id = g.application_id AND s.metric = g.metric AND s.period = i GROUP BY 1, 2, 3, g.p_start, g.p_size"""


@query("period_averages", "2.4.12", sql=series_sql("avg"))
def _(s, d):
    out = m.period_series(m.with_epoch(table(s, d, "metric_rows")), ["application_id"], ["metric"])
    return out.withColumns({"value": r6("value"), "starts_at": F.round("starts_at", 3)})


@query("period_sums", "2.4.12", sql=series_sql("sum"))
def _(s, d):
    out = m.period_series(m.with_epoch(table(s, d, "metric_rows")), ["application_id"], ["metric"], "sum")
    return out.withColumns({"value": r6("value"), "starts_at": F.round("starts_at", 3)})


@query("period_sessions", "2.4.12", sql="SELECT DISTINCT application_id, metric, period, session_key FROM slots WHERE period BETWEEN 0 AND 11")
def _(s, d):
    return m.period_sessions(m.with_epoch(table(s, d, "metric_rows")), ["application_id"], ["metric"])


@query("application_summary", "2.4.13", sql=f"""
SELECT application_id, 'reliability' AS part, name, value FROM ({REL})
UNION ALL SELECT application_id, CASE WHEN metric IN ({QUALITY}) THEN 'quality' ELSE 'performance' END, metric, round(avg(result), 6) FROM metric_rows WHERE metric <> 'Cost' GROUP BY 1, 2, 3""")
def _(s, d):
    reports = table(s, d, "reports").join(table(s, d, "groups").select("group_id", "application_id"), "group_id")
    results = table(s, d, "metric_rows")
    rel = m.reliability(reports, results, ["application_id"]).withColumn("part", F.lit("reliability"))
    part = F.when(F.col("metric").isin(*schema.QUALITY_METRICS), "quality").otherwise("performance")
    rest = m.named_results(results, [*schema.QUALITY_METRICS, "WorkflowEfficiency", "CyclesCount", *schema.ERROR_METRICS])
    rest = rest.groupBy("application_id", part.alias("part"), F.col("metric").alias("name")).agg(F.avg("result").alias("value"))
    return rel.unionByName(rest).withColumn("value", r6("value"))


def docs(s, d):
    return m.metric_documents(table(s, d, "derived"))


@query("document_averages", "2.4.14", sql="""
SELECT k.application_id, round(coalesce(avg(v), 0.0), 6) AS metric_avg FROM (SELECT DISTINCT application_id FROM derived) k LEFT JOIN (
 SELECT application_id, session_id, avg(CAST(json_extract_string(metrics, '$.value') AS DOUBLE)) AS v FROM derived WHERE doc_metric = 'TaskCompletion' GROUP BY 1, 2) t USING (application_id) GROUP BY 1""")
def _(s, d):
    return m.document_average(docs(s, d), ["application_id"], "TaskCompletion", "agent").withColumn("metric_avg", r6("metric_avg"))


@query("app_document_averages", "2.4.15", sql="SELECT session_key, " + ", ".join(
    f"""round(avg(CAST(json_extract_string(metrics, '$.value."eval.app.{f}"') AS DOUBLE)), 6) AS {f}""" for f in m.APP_FIELDS) + " FROM derived WHERE doc_metric = 'PassiveEvalApp' GROUP BY 1")
def _(s, d):
    out = m.app_field_averages(docs(s, d), ["doc_session"]).withColumnRenamed("doc_session", "session_key")
    return out.withColumns({f: r6(f) for f in m.APP_FIELDS})


@query("agent_document_totals", "2.4.16", sql="""
SELECT application_id, agent, sum(dur) AS llm_duration, sum(cost) AS llm_cost FROM (
 SELECT application_id, 'agent-' || CAST(k % 3 AS VARCHAR) AS agent, CAST(k AS DOUBLE) AS dur, k % 5 + 0.25 AS cost FROM derived WHERE doc_metric = 'PassiveEvalAgents'
 UNION ALL SELECT application_id, 'agent3', 1.0, 0.5 FROM derived WHERE doc_metric = 'PassiveEvalAgents') GROUP BY 1, 2""")
def _(s, d):
    return m.agent_document_totals(docs(s, d), ["application_id"])


@query("sdk_metric_sums", "2.4.17", sql="""
SELECT k.session_id, round(coalesce(sum(CAST(json_extract_string(metrics, '$.value."eval.app.llm_fails"') AS DOUBLE)), 0.0), 6) AS llm_fails, round(coalesce(sum(CAST(json_extract_string(metrics, '$.value."eval.app.tool_fails"') AS DOUBLE)), 0.0), 6) AS tool_fails,
 round(coalesce(sum(CAST(json_extract_string(metrics, '$.value."eval.app.duration"') AS DOUBLE)), 0.0), 6) AS duration FROM (SELECT DISTINCT session_id FROM derived) k LEFT JOIN derived x ON x.session_id = k.session_id AND doc_metric = 'PassiveEvalApp' GROUP BY 1""")
def _(s, d):
    return m.app_field_sums(docs(s, d), ["session_id"], {
        "llm_fails": "eval.app.llm_fails", "tool_fails": "eval.app.tool_fails", "duration": "eval.app.duration"})


@query("quality_per_session", "2.4.18", sql="SELECT session_key, " + ", ".join(
    f"round(coalesce(avg(result) FILTER (metric = '{q}'), -1), 6) AS \"{q}\"" for q in schema.QUALITY_METRICS) + f" FROM metric_rows WHERE metric IN ({QUALITY}) GROUP BY 1")
def _(s, d):
    out = m.quality_per_session(table(s, d, "metric_rows"))
    return out.withColumns({q: r6(F.coalesce(q, F.lit(-1.0))) for q in schema.QUALITY_METRICS})


@query("metric_lists", "2.4.18", sql=f"SELECT session_key, metric, result, row_number() OVER (PARTITION BY session_key, metric ORDER BY ts, result_id) AS pos FROM metric_rows WHERE metric IN ({QUALITY})")
def _(s, d):
    return m.metric_lists(table(s, d, "metric_rows"), schema.QUALITY_METRICS).select("session_key", "metric", "result", "pos")


@query("applications_with_metrics", "2.4.19", sql=f"""
WITH a AS (SELECT application_id, max(ts) AS last_ts FROM flat GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)
SELECT a.application_id, (SELECT sum({TOK}) FROM flat f WHERE f.application_id = a.application_id AND kind = 'chat') AS tokens,
 (SELECT string_agg(DISTINCT model, ',' ORDER BY model) FROM flat f WHERE f.application_id = a.application_id AND kind = 'chat') AS models,
 (SELECT count(*) FROM metric_rows x WHERE x.application_id = a.application_id) AS n_results, (SELECT count(DISTINCT metric) FROM metric_rows x WHERE x.application_id = a.application_id) AS n_metrics FROM a""")
def _(s, d):
    sps = spans(s, d)
    names = sp.model_names(sps).groupBy("application_id").agg(sorted_text(F.collect_set("model")).alias("models"))
    apps = sp.application_list(sps).select("application_id", "last_ts")
    return m.applications_with_metrics(apps, sp.token_sums(sps, ["application_id"]), names, table(s, d, "metric_rows"), 3).drop("last_ts")


@query("overall_performance", "2.4.20", sql=f"""
SELECT application_id, round(avg(v), 6) AS performance FROM (SELECT application_id, metric, avg(v) AS v FROM (
 SELECT application_id, metric, session_key, avg(result) AS v FROM metric_rows WHERE metric IN ({QUALITY}) GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1""")
def _(s, d):
    return m.overall_performance(table(s, d, "metric_rows"), ["application_id"]).withColumn("performance", r6("performance"))


oracle_define("members", """
SELECT group_id, session_key FROM group_sessions UNION SELECT e.parent_id, g.session_key FROM group_edges e JOIN group_sessions g ON g.group_id = e.child_id
UNION SELECT e2.parent_id, g.session_key FROM group_edges e JOIN group_edges e2 ON e2.child_id = e.parent_id JOIN group_sessions g ON g.group_id = e.child_id""")


def members(s, d):
    return tv.group_members(table(s, d, "group_edges"), table(s, d, "group_sessions"))


@query("collect_page", "2.4.21", sql=f"""
WITH b AS (SELECT session_key, min(ts) AS started, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS seconds FROM flat GROUP BY 1)
SELECT b.session_key, b.seconds, coalesce(t.tokens, 0) AS tokens, coalesce(a.agents, '') AS agents, coalesce(c.cost, 0) AS cost, coalesce(v.fatal, 0) AS fatal, coalesce(q.n, 0) AS n_results FROM b
LEFT JOIN (SELECT session_key, sum({TOK}) AS tokens FROM flat WHERE kind = 'chat' GROUP BY 1) t USING (session_key)
LEFT JOIN (SELECT session_key, string_agg(DISTINCT split_part(agent_id, '.', 1), ',' ORDER BY split_part(agent_id, '.', 1)) AS agents FROM flat GROUP BY 1) a USING (session_key)
LEFT JOIN (SELECT session_key, round(sum(result), 4) AS cost FROM metric_rows WHERE metric = 'Cost' GROUP BY 1) c USING (session_key)
LEFT JOIN (SELECT session_key, CAST(sum(CAST(json_extract_string(reasoning, '$.total_fatal') AS BIGINT)) AS BIGINT) AS fatal FROM verdicts GROUP BY 1) v USING (session_key)
LEFT JOIN (SELECT session_key, count(*) AS n FROM metric_rows GROUP BY 1) q USING (session_key)
WHERE session_key IN (SELECT session_key FROM members WHERE group_id LIKE '%\\_root' ESCAPE '\\')""")
def _(s, d):
    flat, res = table(s, d, "flat"), table(s, d, "metric_rows")
    us = lambda f: F.unix_micros(f("ts").cast("timestamp"))
    base = flat.groupBy("session_key").agg(r6((us(F.max) - us(F.min)) / 1e6).alias("seconds"))
    sps = sp.llm_spans(spans(s, d))
    tokens = sp.token_sums(sps, ["session_key"])
    agents = flat.groupBy("session_key").agg(sorted_text(F.collect_set(sp.base_name("agent_id"))).alias("agents"))
    cost = res.where("metric = 'Cost'").groupBy("session_key").agg(F.round(F.sum("result"), 4).alias("cost"))
    fails = m.failure_totals(table(s, d, "verdicts"), ["session_key"]).select("session_key", "fatal")
    n = res.groupBy("session_key").agg(F.count(F.lit(1)).alias("n_results"))
    inside = members(s, d).where(F.col("group_id").endswith("_root"))
    return m.collect_page([tokens, agents, cost, fails, n], base, members=inside).na.fill(0).na.fill("")


def scores_sql(member_sql, leaf):
    avg = lambda names: f"avg(result) FILTER (metric IN ({quoted(names)}))"
    return f"""
SELECT g.group_id, g.application_id, round(coalesce(quality, -1), 6) AS quality, round(list_avg(list_filter([c1, c2, c3, c4], lambda x: x IS NOT NULL)), 6) AS performance, round((coalesce(cs, 0) + completion) / (coalesce(cn, 1) + 1), 6) AS reliability
FROM groups g LEFT JOIN (SELECT ms.group_id, {avg(schema.QUALITY_METRICS)} AS quality, 1 - {avg(schema.ERROR_METRICS)} AS completion, 1 / (1 + {avg(['CyclesCount'])}) AS c1, {avg(['WorkflowEfficiency'])} AS c2,
 1 - {avg(['LLMErrorRate'])} AS c3, 1 - {avg(['ToolErrorRate'])} AS c4 FROM {member_sql} ms JOIN metric_rows x ON x.session_key = ms.session_key GROUP BY 1) p USING (group_id)
LEFT JOIN (SELECT group_id, sum(v) AS cs, count(*) AS cn FROM (SELECT group_id, data_type, avg(mean) AS v FROM reports GROUP BY 1, 2) GROUP BY 1) c USING (group_id) {leaf}"""


def rounded_scores(df):
    return df.withColumns({"quality": r6(F.coalesce("quality", F.lit(-1.0))), "performance": r6("performance"), "reliability": r6("reliability")})


@query("group_table", "2.4.22", sql=scores_sql("group_sessions", "WHERE g.is_leaf"))
def _(s, d):
    leaves = tv.leaf_groups(table(s, d, "groups"), table(s, d, "group_edges"))
    return rounded_scores(m.group_scores(leaves, table(s, d, "group_sessions"), table(s, d, "metric_rows"), table(s, d, "reports")))


@query("group_list", "2.4.23", sql=scores_sql("members", ""))
def _(s, d):
    return rounded_scores(m.group_scores(table(s, d, "groups"), members(s, d), table(s, d, "metric_rows"), table(s, d, "reports")))


@query("group_impact", "2.4.24", sql="""
SELECT group_id, metric, agent, round(avg(v), 6) AS value FROM members JOIN (
 SELECT session_key, 'm' || CAST(k % 2 AS VARCHAR) AS metric, 'agent' || CAST(k % 4 AS VARCHAR) AS agent, (k % 9) / 10.0 AS v FROM flat WHERE kind = 'chat'
 UNION ALL SELECT session_key, 'm' || CAST(k % 2 AS VARCHAR), 'agent' || CAST((k + 1) % 4 AS VARCHAR), 0.5 FROM flat WHERE kind = 'chat') c USING (session_key) GROUP BY 1, 2, 3""")
def _(s, d):
    return m.impact_per_group(table(s, d, "contributions"), members(s, d)).withColumn("value", r6("value"))


@query("group_reports", "2.4.25", sql="SELECT g.group_id, g.name, r.data_type, r.metric, r.mean FROM groups g JOIN reports r USING (group_id)")
def _(s, d):
    return table(s, d, "groups").select("group_id", "name").join(table(s, d, "reports").select("group_id", "data_type", "metric", "mean"), "group_id")


@query("groups_needing_analysis", "2.4.26", "2.3.12", sql="""
SELECT group_id FROM groups WHERE is_leaf AND group_id NOT IN (SELECT group_id FROM reports WHERE mean > 0.49 AND data_type IN ('metric', 'graph', 'text') GROUP BY 1 HAVING count(DISTINCT data_type) = 3)""")
def _(s, d):
    leaves = tv.leaf_groups(table(s, d, "groups"), table(s, d, "group_edges"))
    return m.groups_needing_analysis(leaves, table(s, d, "reports").where("mean > 0.49"), ["metric", "graph", "text"]).select("group_id")


@query("analysis_pre_check", "2.4.27", sql="""
SELECT q.group_id, q.session_key, (coalesce(q.h = g.hash, FALSE) AND NOT EXISTS (SELECT 1 FROM reports r WHERE r.data_type = 'graph' AND r.group_id = q.group_id AND r.group_hash = q.h)
 AND EXISTS (SELECT 1 FROM group_sessions x WHERE x.group_id = q.group_id AND x.session_key = q.session_key)) AS can_analyse
FROM (SELECT group_id, session_key, 'h' || CAST(length(group_id) AS VARCHAR) AS h FROM members) q LEFT JOIN groups g ON g.group_id = q.group_id""")
def _(s, d):
    asked = members(s, d).withColumn("hash", F.concat(F.lit("h"), F.length("group_id").cast("string")))
    out = m.can_analyse(asked, table(s, d, "groups"), table(s, d, "reports").where("data_type = 'graph'"), table(s, d, "group_sessions"))
    return out.select("group_id", "session_key", "can_analyse")


@query("group_analysis_dataset", "2.4.28", sql="""
WITH nx AS (SELECT t1.owner AS a, t2.owner AS b FROM g_states_of t1 JOIN g_states_of t2 ON t1.s1 = t2.s0 JOIN g_calls c1 ON c1.call_id = t1.owner AND c1.kind = 'agent' JOIN g_calls c2 ON c2.call_id = t2.owner AND c2.kind = 'agent')
SELECT gs.group_id, gs.session_key, coalesce(mm.n, 0) AS n_metrics, coalesce(a.content, '') AS input, coalesce(b.content, '') AS output, coalesce(nn.n, 0) AS n_nodes, coalesce(ee.n, 0) AS n_edges FROM group_sessions gs
JOIN g_sessions ss ON ss.session = gs.session_key
LEFT JOIN (SELECT session_key, count(*) AS n FROM (SELECT DISTINCT session_key, metric, result, provider, reasoning FROM metric_rows) GROUP BY 1) mm USING (session_key)
LEFT JOIN g_box x ON x.owner = gs.session_key LEFT JOIN (SELECT id, content FROM g_nodes WHERE node_type = 'State') a ON a.id = x.s0 LEFT JOIN (SELECT id, content FROM g_nodes WHERE node_type = 'State') b ON b.id = x.s1
LEFT JOIN (SELECT session, count(*) AS n FROM g_calls WHERE kind = 'agent' GROUP BY 1) nn ON nn.session = gs.session_key
LEFT JOIN (SELECT c.session, count(*) AS n FROM (SELECT DISTINCT a, b FROM nx) e JOIN g_calls c ON c.call_id = e.a GROUP BY 1) ee ON ee.session = gs.session_key""")
def _(s, d):
    nodes, edges = graph(s, d)
    texts = tv.session_texts(nodes, edges).select(F.col("session").alias("session_key"), "input", "output")
    n_metrics = m.result_map(table(s, d, "metric_rows"), "session_key").groupBy("session_key").agg(F.count(F.lit(1)).alias("n_metrics"))
    calls = tv.of_type(nodes, "AgentCall").select(F.col("id").alias("call"), F.col("session_id").alias("session_key"))
    n_nodes = calls.groupBy("session_key").agg(F.count(F.lit(1)).alias("n_nodes"))
    # call -> its transition -> the state it leads to -> the transition that state feeds -> next call
    chain = tv.hop(calls, edges, "correspondsToTransition", "call", "t1")
    chain = tv.hop(tv.hop(tv.hop(chain, edges, "leadsTo", "t1", "state"), edges, "inputTo", "state", "t2"), edges, "representsExecution", "t2", "next")
    chain = chain.join(calls.select(F.col("call").alias("next")), "next", "left_semi").select("session_key", "call", "next").distinct()
    n_edges = chain.groupBy("session_key").agg(F.count(F.lit(1)).alias("n_edges"))
    base = table(s, d, "group_sessions").select("group_id", "session_key").join(
        tv.of_type(nodes, "Session").select(F.col("id").alias("session_key")), "session_key", "left_semi")
    return m.collect_page([n_metrics, texts, n_nodes, n_edges], base).na.fill(0).na.fill("")


@query("metrics_of_group_sessions", "2.4.29", sql="""
SELECT DISTINCT x.session_key, metric, result FROM metric_rows x JOIN group_sessions g USING (session_key) WHERE g.group_id LIKE '%g1'""")
def _(s, d):
    chosen = table(s, d, "group_sessions").where(F.col("group_id").endswith("g1")).select("session_key")
    return table(s, d, "metric_rows").join(chosen, "session_key", "left_semi").select("session_key", "metric", "result").distinct()


@query("question_per_session", "2.4.30", sql="""
SELECT session, arg_min(CASE WHEN in_text = '' THEN '(no content recorded)' ELSE in_text END, struct_pack(t := t0, s := span_id)) AS question FROM g_calls WHERE kind = 'agent' GROUP BY 1""")
def _(s, d):
    nodes, edges = graph(s, d)
    first = tv.call_sequence(nodes, edges).where("pos = 1").select("session", "call")
    withs = tv.with_states(first, nodes, edges, "call")
    return withs.select("session", F.col("input").alias("question"))


oracle_define("agent_tools", "SELECT p.session, p.agent, c.entity AS tool, p.call_id AS agent_call, c.call_id AS tool_call FROM g_calls p LEFT JOIN (SELECT * FROM g_owned WHERE kind = 'tool') c ON c.o_call = p.call_id WHERE p.kind = 'agent'")


def agent_tools(s, d, how="left"):
    nodes, edges = graph(s, d)
    calls = tv.of_type(nodes, "AgentCall").select(F.col("session_id").alias("session"), F.col("id").alias("call"))
    rows = tv.hop(tv.hop(calls, edges, "executesAgent", "call", "agent"), edges, "hasToolCall", "call", "tool_call", how)
    return tv.hop(rows, edges, "executesTool", "tool_call", "tool", how)


@query("agent_tool_baseline", "2.4.31", sql="SELECT session, agent, coalesce(tool, '') AS tool, count(*) AS n FROM agent_tools GROUP BY 1, 2, 3")
def _(s, d):
    return agent_tools(s, d).groupBy("session", "agent", F.coalesce("tool", F.lit("")).alias("tool")).agg(F.count(F.lit(1)).alias("n"))


@query("agent_tool_counts", "2.4.31", sql="SELECT session, agent, tool, count(*) AS n FROM agent_tools WHERE tool IS NOT NULL GROUP BY 1, 2, 3")
def _(s, d):
    return agent_tools(s, d, "inner").groupBy("session", "agent", "tool").agg(F.count(F.lit(1)).alias("n"))


@query("agent_call_listing", "2.4.32", sql="""
SELECT session, agent_call AS call, agent, count(tool_call) AS n_tool_calls, coalesce(string_agg(DISTINCT tool, ',' ORDER BY tool), '') AS tools FROM agent_tools GROUP BY 1, 2, 3""")
def _(s, d):
    return agent_tools(s, d).groupBy("session", "call", "agent").agg(
        F.count("tool_call").alias("n_tool_calls"), sorted_text(F.collect_set("tool")).alias("tools"))


@query("llm_call_listing", "2.4.32", sql="""
SELECT c.call_id AS call, c.session, c.model, CAST(c.k * 10 AS BIGINT) AS prompt_tokens, o.o_call IS NOT NULL AS owned FROM g_calls c LEFT JOIN g_owned o ON o.call_id = c.call_id WHERE c.kind = 'llm'""")
def _(s, d):
    nodes, edges = graph(s, d)
    llm = tv.of_type(nodes, "LLMCall").select(F.col("id").alias("call"), F.col("session_id").alias("session"), "prompt_tokens")
    names = tv.of_type(nodes, "LLM").groupBy(F.col("id").alias("llm")).agg(F.min("name").alias("model"))
    rows = tv.hop(llm, edges, "executesLLM", "call", "llm", "left").join(names, "llm", "left")
    return tv.hop(rows, edges, "hasLLMCall", "call", "owner", "left", reverse=True).select(
        "call", "session", "model", "prompt_tokens", F.col("owner").isNotNull().alias("owned"))


@query("top_wasteful_sessions", "2.4.33", sql="""
SELECT w.session_key, w.estimated_waste, min(g.group_id) AS group_id FROM waste w LEFT JOIN group_sessions g USING (session_key) WHERE w.estimated_waste > 0.4 GROUP BY 1, 2 ORDER BY 2 DESC, 1 LIMIT 25""")
def _(s, d):
    return m.top_wasteful(table(s, d, "waste"), table(s, d, "group_sessions"), 0.4, 25).select("session_key", "estimated_waste", "group_id")


@query("cost_per_leaf_group", "2.4.34", sql="SELECT g.group_id, round(coalesce(sum(actual_cost), 0), 6) AS total_cost FROM group_sessions g LEFT JOIN waste w USING (session_key) GROUP BY 1")
def _(s, d):
    return m.cost_per_leaf(table(s, d, "group_sessions"), table(s, d, "waste")).withColumn("total_cost", r6("total_cost"))


@query("cost_efficiency_rows", "2.4.35", sql="SELECT g.group_id, w.session_key, w.cost_efficiency, w.actual_cost, w.estimated_waste FROM group_sessions g JOIN waste w USING (session_key) WHERE w.actual_cost <> 0")
def _(s, d):
    out = m.cost_efficiency(table(s, d, "group_sessions").select("group_id", "session_key"), table(s, d, "waste"))
    return out.select("group_id", "session_key", "cost_efficiency", "actual_cost", "estimated_waste")


@query("best_and_worst_features", "2.4.36", sql="""
SELECT session_key, quality_target, rank, feature, score FROM (SELECT *, row_number() OVER w AS p, count(*) OVER (PARTITION BY session_key, quality_target) AS t FROM feature_scores WINDOW w AS (PARTITION BY session_key, quality_target ORDER BY rank)) WHERE t <= 10 OR p <= 5 OR p > t - 5""")
def _(s, d):
    return m.best_and_worst(table(s, d, "feature_scores"), ["session_key", "quality_target"]).select("session_key", "quality_target", "rank", "feature", "score")


@query("insight_list", "2.4.37", sql=f"""
SELECT insight_id, session_key, name, priority, created FROM insights WHERE created >= TIMESTAMP '{START}' AND created <= TIMESTAMP '{END}' AND session_key IN (SELECT session_key FROM members WHERE group_id LIKE '%m1')""")
def _(s, d):
    inside = members(s, d).where(F.col("group_id").endswith("m1"))
    out = m.insight_list(table(s, d, "insights"), datetime.fromisoformat(START), datetime.fromisoformat(END), members=inside)
    return out.select("insight_id", "session_key", "name", "priority", "created")


oracle_define("triples", """
SELECT session, row_number() OVER (PARTITION BY session ORDER BY t0, span_id) AS pos, agent, CASE WHEN in_text = '' THEN '(no content recorded)' ELSE in_text END AS input, CASE WHEN out_text = '' THEN '(no content recorded)' ELSE out_text END AS output FROM g_calls WHERE kind = 'agent'""")


def triples(s, d):
    nodes, edges = graph(s, d)
    return tv.with_states(tv.call_sequence(nodes, edges), nodes, edges, "call").select("session", "pos", "agent", "input", "output")


@query("impact_training_set", "2.4.38", sql="SELECT * FROM triples")
def _(s, d):
    return triples(s, d)


@query("impact_inference_rows", "2.4.39", sql="""
SELECT t.*, round(x.value, 6) AS value FROM triples t JOIN (SELECT session_key, avg(result) AS value FROM metric_rows WHERE metric = 'Groundedness' GROUP BY 1) x ON x.session_key = t.session""")
def _(s, d):
    value = table(s, d, "metric_rows").where("metric = 'Groundedness'").groupBy(F.col("session_key").alias("session")).agg(r6(F.avg("result")).alias("value"))
    return triples(s, d).join(value, "session")


@query("graph_applications", "2.4.40", sql="""
SELECT e.to_id AS application, count(DISTINCT e.from_id) AS n_sessions, round(min(s.c0), 6) AS first_start FROM g_edges e JOIN g_sessions s ON s.session = e.from_id WHERE e.edge_type = 'executesSession' GROUP BY 1""")
def _(s, d):
    nodes, edges = graph(s, d)
    rows = tv.hop(tv.of_type(nodes, "Session").select(F.col("id").alias("session"), "start_time"), edges, "executesSession", "session", "application")
    return rows.groupBy("application").agg(F.count_distinct("session").alias("n_sessions"), r6(F.min("start_time")).alias("first_start")).orderBy(F.desc("first_start"))


@query("group_hierarchy", "2.4.41", sql="SELECT g.group_id, g.application_id, coalesce(e.parent_id, '') AS parent_id, g.embedding_model FROM groups g LEFT JOIN group_edges e ON e.child_id = g.group_id WHERE g.embedding_model = 'model1'")
def _(s, d):
    up = table(s, d, "group_edges").select(F.col("child_id").alias("group_id"), "parent_id")
    g = table(s, d, "groups").where("embedding_model = 'model1'")
    return g.join(up, "group_id", "left").select("group_id", "application_id", F.coalesce("parent_id", F.lit("")).alias("parent_id"), "embedding_model")


@query("communication_chain", "2.4.42", sql="""
SELECT session, pos, agent AS from_agent, nxt AS to_agent, CASE WHEN agent = 'agent0.invoke' THEN 'query' ELSE 'response' END AS side, output = ni AS sound FROM (
 SELECT *, lead(agent) OVER w AS nxt, lead(input) OVER w AS ni FROM triples WINDOW w AS (PARTITION BY session ORDER BY pos)) WHERE nxt IS NOT NULL""")
def _(s, d):
    return m.communication_chain(triples(s, d), ["session"], ["pos"], "agent0.invoke")


@query("record_counts", "2.4.43", sql="SELECT application_id, kind, count(*) AS n FROM flat GROUP BY 1, 2")
def _(s, d):
    return table(s, d, "flat").groupBy("application_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("filtered_records", "2.4.44", sql="SELECT span_id, model FROM flat WHERE kind IN ('chat', 'graph') AND application_id = 'app2'")
def _(s, d):
    out = m.filtered_records(table(s, d, "flat"), {"kind": ["chat", "graph"], "application_id": "app2"}, ["-model", "span_id"])
    return out.select("span_id", "model")


@query("concept_listing", "2.4.45", sql="SELECT DISTINCT application_id, name, 'app' AS level FROM insights UNION ALL SELECT DISTINCT session_key, name, 'span' FROM insights")
def _(s, d):
    i = table(s, d, "insights")
    apps = i.select("application_id", "name", F.lit("app").alias("level")).distinct()
    return apps.unionByName(i.select(F.col("session_key").alias("application_id"), "name", F.lit("span").alias("level")).distinct()).orderBy("name")


FALL = """SELECT application_id, CAST(sum(tot) AS DOUBLE) AS total FROM (SELECT application_id, agent, max(l) - max(f) + coalesce(sum(fall), 0) AS tot FROM (
 SELECT *, CASE WHEN {on} < lag({on}) OVER w THEN lag({v}) OVER w END AS fall, last_value({v}) OVER (PARTITION BY agent ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, first_value({v}) OVER w AS f
 FROM (SELECT application_id, agent, {dims}, min(ts) AS ts, min(seq) AS seq FROM counter GROUP BY application_id, agent, {dims}) WINDOW w AS (PARTITION BY agent ORDER BY ts, seq)) GROUP BY 1, 2) GROUP BY 1"""


@query("counter_totals", "2.4.46", sql=FALL.format(on="value", v="value", dims="value"))
def _(s, d):
    first = counter(s, d).groupBy("application_id", "agent", "value").agg(F.min("ts").alias("ts"), F.min("seq").alias("seq"))
    per = m.counter_totals(first, ["application_id", "agent"], ["ts", "seq"], "value")
    return per.groupBy("application_id").agg(F.sum("total").alias("total"))


@query("histogram_totals", "2.4.47", sql=f"""
SELECT a.application_id, a.total AS total_sum, b.total AS total_count FROM ({FALL.format(on="cnt", v="value", dims="cnt, value")}) a JOIN ({FALL.format(on="cnt", v="cnt", dims="cnt, value")}) b USING (application_id)""")
def _(s, d):
    first = counter(s, d).groupBy("application_id", "agent", "cnt", "value").agg(F.min("ts").alias("ts"), F.min("seq").alias("seq"))
    total = lambda v, out: m.counter_totals(first, ["application_id", "agent"], ["ts", "seq"], v, "cnt").groupBy("application_id").agg(F.sum("total").alias(out))
    return total("value", "total_sum").join(total("cnt", "total_count"), "application_id")
