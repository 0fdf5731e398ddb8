"""Results in full where other queries count them: one row per item."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import groups as gr
from spanloom.operators import neighbours as nb
from spanloom.operators import spans as sp
from spanloom.operators import trajectory as tr
from spanloom.operators import traverse as tv
from spanloom.plans.graph_tables import graph
from spanloom.plans.group_queries import CONS, agent_edges, call_graphs, values, vectors
from spanloom.plans.metric_queries import members
from spanloom.plans.registry import query
from spanloom.sources.fixtures import spans, table


def r6(c):
    return F.round(c, 6)


@query("collect_page_rows", "2.4.21", sql="""
WITH m AS (SELECT DISTINCT session_key FROM members WHERE ends_with(group_id, '_root'))
SELECT session_key, 'metric' AS kind, metric AS name, result_id AS id, round(result, 6) AS value FROM metric_rows JOIN m USING (session_key)
UNION ALL SELECT session_key, 'evaluation', n, '', CAST(sum(CAST(json_extract_string(reasoning, '$.' || n) AS BIGINT)) AS DOUBLE) FROM verdicts JOIN m USING (session_key), (SELECT unnest(['total_fatal', 'total_minor']) AS n) GROUP BY 1, n""")
def _(s, d):
    inside = members(s, d).where(F.col("group_id").endswith("_root")).select("session_key").distinct()
    res = table(s, d, "metric_rows").select("session_key", F.lit("metric").alias("kind"), F.col("metric").alias("name"), F.col("result_id").alias("id"), r6("result").alias("value"))
    get = lambda n: F.struct(F.lit(n).alias("name"), F.get_json_object("reasoning", f"$.{n}").cast("double").alias("value"))
    ev = table(s, d, "verdicts").select("session_key", F.inline(F.array(get("total_fatal"), get("total_minor")))).groupBy("session_key", "name").agg(F.sum("value").alias("value"))
    ev = ev.select("session_key", F.lit("evaluation").alias("kind"), "name", F.lit("").alias("id"), "value")
    return res.unionByName(ev).join(inside, "session_key", "left_semi")


@query("application_rows", "2.4.19", sql="""
WITH a AS (SELECT application_id, max(ts) AS last_ts FROM flat GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)
SELECT DISTINCT application_id, 'agent' AS kind, split_part(agent_id, '.', 1) AS name, '' AS id, 0.0::DOUBLE AS value FROM flat JOIN a USING (application_id) WHERE agent_id <> ''
UNION ALL SELECT application_id, 'metric', metric, result_id, round(result, 6) FROM metric_rows JOIN a USING (application_id)""")
def _(s, d):
    page = sp.application_list(spans(s, d)).orderBy(F.desc("last_ts"), "application_id").limit(3).select("application_id")
    agents = table(s, d, "flat").where("agent_id <> ''").join(page, "application_id", "left_semi").select(
        "application_id", F.lit("agent").alias("kind"), sp.base_name("agent_id").alias("name"), F.lit("").alias("id"), F.lit(0.0).alias("value")).distinct()
    rows = table(s, d, "metric_rows").join(page, "application_id", "left_semi").select(
        "application_id", F.lit("metric").alias("kind"), F.col("metric").alias("name"), F.col("result_id").alias("id"), r6("result").alias("value"))
    return agents.unionByName(rows)


@query("group_list_rows", "2.4.23", sql="SELECT group_id, 'session' AS kind, session_key AS id FROM members UNION ALL SELECT parent_id, 'child', child_id FROM group_edges")
def _(s, d):
    children = table(s, d, "group_edges").select(F.col("parent_id").alias("group_id"), F.lit("child").alias("kind"), F.col("child_id").alias("id"))
    return members(s, d).select("group_id", F.lit("session").alias("kind"), F.col("session_key").alias("id")).unionByName(children)


@query("group_analysis_rows", "2.4.28", sql="""
WITH nx AS (SELECT DISTINCT t1.owner AS a, t2.owner AS b FROM g_states_of t1 JOIN g_states_of t2 ON t1.s1 = t2.s0 JOIN g_calls c1 ON c1.call_id = t1.owner AND c1.kind = 'agent' JOIN g_calls c2 ON c2.call_id = t2.owner AND c2.kind = 'agent'),
 g AS (SELECT group_id, session_key FROM group_sessions WHERE session_key IN (SELECT session FROM g_sessions))
SELECT group_id, session_key, 'metric' AS kind, metric AS a, provider AS b, round(result, 6) AS value FROM (SELECT DISTINCT session_key, metric, result, provider FROM metric_rows) JOIN g USING (session_key)
UNION ALL SELECT group_id, session_key, 'node', call_id, '', 0.0 FROM g_calls c JOIN g ON g.session_key = c.session WHERE kind = 'agent'
UNION ALL SELECT group_id, session_key, 'edge', a, b, 0.0 FROM nx JOIN g_calls c ON c.call_id = nx.a JOIN g ON g.session_key = c.session""")
def _(s, d):
    nodes, edges = graph(s, d)
    known = table(s, d, "group_sessions").select("group_id", "session_key").join(tv.of_type(nodes, "Session").select(F.col("id").alias("session_key")), "session_key", "left_semi")
    calls = tv.of_type(nodes, "AgentCall").select(F.col("id").alias("call"), F.col("session_id").alias("session_key"))
    chain = tv.hop(calls, edges, "correspondsToTransition", "call", "t1")
    chain = tv.hop(tv.hop(tv.hop(chain, edges, "leadsTo", "t1", "state"), edges, "inputTo", "state", "t2"), edges, "representsExecution", "t2", "next")
    chain = chain.join(calls.select(F.col("call").alias("next")), "next", "left_semi").select("session_key", "call", "next").distinct()
    rows = table(s, d, "metric_rows").select("session_key", F.lit("metric").alias("kind"), F.col("metric").alias("a"), F.col("provider").alias("b"), "result").distinct()
    every = rows.withColumnRenamed("result", "value").withColumn("value", r6("value"))
    every = every.unionByName(calls.select("session_key", F.lit("node").alias("kind"), F.col("call").alias("a"), F.lit("").alias("b"), F.lit(0.0).alias("value")))
    every = every.unionByName(chain.select("session_key", F.lit("edge").alias("kind"), F.col("call").alias("a"), F.col("next").alias("b"), F.lit(0.0).alias("value")))
    return known.join(every, "session_key")


@query("cognitive_sessions", "2.4.49", sql="""
SELECT session_key, row_number() OVER (ORDER BY started DESC, session_key) AS position, seconds, agents, tokens FROM (
 SELECT session_key, min(ts) AS started, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS seconds, string_agg(DISTINCT split_part(agent_id, '.', 1), ',' ORDER BY split_part(agent_id, '.', 1)) AS agents,
  CAST(coalesce(sum(TRY_CAST(input_tokens AS BIGINT) + TRY_CAST(output_tokens AS BIGINT)) FILTER (kind = 'chat'), 0) AS BIGINT) AS tokens FROM flat GROUP BY 1)""")
def _(s, d):
    from spanloom.functions.ordered import Sequence

    f = table(s, d, "flat")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    per = f.groupBy("session_key").agg(
        F.min("ts").alias("started"), r6((us(F.max("ts")) - us(F.min("ts"))) / 1e6).alias("seconds"),
        F.array_join(F.array_sort(F.collect_set(sp.base_name("agent_id"))), ",").alias("agents"),
        F.coalesce(F.sum(F.when(F.col("kind") == "chat", F.col("input_tokens").try_cast("long") + F.col("output_tokens").try_cast("long"))), F.lit(0)).alias("tokens"))
    ranked = per.withColumns({"all": F.lit(1), "newest": -us(F.col("started"))})
    return Sequence(ranked, ["all"], ["newest", "session_key"]).number("position").done().select("session_key", "position", "seconds", "agents", "tokens")


@query("cognitive_session_items", "2.4.49", sql="""
SELECT session_key, 'metric' AS kind, metric AS name, '' AS id, round(avg(result), 6) AS value FROM metric_rows GROUP BY 1, 3
UNION ALL SELECT session_key, 'failure', status_message, span_id, 0.9 FROM flat WHERE status_message <> ''""")
def _(s, d):
    m = table(s, d, "metric_rows").groupBy("session_key", F.col("metric").alias("name")).agg(r6(F.avg("result")).alias("value"))
    m = m.select("session_key", F.lit("metric").alias("kind"), "name", F.lit("").alias("id"), "value")
    bad = table(s, d, "flat").where("status_message <> ''").select(
        "session_key", F.lit("failure").alias("kind"), F.col("status_message").alias("name"), F.col("span_id").alias("id"), F.lit(0.9).alias("value"))
    return m.unionByName(bad)


@query("batch_phase_summary", "2.8.9", sql="""
SELECT application_id, call_type AS phase, count(DISTINCT session_key) AS n_sessions, count(*) AS total_spans, count(*) FILTER (failed AND call_type = 'llm') AS fatal, count(*) FILTER (failed AND call_type <> 'llm') AS minor, round(sum(tokens), 2) AS tokens
FROM calls JOIN call_sessions USING (session_key) GROUP BY 1, 2""")
def _(s, d):
    c = table(s, d, "calls").join(table(s, d, "call_sessions").select("session_key", "application_id"), "session_key")
    model = F.col("call_type") == "llm"
    per = c.groupBy("application_id", "session_key", F.col("call_type").alias("phase")).agg(
        F.count(F.lit(1)).alias("total_spans"), F.count_if(F.col("failed") & model).alias("fatal"), F.count_if(F.col("failed") & ~model).alias("minor"), F.sum("tokens").alias("tokens"))
    return tr.batch_summary(per, ["total_spans", "fatal", "minor", "tokens"], ["application_id", "phase"]).withColumn("tokens", F.round("tokens", 2))


@query("reward_alignment_overall", "2.8.10", sql="""
WITH r AS (SELECT application_id, label, expected, tokens, seconds FROM (
 SELECT session_key, CASE WHEN count(*) FILTER (failed) > 1 THEN 0 ELSE 1 END AS label, sum(tokens) AS tokens, count(*) * 1.5 AS seconds FROM calls GROUP BY 1) JOIN (SELECT session_key, application_id, CASE WHEN total > 200000 THEN 1 ELSE 0 END AS expected FROM call_sessions) USING (session_key)),
 a AS (SELECT * FROM r UNION ALL SELECT 'overall', label, expected, tokens, seconds FROM r)
SELECT application_id AS domain, count(*) AS n, round(avg(CASE WHEN label = expected THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(tokens), 6) AS mean_tokens, round(avg(seconds), 6) AS mean_seconds,
 round(quantile_cont(tokens, 0.5), 6) AS median_tokens, round(quantile_cont(CAST(seconds AS DOUBLE), 0.5), 6) AS median_seconds FROM a GROUP BY 1""")
def _(s, d):
    res = table(s, d, "calls").groupBy("session_key").agg(
        F.when(F.count_if("failed") > 1, 0).otherwise(1).alias("label"), F.sum("tokens").alias("tokens"), (F.count(F.lit(1)) * 1.5).alias("seconds"))
    sessions = table(s, d, "call_sessions").select("session_key", "application_id", F.when(F.col("total") > 200000, 1).otherwise(0).alias("expected"))
    exp = sessions.select("session_key", F.explode(F.array("application_id", F.lit("overall"))).alias("domain"), "expected")
    out = tr.reward_alignment(res, exp, ["session_key"], "domain", ["tokens", "seconds"])
    return out.withColumns({c: r6(c) for c in ("accuracy", "mean_tokens", "mean_seconds", "median_tokens", "median_seconds")})


@query("consensus_nodes", "2.9.25", sql=CONS + " SELECT DISTINCT application_id, node FROM (SELECT application_id, src AS node FROM k UNION ALL SELECT application_id, dst FROM k)")
def _(s, d):
    nodes, edges = call_graphs(s, d)
    k = gr.consensus_edges(agent_edges(edges), nodes, ["application_id"], "session_key", 0.06)
    return k.select("application_id", F.explode(F.array("src", "dst")).alias("node")).distinct()


#: Fixed value: neighbours of the local outlier factor.
LOF_K = 20


def lof_sql(k):
    return LOF.replace("rn <= 5", f"rn <= {k}")


LOF = """
 n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, a ORDER BY dd, b) AS rn FROM p) WHERE rn <= 5), kd AS (SELECT g, a, max(dd) AS kd FROM n GROUP BY 1, 2),
 de AS (SELECT n.g, n.a, 1 / (avg(greatest(n.dd, kd.kd)) + 1e-10) AS de FROM n JOIN kd ON kd.g = n.g AND kd.a = n.b GROUP BY 1, 2)
SELECT o.g AS grp, o.a AS id, round(avg(t.de) / max(o.de), 4) AS lof FROM de o JOIN n ON n.g = o.g AND n.a = o.a JOIN de t ON t.g = n.g AND t.a = n.b GROUP BY 1, 2"""


@query("vector_outliers_lof", "2.9.17", sql="""
WITH p AS (SELECT x.group_id AS g, x.session_key AS a, y.session_key AS b, list_distance(CAST(x.vector AS DOUBLE[]), CAST(y.vector AS DOUBLE[])) AS dd FROM vectors x JOIN vectors y ON x.group_id = y.group_id AND x.session_key <> y.session_key),""" + LOF)
def _(s, d):
    near = nb.group_neighbours(vectors(s, d).withColumnRenamed("session_key", "id"), "group_id", 5)
    return nb.local_outlier_factor(near, "group_id", 5).select(F.col("group_id").alias("grp"), "id", F.round("lof", 4).alias("lof"))


@query("metric_outliers_lof", "2.9.16", sql="""
WITH f AS (SELECT * FROM gvals WHERE isfinite(value)),
 p AS (SELECT x.group_id || '|' || x.metric AS g, x.id AS a, y.id AS b, abs(x.value - y.value) AS dd FROM f x JOIN f y ON x.group_id = y.group_id AND x.metric = y.metric AND x.id <> y.id),""" + lof_sql(LOF_K))
def _(s, d):
    rows = gr.finite(values(s, d)).select(F.concat_ws("|", "group_id", "metric").alias("g"), "id", F.array("value").alias("vector"))
    near = nb.group_neighbours(rows, "g", LOF_K)
    return nb.local_outlier_factor(near, "g", LOF_K).select(F.col("g").alias("grp"), "id", F.round("lof", 4).alias("lof"))


@query("metric_outliers_lof_all", "2.9.16")
def _(s, d):
    """With five neighbours; tests hold it against brute force."""
    rows = gr.finite(values(s, d)).select(F.concat_ws("|", "group_id", "metric").alias("g"), "id", F.array("value").alias("vector"))
    near = nb.group_neighbours(rows, "g", 5)
    return nb.local_outlier_factor(near, "g", 5).select(F.col("g").alias("grp"), "id", F.round("lof", 4).alias("lof"))


@query("chart_sessions", "2.10.8", "2.10.10", sql="SELECT DISTINCT application_id, agent, period, session_key FROM slots")
def _(s, d):
    from spanloom.operators import metrics as m

    points = m.with_epoch(table(s, d, "metric_rows"))
    return m.in_period(points, m.period_bounds(points, ["application_id"]), ["application_id"]).select("application_id", "agent", "period", "session_key").distinct()
