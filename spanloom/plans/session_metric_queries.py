"""Queries for the deterministic metrics of sessions and calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import session_metrics as sm
from spanloom.plans.graph_tables import call_table, graph
from spanloom.plans.registry import query
from spanloom.plans.span_queries import price_list
from spanloom.sources.fixtures import oracle_define, table

LLM = """(SELECT session, call_id, CAST(k * 10 AS BIGINT) AS p, CASE WHEN k % 7 <> 6 THEN k ELSE 0 END AS c,
 CASE WHEN k % 2 = 0 THEN k * 11 ELSE 0 END AS t, model, t0 FROM g_calls WHERE kind = 'llm')"""
PRICES = "(SELECT 'model' || CAST(p_partkey AS VARCHAR) AS model, p_retailprice / 1e9 AS ip, p_retailprice / 5e8 AS op FROM part WHERE p_partkey <> 1)"


def r6(c):
    return F.round(c, 6)


@query("call_durations", "2.7.1", sql="""
SELECT node_type, id, round(CASE WHEN duration > 0 THEN duration ELSE greatest(0.0, (end_time - start_time) * 1000) END, 3) AS value FROM g_nodes
WHERE node_type IN ('Session', 'MASCall', 'AgentCall', 'LLMCall', 'ToolCall')""")
def _(s, d):
    return sm.call_duration(graph(s, d)[0]).withColumn("value", F.round("value", 3))


@query("token_count", "2.7.2", sql=f"SELECT session AS session_id, CAST(sum(CASE WHEN t > 0 THEN t ELSE p + c END) AS BIGINT) AS tokens FROM {LLM} GROUP BY 1")
def _(s, d):
    return sm.token_count(graph(s, d)[0])


@query("call_count", "2.7.3", sql="SELECT session AS session_id, count(*) AS calls FROM g_calls WHERE kind <> 'agent' GROUP BY 1")
def _(s, d):
    return sm.call_count(graph(s, d)[0])


@query("session_cost", "2.7.4", sql=f"""
SELECT session AS session_id, CAST(sum(i) AS BIGINT) AS tokens_in, CAST(sum(o) AS BIGINT) AS tokens_out, round((sum(i) * 10.0 + sum(o) * 30.0) / 1e6, 6) AS cost FROM (
 SELECT session, CASE WHEN p = 0 AND c = 0 AND t > 0 THEN CAST(floor(t * 0.7) AS BIGINT) ELSE p END AS i, CASE WHEN p = 0 AND c = 0 AND t > 0 THEN CAST(floor(t * 0.3) AS BIGINT) ELSE c END AS o FROM {LLM}) GROUP BY 1""")
def _(s, d):
    return sm.session_cost(graph(s, d)[0])


@query("priced_cost", "2.7.5", sql=f"""
WITH pr AS {PRICES}, dflt AS (SELECT ip, op FROM pr WHERE model = 'model7'),
 u AS (SELECT session, model, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens FROM {LLM} GROUP BY 1, 2)
SELECT session, u.model, prompt_tokens, completion_tokens, round(prompt_tokens * coalesce(pr.ip, dflt.ip) + completion_tokens * coalesce(pr.op, dflt.op), 8) AS cost
FROM u LEFT JOIN pr ON pr.model = u.model CROSS JOIN dflt""")
def _(s, d):
    used = call_table(s, d).where("kind = 'llm'").groupBy("session", "model").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    return sm.priced_cost(used, price_list(s, d), "model7").drop("input_price", "output_price")


@query("phase_costs", "2.7.6", sql=f"""
WITH pr AS {PRICES}, dflt AS (SELECT ip, op FROM pr WHERE model = 'model7'), u AS (SELECT session_key, 'vendor/model' || CAST(max(l_suppkey % 4) AS VARCHAR) AS model,
 {', '.join(f"CAST(sum(CASE WHEN idx % 5 = {i} THEN tokens ELSE 0 END) AS BIGINT) AS p{i}, count(*) FILTER (idx % 5 = {i}) AS c{i}" for i in range(5))} FROM calls GROUP BY 1),
 long AS ({' UNION ALL '.join(f"SELECT session_key, model, '{ph}' AS phase, p{i} AS prompt_tokens, c{i} AS completion_tokens FROM u" for i, ph in enumerate(sm.PHASES))})
SELECT session_key, phase, prompt_tokens, completion_tokens, round(prompt_tokens * coalesce(pr.ip, dflt.ip) + completion_tokens * coalesce(pr.op, dflt.op), 8) AS cost
FROM long LEFT JOIN pr ON 'vendor/' || pr.model = long.model CROSS JOIN dflt""")
def _(s, d):
    at = lambda i: F.col("idx") % 5 == i
    cols = [c for i, ph in enumerate(sm.PHASES) for c in (
        F.sum(F.when(at(i), F.col("tokens")).otherwise(0.0)).cast("bigint").alias(f"{ph}_prompt_tokens"),
        F.count_if(at(i)).alias(f"{ph}_completion_tokens"))]
    usage = table(s, d, "calls").groupBy("session_key").agg(
        F.concat(F.lit("vendor/model"), F.max(F.col("l_suppkey") % 4).cast("string")).alias("model"), *cols)
    return sm.phase_costs(usage, price_list(s, d), "model7", ["session_key"]).select(
        "session_key", "phase", "prompt_tokens", "completion_tokens", "cost")


@query("llm_confidence", "2.7.7", sql="""
SELECT o_orderpriority AS grp, round(avg(p), 6) AS mean_confidence, round(min(p), 6) AS min_confidence, round(max(p), 6) AS max_confidence FROM (
 SELECT o_orderpriority, exp(-l_discount) AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT o_orderpriority, exp(-l_tax * 3) FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1""")
def _(s, d):
    rows = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    tok = lambda x: F.struct(F.lit("w").alias("token"), (-x).alias("logprob"))
    payload = F.to_json(F.struct(F.struct(F.array(tok(F.col("l_discount")), tok(F.col("l_tax") * 3)).alias("content")).alias("logprobs")))
    out = sm.llm_confidence(rows.select(F.col("o_orderpriority").alias("grp"), payload.alias("payload")), ["grp"])
    return out.select("grp", *[r6(c).alias(c) for c in ("mean_confidence", "min_confidence", "max_confidence")])


oracle_define("call_errors", """
SELECT session_key, CASE WHEN l = 0 THEN 0.0 ELSE bl / l END AS llm_error_rate, CASE WHEN t = 0 THEN 0.0 ELSE bt / t END AS tool_error_rate, (l = 0 OR bl < l) AND (t = 0 OR bt < t) AS completed FROM (
 SELECT session_key, count(*) FILTER (call_type = 'llm') AS l, count(*) FILTER (call_type = 'llm' AND failed) AS bl, count(*) FILTER (call_type = 'tool') AS t, count(*) FILTER (call_type = 'tool' AND failed) AS bt FROM calls GROUP BY 1)""")


@query("error_rates", "2.7.8", sql="SELECT session_key, round(llm_error_rate, 6) AS llm_error_rate, round(tool_error_rate, 6) AS tool_error_rate, completed FROM call_errors")
def _(s, d):
    out = sm.error_rates(table(s, d, "calls"), ["session_key"])
    return out.withColumns({c: r6(c) for c in ("llm_error_rate", "tool_error_rate")})


@query("tool_errors", "2.7.9", sql="SELECT call_id AS id, CASE WHEN success THEN 0 ELSE 1 END AS value FROM g_calls WHERE kind = 'tool'")
def _(s, d):
    return sm.tool_errors(graph(s, d)[0])


@query("completion_rate", "2.7.10", sql="""
SELECT application_id, round(avg(CASE WHEN completed THEN 1.0 ELSE 0.0 END), 6) AS completion_rate FROM call_errors JOIN call_sessions USING (session_key) GROUP BY 1""")
def _(s, d):
    per = sm.error_rates(table(s, d, "calls"), ["session_key"]).join(table(s, d, "call_sessions"), "session_key")
    return sm.completion_rate(per, ["application_id"]).withColumn("completion_rate", r6("completion_rate"))


@query("agent_tool_interactions", "2.7.11", sql="""
SELECT *, CAST(sum(n) OVER (PARTITION BY session) AS BIGINT) AS total, count(*) OVER (PARTITION BY session) AS distinct_pairs FROM (
 SELECT c.session, o.agent, c.entity AS tool, count(*) AS n FROM g_owned c JOIN g_calls o ON o.call_id = c.o_call WHERE c.kind = 'tool' GROUP BY 1, 2, 3)""")
def _(s, d):
    from spanloom.operators.graph_build import owned

    c = call_table(s, d)
    who = c.where("kind = 'agent'").select(F.col("call_id").alias("owner_call_id"), F.col("agent").alias("who"))
    used = owned(c).where("kind = 'tool'").join(who, "owner_call_id").select("session", F.col("who").alias("agent"), F.col("entity").alias("tool"))
    return sm.agent_tool_interactions(used, ["session"])


STEP = "(SELECT *, lag(agent) OVER (PARTITION BY session_key ORDER BY idx, l_partkey, l_suppkey) AS prev FROM calls)"
ORDER = ["idx", "l_partkey", "l_suppkey"]


@query("agent_transitions", "2.7.12", sql=f"SELECT session_key, prev AS from_agent, agent AS to_agent, count(*) AS n FROM {STEP} WHERE prev IS NOT NULL GROUP BY 1, 2, 3")
def _(s, d):
    return sm.transitions(table(s, d, "calls"), ["session_key"], ORDER)


def signed_steps(s, d):
    sig = sm.call_signature(F.lit(""), F.concat_ws("", F.lit("x_"), F.when(F.col("idx") % 2 == 0, "task").otherwise("call"), F.lit("_"), (F.col("l_partkey") % 2).cast("string")))
    return table(s, d, "calls").withColumn("signature", sig)


oracle_define("collapsed", """
SELECT * FROM (SELECT *, lag(agent) OVER w AS pa, lag(l_partkey % 2) OVER w AS ps FROM calls WINDOW w AS (PARTITION BY session_key ORDER BY idx, l_partkey, l_suppkey))
WHERE NOT (pa IS NOT NULL AND pa = agent AND ps = l_partkey % 2)""")


@query("collapsed_duplicates", "2.7.13", sql="SELECT session_key, count(*) AS n FROM collapsed GROUP BY 1")
def _(s, d):
    return sm.collapse_duplicates(signed_steps(s, d), ["session_key"], ORDER).groupBy("session_key").agg(F.count(F.lit(1)).alias("n"))


@query("workflow_efficiency", "2.7.14", sql="""
SELECT k.session_key, coalesce(total, 0) AS total, coalesce(u, 0) AS distinct_transitions, round(CASE WHEN total > 0 THEN least(1.0, u / total) ELSE 0.0 END, 6) AS efficiency
FROM (SELECT DISTINCT session_key FROM calls) k LEFT JOIN (SELECT session_key, count(*) AS total, count(DISTINCT p || '>' || agent) AS u FROM (
 SELECT session_key, agent, lag(agent) OVER (PARTITION BY session_key ORDER BY idx, l_partkey, l_suppkey) AS p FROM collapsed) WHERE p IS NOT NULL GROUP BY 1) t USING (session_key)""")
def _(s, d):
    return sm.workflow_efficiency(signed_steps(s, d), ["session_key"], ORDER).withColumn("efficiency", r6("efficiency"))


@query("cycle_counts", "2.7.15", sql=f"""
WITH RECURSIVE s AS (SELECT session_key, list(agent ORDER BY {', '.join(ORDER)}) AS q FROM calls WHERE coalesce(agent, '') <> '' GROUP BY 1),
 r(session_key, q, i, k, found) AS (SELECT session_key, q, CAST(1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM s UNION ALL
  SELECT session_key, q, i + greatest(b, 1), b, found + CASE WHEN b > 0 THEN 1 ELSE 0 END FROM (
   SELECT *, coalesce(list_filter(range(2, (len(q) - i + 1) // 2 + 1), lambda z: q[i:i + z - 1] = q[i + z:i + 2 * z - 1])[1], 0) AS b FROM r WHERE i <= len(q)) x)
SELECT session_key, max(found) AS cycles FROM r GROUP BY 1""")
def _(s, d):
    return sm.cycles(table(s, d, "calls"), ["session_key"], ORDER)


@query("graph_determinism", "2.7.16", sql=f"""
WITH e AS (SELECT DISTINCT application_id, session_key, prev, agent FROM {STEP} JOIN call_sessions USING (session_key) WHERE prev IS NOT NULL),
 n AS (SELECT application_id, count(*) AS n FROM call_sessions GROUP BY 1), c AS (SELECT application_id, prev, agent, count(*) AS c FROM e GROUP BY 1, 2, 3)
SELECT n.application_id, round(sum(c * (n - c)) / (max(n.n) * (max(n.n) - 1) / 2), 6) AS determinism FROM n JOIN c USING (application_id) GROUP BY 1""")
def _(s, d):
    sessions = table(s, d, "call_sessions")
    edges = sm.transitions(table(s, d, "calls"), ["session_key"], ORDER).join(sessions, "session_key")
    return sm.graph_determinism(edges, sessions, ["application_id"]).withColumn("determinism", r6("determinism"))


@query("aggregate_metric", "2.7.17", sql="""
SELECT k.session_key, round(coalesce(avg(result), 0), 6) AS avg_value, coalesce(max(result), 0) AS max_value, coalesce(min(result), 0) AS min_value, round(coalesce(sum(result), 0), 6) AS sum_value, count(result) AS n
FROM (SELECT DISTINCT session_key FROM metric_rows) k LEFT JOIN metric_rows m ON m.session_key = k.session_key AND m.metric = 'AnswerRelevancy' GROUP BY 1""")
def _(s, d):
    m = table(s, d, "metric_rows")
    out = sm.aggregate_metric(m.where("metric = 'AnswerRelevancy'"), ["session_key"], m.select("session_key").distinct())
    return out.withColumns({"avg_value": r6("avg_value"), "sum_value": r6("sum_value")})


CATALOGUE = [("AnswerRelevancy", "session"), ("Cost", "llm"), ("ToolErrorRate", "tool"), ("Fluency", "")]


@query("missing_results", "2.7.18", sql="""
WITH c(metric, target) AS (VALUES ('AnswerRelevancy', 'session'), ('Cost', 'llm'), ('ToolErrorRate', 'tool'), ('Fluency', ''))
SELECT s.session_key, c.metric, CASE WHEN target = '' THEN 'no target type' WHEN target <> 'session' AND NOT EXISTS (
  SELECT 1 FROM g_calls g WHERE g.session = s.session_key AND g.kind = c.target) THEN 'no matching batch' ELSE 'no data' END AS reason
FROM (SELECT DISTINCT session_key FROM metric_rows) s, c WHERE NOT EXISTS (SELECT 1 FROM metric_rows m WHERE m.session_key = s.session_key AND m.metric = c.metric)""")
def _(s, d):
    m = table(s, d, "metric_rows")
    present = call_table(s, d).select(F.col("session").alias("session_key"), F.col("kind").alias("call_type"))
    return sm.missing_results(m, s.createDataFrame(CATALOGUE, "metric string, target string"), m, present)


@query("judge_scores", "2.7.19", sql="""
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN CAST(turn % 5 AS DOUBLE) + 0.5 WHEN 1 THEN CAST(turn % 4 AS DOUBLE) ELSE -1.0 END AS score FROM conversations""")
def _(s, d):
    t = F.col("turn")
    reply = F.when(t % 3 == 0, F.concat(F.lit("Score: 9\n"), F.regexp_replace("text", "[0-9]", ""), F.lit("\nFinal rating: **"), (t % 5).cast("string"), F.lit(".5**"))).when(
        t % 3 == 1, F.concat(F.lit(" **"), (t % 4).cast("string"), F.lit("** "))).otherwise(F.lit("no number"))
    return table(s, d, "conversations").select("conv_id", "turn", F.coalesce(sm.judge_score(reply), F.lit(-1.0)).alias("score"))


@query("expected_scores", "2.7.19", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((1 * exp(-l_discount) + 3 * exp(-l_tax) + 5 * exp(-0.5)) / (exp(-l_discount) + exp(-l_tax) + exp(-0.5)), 6) AS score FROM lineitem""")
def _(s, d):
    alt = lambda tok, lp: F.struct(F.lit(tok).alias("token"), lp.alias("logprob"))
    alts = F.array(alt(" 1", -F.col("l_discount")), alt("3", -F.col("l_tax")), alt("5", F.lit(-0.5)), alt("5", F.lit(-2.0)), alt("x", F.lit(0.0)), alt("9", F.lit(0.0)))
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", alts.alias("alts"))
    return sm.expected_score(rows, "alts", 5).withColumn("score", r6("score")).drop("alts")


@query("conversation_texts", "2.7.20", sql="""
SELECT session, coalesce(arg_min(in_text, struct_pack(t := t0, c := call_id)) FILTER (kind = 'agent' AND in_text <> ''), arg_min(in_text, struct_pack(t := t0, c := call_id)) FILTER (kind = 'llm' AND in_text <> ''), '') AS query,
 coalesce(arg_max(out_text, struct_pack(t := t0, c := call_id)) FILTER (kind = 'agent' AND out_text <> ''), arg_max(out_text, struct_pack(t := t0, c := call_id)) FILTER (kind = 'llm' AND out_text <> ''), '') AS response
FROM g_calls WHERE kind IN ('agent', 'llm') GROUP BY 1""")
def _(s, d):
    return sm.conversation_text(call_table(s, d), ["session"])
