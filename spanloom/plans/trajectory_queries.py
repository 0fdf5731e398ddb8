"""Queries over trajectories, failures and symbolic values."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.scalar import sorted_text
from spanloom.operators import trajectory as tr
from spanloom.plans.graph_tables import call_table, graph
from spanloom.plans.registry import query
from spanloom.sources.fixtures import oracle_define, table


def r6(c):
    return F.round(c, 6)


@query("trajectory_steps", "2.8.1", sql="""
SELECT c.call_id AS call, c.session, row_number() OVER (PARTITION BY c.session ORDER BY t0, span_id) AS pos, c.target AS entity, coalesce(o.o_call, '') AS owner, CASE WHEN c.in_text = '' THEN '(no content recorded)' ELSE c.in_text END AS input
FROM g_calls c LEFT JOIN (SELECT call_id, o_call FROM g_owned) o ON o.call_id = c.call_id""")
def _(s, d):
    return tr.steps(*graph(s, d)).select("call", "session", "pos", "entity", F.coalesce("owner", F.lit("")).alias("owner"), "input")


@query("output_loops", "2.8.2", sql="""
WITH f AS (SELECT session, t0, span_id, out_text, lag(out_text) OVER (PARTITION BY session ORDER BY t0, span_id) AS p FROM g_calls),
 r AS (SELECT *, sum(CASE WHEN p IS NULL OR out_text = '' OR p = '' OR out_text <> p THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY t0, span_id) AS run FROM f),
 n AS (SELECT session, run, count(*) AS n, max(out_text) AS content FROM r WHERE out_text <> '' GROUP BY 1, 2)
SELECT session, n AS run, content FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY n DESC, run) AS rn FROM n) WHERE rn = 1 AND n >= 3""")
def _(s, d):
    return tr.loops(call_table(s, d), ["session"], ["start", "span_id"], "out_text")


@query("sampling_plan", "2.8.3", sql="""
WITH b AS (SELECT session_key, idx, kind, failed, output, lag(kind) OVER w AS pk, lag(length(output)) OVER w AS pl FROM sample_steps WINDOW w AS (PARTITION BY session_key ORDER BY idx)),
 u AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY session_key) AS t, lag(failed) OVER w AS pf, lead(failed) OVER w AS nf FROM b WHERE kind IN ('llm', 'tool') WINDOW w AS (PARTITION BY session_key ORDER BY idx)),
 a AS (SELECT *, n = 1 OR n = t OR failed OR coalesce(pf, FALSE) OR coalesce(nf, FALSE) OR coalesce(kind = 'llm' AND pk = 'tool' AND pl >= 2000, FALSE) AS anchor, (n - 1) / greatest(t - 1, 1) AS pos,
  CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS BIGINT) / 4294967295.0 AS hv FROM (SELECT *, md5(CAST(idx AS VARCHAR)) AS h FROM u))
SELECT session_key, idx, anchor, anchor OR t <= 1 OR pos >= 0.7 OR hv < CASE WHEN pos < 0.4 THEN 0.25 ELSE 0.6 END AS evaluate FROM a""")
def _(s, d):
    return tr.sampling_plan(sample_steps(s, d), ["session_key"], "idx").select("session_key", "idx", "anchor", "evaluate")


oracle_define("sample_steps", """
SELECT session AS session_key, row_number() OVER (PARTITION BY session ORDER BY t0, span_id) - 1 AS idx, kind, NOT success AS failed, CASE WHEN k % 4 = 0 THEN repeat('x', 2100) ELSE out_text END AS output FROM (SELECT session, t0, span_id, CASE kind WHEN 'agent' THEN 'other' ELSE kind END AS kind, success, k, out_text FROM g_calls)""")


def sample_steps(s, d):
    from spanloom.functions.ordered import Sequence

    c = call_table(s, d).join(table(s, d, "span_rows").select("span_id", "k"), "span_id")
    rows = Sequence(c, ["session"], ["start", "span_id"]).number("pos").done()
    return rows.select(
        F.col("session").alias("session_key"), (F.col("pos") - 1).alias("idx"),
        F.when(F.col("kind") == "agent", "other").otherwise(F.col("kind")).alias("kind"), (~F.col("success")).alias("failed"),
        F.when(F.col("k") % 4 == 0, F.repeat(F.lit("x"), 2100)).otherwise(F.col("out_text")).alias("output"))


# Intent events from line items: the supplier names the intent.
oracle_define("intent_events", """
SELECT session_key, CASE WHEN l_suppkey % 5 = 0 THEN 'response_span_' || CAST(l_suppkey % 3 AS VARCHAR) WHEN l_suppkey % 11 = 0 THEN 'transfer_to_human_agents' ELSE 'intent' || CAST(l_suppkey % 3 AS VARCHAR) END AS name, call_type AS span_type, idx AS span_index, tokens / 50 AS score, l_partkey % 7 = 0 AS empty_output FROM calls""")
oracle_define("intents", """
SELECT *, CASE WHEN best >= 0.7 THEN 'fulfilled' WHEN n = 1 AND "first" < total * 0.4 THEN 'dormant' WHEN "first" >= total * 0.8 THEN 'dormant' ELSE 'drifting' END AS state FROM (
 SELECT e.session_key, name, t.total, CASE WHEN tn > 0 THEN tb ELSE lb END AS best, CASE WHEN tn > 0 THEN tn ELSE ln END AS n, CASE WHEN tn > 0 THEN tf ELSE lf END AS "first" FROM (
  SELECT session_key, name, max(score) FILTER (span_type = 'tool' AND NOT empty_output) AS tb, count(*) FILTER (span_type = 'tool' AND NOT empty_output) AS tn, min(span_index) FILTER (span_type = 'tool' AND NOT empty_output) AS tf,
   max(score) FILTER (span_type = 'llm') AS lb, count(*) FILTER (span_type = 'llm') AS ln, min(span_index) FILTER (span_type = 'llm') AS lf FROM intent_events GROUP BY 1, 2) e
 JOIN (SELECT session_key, count(*) AS total FROM calls GROUP BY 1) t USING (session_key) WHERE tn > 0 OR ln > 0)""")


def intents(s, d):
    c = table(s, d, "calls")
    k = F.col("l_suppkey")
    name = F.when(k % 5 == 0, F.concat(F.lit("response_span_"), (k % 3).cast("string"))).when(k % 11 == 0, tr.TRANSFER).otherwise(
        F.concat(F.lit("intent"), (k % 3).cast("string")))
    events = c.select("session_key", name.alias("name"), F.col("call_type").alias("span_type"), F.col("idx").alias("span_index"),
                      (F.col("tokens") / 50).alias("score"), (F.col("l_partkey") % 7 == 0).alias("empty_output"))
    totals = c.groupBy("session_key").agg(F.count(F.lit(1)).alias("total_spans"))
    return tr.intent_states(events, totals, ["session_key"], 0.7)


@query("intent_states", "2.8.4", sql="SELECT session_key, name, state, n, state = 'drifting' AND n >= 2 AND best < 0.7 AS unsatisfied FROM intents")
def _(s, d):
    return intents(s, d).select("session_key", "name", "state", "n", "unsatisfied")


oracle_define("failures", """
SELECT session_key, l_returnflag = 'R' AND l_partkey % 9 = 0 AS fatal, l_suppkey % 2 = 0 AS affects_score, CASE l_partkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'none' WHEN 2 THEN 'wrong_conclusion' ELSE 'wrong_action' END AS impact, l_partkey, idx FROM (SELECT c.*, l_returnflag FROM (SELECT *, CASE WHEN failed THEN 'R' ELSE 'N' END AS l_returnflag FROM calls) c) WHERE l_partkey % 3 <> 1""")


def failures(s, d):
    p = F.col("l_partkey")
    impact = F.when(p % 4 <= 1, "none").when(p % 4 == 2, "wrong_conclusion").otherwise("wrong_action")
    return table(s, d, "calls").where(p % 3 != 1).select(
        "session_key", (F.col("failed") & (p % 9 == 0)).alias("fatal"), (F.col("l_suppkey") % 2 == 0).alias("affects_score"), impact.alias("impact"), "l_partkey", "idx")


@query("trajectory_scores", "2.8.5", sql="""
SELECT k.session_key, coalesce(f.n, 0) AS n_fatal, coalesce(i.n, 0) AS n_open, CASE WHEN coalesce(f.n, 0) > 0 OR coalesce(i.n, 0) > 0 THEN 0 ELSE 1 END AS score FROM (SELECT DISTINCT session_key FROM calls) k
LEFT JOIN (SELECT session_key, count(*) AS n FROM failures WHERE fatal AND affects_score GROUP BY 1) f USING (session_key) LEFT JOIN (SELECT session_key, count(*) AS n FROM intents WHERE state = 'drifting' AND n >= 2 GROUP BY 1) i USING (session_key)""")
def _(s, d):
    return tr.trajectory_scores(failures(s, d), intents(s, d), table(s, d, "calls"), ["session_key"], unified=False)


REPLIES = ["", "Null", "[delegation] task 4 FAILED badly", '{"error": "boom"}', '{"error": "boom", "result": "ok"}', "Fine. We are still waiting for it. Bye",
           "Could you please share the file", "Sadly I cannot access that. Ask Bob", "This is not my responsibility.", "All good"]
OUTCOMES = ["no_response", "no_response", "failed", "failed", "completed", "waiting", "needs_input", "declined", "declined", "completed"]
CASES = lambda vals: " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(vals))


def replies(s, d):
    """Conversation turns with a known phrase put before the invented text."""
    k = (F.col("conv_id") + F.col("turn")) % len(REPLIES)
    phrase = F.element_at(F.array(*[F.lit(r) for r in REPLIES]), k.cast("int") + 1)
    whole = F.when(k.isin(0, 1, 3, 4), phrase).otherwise(F.concat(phrase, F.lit(". "), "text"))
    return table(s, d, "conversations").select("conv_id", "turn", whole.alias("reply"), ((F.col("turn") == 5) & (k == 9)).alias("failed"))


@query("work_outcomes", "2.8.6", sql=f"""
SELECT conv_id, turn, CASE WHEN turn = 5 AND (conv_id + turn) % 10 = 9 THEN 'failed' ELSE CASE (conv_id + turn) % 10 {CASES(OUTCOMES)} END END AS outcome FROM conversations""")
def _(s, d):
    return replies(s, d).select("conv_id", "turn", tr.work_outcome(F.col("reply"), F.col("failed")).alias("outcome"))


@query("reply_flags", "2.8.6", sql="""
SELECT conv_id, turn, 'waiting' AS flag, 'We are still waiting for it.' AS quote FROM conversations WHERE (conv_id + turn) % 10 = 5
UNION ALL SELECT conv_id, turn, 'needs_input', 'Could you please share the file.' FROM conversations WHERE (conv_id + turn) % 10 = 6
UNION ALL SELECT conv_id, turn, 'cannot_do', 'Sadly I cannot access that.' FROM conversations WHERE (conv_id + turn) % 10 = 7
UNION ALL SELECT conv_id, turn, 'out_of_scope', 'This is not my responsibility.' FROM conversations WHERE (conv_id + turn) % 10 = 8""")
def _(s, d):
    return tr.reply_flags(replies(s, d), ["conv_id", "turn"], "reply")


@query("repeated_calls", "2.8.7", sql="""
SELECT span_id, nth, count, coalesce(po, '') AS previous_outcome, CASE WHEN nth = 1 THEN '' WHEN parent <> '' AND parent = pspan THEN 'child_of_previous_call' WHEN parent <> '' AND parent = pparent THEN 'same_parent_span' ELSE 'different_parent_span' END AS relation FROM (
 SELECT span_id, parent_span_id AS parent, row_number() OVER w AS nth, count(*) OVER (PARTITION BY session, agent, entity, in_text) AS count, lag(CASE WHEN success THEN 'ok' ELSE 'bad' END) OVER w AS po, lag(span_id) OVER w AS pspan, lag(parent_span_id) OVER w AS pparent
 FROM g_calls WHERE kind = 'tool' AND in_text <> '' WINDOW w AS (PARTITION BY session, agent, entity, in_text ORDER BY t0, span_id)) WHERE count >= 2""")
def _(s, d):
    c = call_table(s, d).where("kind = 'tool'").select(
        "session", "agent", F.col("entity").alias("tool"), F.col("in_text").alias("input"), "start", "span_id", "parent_span_id", F.when(F.col("success"), "ok").otherwise("bad").alias("outcome"))
    out = tr.repeated_calls(c, ["session"], ["start", "span_id"])
    return out.select("span_id", "nth", "count", F.coalesce("previous_outcome", F.lit("")).alias("previous_outcome"), "relation")


@query("replay_scores", "2.8.8", sql="""
WITH i AS (SELECT session_key, count(*) FILTER (name LIKE 'response%' AND state = 'drifting') AS rd, count(*) FILTER (name LIKE 'response%' AND state = 'fulfilled') AS rf,
  bool_or(name NOT LIKE 'response%' AND state = 'fulfilled') AS tok, bool_or(name NOT LIKE 'response%' AND state = 'drifting') AS topen, bool_or(name = 'transfer_to_human_agents' AND state = 'fulfilled') AS tf FROM intents GROUP BY 1),
 f AS (SELECT session_key, count(*) FILTER (fatal) AS nf, count(*) FILTER (NOT fatal) AS mi, count(*) FILTER (NOT fatal AND impact = 'none') AS no, count(*) FILTER (NOT fatal AND impact = 'wrong_conclusion') AS wc, count(*) FILTER (NOT fatal AND impact = 'wrong_action') AS wa FROM failures GROUP BY 1),
 s AS (SELECT session_key, count(*) AS total FROM calls GROUP BY 1),
 a AS (SELECT s.session_key, total, coalesce(rd, 0) AS rd, coalesce(rf, 0) AS rf, coalesce(tok, FALSE) AS tok, coalesce(topen, FALSE) AS topen, coalesce(tf, FALSE) AS tf, coalesce(nf, 0) AS nf, coalesce(mi, 0) AS mi, coalesce(no, 0) AS no, coalesce(wc, 0) AS wc, coalesce(wa, 0) AS wa FROM s LEFT JOIN i USING (session_key) LEFT JOIN f USING (session_key)),
 g AS (SELECT session_key, nf, list_filter([CASE WHEN nf = 0 AND NOT (tok AND NOT topen) AND rd >= 1 AND (rf = 0 OR (rd + rf >= 3 AND rf / (rd + rf) < 0.2)) THEN 'response_span_drifting' END,
  CASE WHEN nf = 0 AND NOT tf AND mi >= greatest(4, floor(total * 0.45)) AND no = mi THEN 'low_signal_minor_cluster' END, CASE WHEN nf = 0 AND NOT tf AND mi <= 5 AND wc >= 3 THEN 'dense_short_wrong_conclusion_cluster' END,
  CASE WHEN nf = 0 AND NOT tf AND mi <= 5 AND no >= 4 AND wc >= 1 AND wa = 0 THEN 'low_signal_short_cluster_with_wrong_conclusion' END], lambda x: x IS NOT NULL) AS gates FROM a)
SELECT session_key, array_to_string(gates, ',') AS gates, CASE WHEN nf = 0 AND len(gates) = 0 THEN 1 ELSE 0 END AS label FROM g""")
def _(s, d):
    sessions = table(s, d, "calls").groupBy("session_key").agg(F.count(F.lit(1)).alias("total_spans"), F.lit(0).alias("unsatisfied_intents"))
    out = tr.replay_scores(sessions, intents(s, d), failures(s, d), ["session_key"], min_clusters=1)
    return out.select("session_key", F.array_join("gates", ",").alias("gates"), "label")


@query("batch_summary", "2.8.9", sql="""
SELECT application_id, count(*) AS n_sessions, CAST(sum(spans) AS BIGINT) AS total_spans, CAST(sum(fatal) AS BIGINT) AS fatal, round(sum(tokens), 2) AS tokens FROM (
 SELECT session_key, count(*) AS spans, count(*) FILTER (failed) AS fatal, sum(tokens) AS tokens FROM calls GROUP BY 1) JOIN call_sessions USING (session_key) GROUP BY 1""")
def _(s, d):
    per = table(s, d, "calls").groupBy("session_key").agg(
        F.count(F.lit(1)).alias("total_spans"), F.count_if("failed").alias("fatal"), F.sum("tokens").alias("tokens"))
    out = tr.batch_summary(per.join(table(s, d, "call_sessions"), "session_key"), ["total_spans", "fatal", "tokens"], ["application_id"])
    return out.withColumn("tokens", F.round("tokens", 2))


@query("reward_alignment", "2.8.10", sql="""
SELECT application_id AS domain, count(*) AS n, round(avg(CASE WHEN label = expected THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(tokens), 6) AS mean_tokens, round(quantile_cont(tokens, 0.5), 6) AS median_tokens FROM (
 SELECT session_key, CASE WHEN count(*) FILTER (failed) > 1 THEN 0 ELSE 1 END AS label, sum(tokens) AS tokens FROM calls GROUP BY 1) r JOIN (SELECT session_key, application_id, CASE WHEN total > 200000 THEN 1 ELSE 0 END AS expected FROM call_sessions) e USING (session_key) GROUP BY 1""")
def _(s, d):
    res = table(s, d, "calls").groupBy("session_key").agg(F.when(F.count_if("failed") > 1, 0).otherwise(1).alias("label"), F.sum("tokens").alias("tokens"))
    exp = table(s, d, "call_sessions").select("session_key", F.col("application_id").alias("domain"), F.when(F.col("total") > 200000, 1).otherwise(0).alias("expected"))
    out = tr.reward_alignment(res, exp, ["session_key"], "domain", ["tokens"])
    return out.withColumns({c: r6(c) for c in ("accuracy", "mean_tokens", "median_tokens")})


WILSON = lambda c, n, sign: f"(({c} / {n} + 1.959963984540054 ^ 2 / (2 * {n})) / (1 + 1.959963984540054 ^ 2 / {n}) {sign} 1.959963984540054 * sqrt({c} / {n} * (1 - {c} / {n}) / {n} + 1.959963984540054 ^ 2 / (4 * {n} * {n})) / (1 + 1.959963984540054 ^ 2 / {n}))"


@query("failure_rates", "2.8.11", sql=f"""
SELECT agent, call_type, failures, n, round(failures / n, 6) AS rate, round(greatest(0.0, {WILSON('failures', 'n', '-')}), 6) AS low, round(least(1.0, {WILSON('failures', 'n', '+')}), 6) AS high, round(failures / n - sum(failures) OVER (PARTITION BY call_type) / sum(n) OVER (PARTITION BY call_type), 6) AS lift
FROM (SELECT agent, call_type, count(*) FILTER (failed) AS failures, count(*) AS n FROM calls GROUP BY 1, 2)""")
def _(s, d):
    scores = table(s, d, "calls").withColumn("score", F.when(F.col("failed"), 0).otherwise(1))
    out = tr.failure_rates(scores, ["agent", "call_type"], ["call_type"]).drop("baseline")
    return out.withColumns({c: r6(c) for c in ("rate", "low", "high", "lift")})


@query("cohen_kappa", "2.8.12", sql="""
SELECT lang, round(po, 6) AS po, round(CASE WHEN a * b + (1 - a) * (1 - b) = 1 THEN CASE WHEN po = 1 THEN 1.0 END ELSE (po - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))) END, 6) AS kappa FROM (
 SELECT lang, avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) AS po, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END) AS b FROM labels JOIN documents USING (doc_id) GROUP BY 1)""")
def _(s, d):
    rows = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "lang"), "doc_id")
    return tr.cohen_kappa(rows, "quality", "toxic", ["lang"]).withColumns({"po": r6("po"), "kappa": r6("kappa")})


# -- symbolic values: variables are names of metrics, values are results over time ------------

TIER = "CASE WHEN metric IN ('Groundedness', 'CyclesCount') THEN 'alignment' ELSE 'observation' END"
oracle_define("sym", f"""
SELECT session_key, application_id, span_id AS span, metric AS variable, {TIER} AS tier, row_number() OVER (PARTITION BY session_key ORDER BY ts, result_id) - 1 AS idx, CAST(round(result * 10, 0) AS VARCHAR) AS value, result_id AS value_id, CAST(k % 3 AS VARCHAR) AS created FROM metric_rows""")


def symbolic(s, d):
    from spanloom.functions.ordered import Sequence

    rows = Sequence(table(s, d, "metric_rows"), ["session_key"], ["ts", "result_id"]).number("pos").done()
    return rows.select(
        "session_key", "application_id", F.col("span_id").alias("span"), F.col("metric").alias("variable"), F.expr(TIER).alias("tier"),
        (F.col("pos") - 1).alias("idx"), F.round(F.col("result") * 10, 0).cast("string").alias("value"), F.col("result_id").alias("value_id"), (F.col("k") % 3).cast("string").alias("created"))


@query("symbolic_final_state", "2.8.14", sql="""
SELECT session_key, variable, value, idx, value_id FROM (SELECT *, row_number() OVER (PARTITION BY session_key, variable ORDER BY idx DESC, created DESC, value_id DESC) AS rn FROM sym) WHERE rn = 1""")
def _(s, d):
    return tr.final_values(symbolic(s, d), ["session_key"]).select("session_key", "variable", "value", "idx", "value_id")


@query("symbolic_history", "2.8.15", sql="SELECT session_key, variable, value, value_id, row_number() OVER (PARTITION BY session_key, variable ORDER BY idx, created, value_id) AS pos FROM sym")
def _(s, d):
    return tr.value_history(symbolic(s, d), ["session_key"]).select("session_key", "variable", "value", "value_id", "pos")


DEPENDS = [("Groundedness", "AnswerRelevancy"), ("Groundedness", "Cost"), ("CyclesCount", "WorkflowEfficiency")]


@query("reasoning_timeline", "2.8.16", sql="""
WITH dep(variable, depends_on) AS (VALUES ('Groundedness', 'AnswerRelevancy'), ('Groundedness', 'Cost'), ('CyclesCount', 'WorkflowEfficiency')),
 p AS (SELECT s.*, depends_on FROM sym s JOIN dep USING (variable))
SELECT p.session_key, p.span, p.variable AS alignment, p.idx, p.depends_on AS dependency, arg_max(v.value, v.idx) AS value, max(v.idx) AS value_idx FROM p JOIN sym v ON v.session_key = p.session_key AND v.variable = p.depends_on AND v.idx <= p.idx GROUP BY 1, 2, 3, 4, 5""")
def _(s, d):
    return tr.reasoning_timeline(symbolic(s, d), s.createDataFrame(DEPENDS, "variable string, depends_on string"), ["session_key"])


oracle_define("sym_scores", "SELECT session_key, application_id, CASE WHEN sum(k) % 3 = 0 THEN 1.0 WHEN sum(k) % 3 = 1 THEN 0.0 ELSE 0.5 END AS score FROM metric_rows GROUP BY 1, 2")
oracle_define("sym_last", "SELECT s.application_id, variable, s.session_key, arg_max(value, idx) AS value, max(idx) AS last_idx FROM sym s JOIN sym_scores USING (session_key) GROUP BY 1, 2, 3")


def paths(s, d):
    m = F.sum("k") % 3
    scores = table(s, d, "metric_rows").groupBy("session_key", "application_id").agg(F.when(m == 0, 1.0).when(m == 1, 0.0).otherwise(0.5).alias("score"))
    return tr.reasoning_paths(symbolic(s, d), scores)


@query("reasoning_path_variables", "2.8.17", sql="SELECT application_id, variable, count(*) AS n_sessions, round(avg(last_idx), 6) AS mean_last_idx, count(DISTINCT value) AS n_values FROM sym_last GROUP BY 1, 2")
def _(s, d):
    return paths(s, d)[0].withColumn("mean_last_idx", r6("mean_last_idx"))


@query("reasoning_path_values", "2.8.17", sql="SELECT application_id, variable, value, count(*) AS n FROM sym_last GROUP BY 1, 2, 3")
def _(s, d):
    return paths(s, d)[1]


@query("reasoning_path_totals", "2.8.17", sql="SELECT application_id, count(*) AS n_sessions, count(*) FILTER (score = 1) AS passed, count(*) FILTER (score = 0) AS failed FROM sym_scores GROUP BY 1")
def _(s, d):
    return paths(s, d)[2]
