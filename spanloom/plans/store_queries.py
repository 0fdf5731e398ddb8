"""Queries for sources, upserts, and the remaining reads of stored reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spanloom import schema
from spanloom.functions.scalar import fold_text, nanoseconds
from spanloom.functions.vectors import cosine_distance, euclidean, norm
from spanloom.operators import metrics as m
from spanloom.operators import spans as sp
from spanloom.plans.graph_tables import call_table, graph
from spanloom.plans.registry import query
from spanloom.plans.traverse_queries import COS
from spanloom.session import shared_folder
from spanloom.sources import readers as rd
from spanloom.sources import sinks as sk
from spanloom.sources.fixtures import oracle_define, spans, table


def r6(c):
    return F.round(c, 6)


def scratch(s, name):
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


# -- sources: what is written as an export file is read back through the reader ---------------


def export_lines(s, d):
    """The span table as JSON lines of the export format, with one broken line."""
    sp_ = spans(s, d)
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    line = F.to_json(F.struct(
        F.concat(stamp, F.lit("789")).alias("Timestamp"), F.col("trace_id").alias("TraceId"), F.col("span_id").alias("SpanId"), F.col("parent_span_id").alias("ParentSpanId"),
        F.col("span_name").alias("SpanName"), F.col("service_name").alias("ServiceName"), F.col("attrs").alias("SpanAttributes"), F.col("duration").alias("Duration"),
        F.col("status_code").alias("StatusCode"), F.col("status_message").alias("StatusMessage"), F.col("agent_id").alias("AgentId"),
        F.transform("events", lambda e: F.lit("2024-01-01 00:00:00")).alias("Events.Timestamp"), F.transform("events", lambda e: e["name"]).alias("Events.Name"),
        F.transform("events", lambda e: e["attributes"]).alias("Events.Attributes")))
    path = scratch(s, "export")
    broken = sp_.where("span_name = 'team.graph'").select(F.lit("{broken").alias("value")).union(sp_.where("span_name = 'team.graph'").select(F.lit("").alias("value")))
    sp_.select(line.alias("value")).union(broken).write.text(path)
    return path


@query("otel_span_source", "2.1.1", "2.12.6", sql="""
SELECT span_id, session_id, agent_id, span_name, duration, (epoch_us(ts) * 1000 + 789)::BIGINT AS ts_ns, CASE WHEN kind = 'note' THEN 1 ELSE 0 END AS n_events, coalesce(model, '') AS model FROM flat""")
def _(s, d):
    good, _bad = rd.read_export(s, export_lines(s, d))
    out = rd.spans_from_export(good)
    return out.select("span_id", "session_id", "agent_id", "span_name", "duration", "ts_ns", F.size("events").cast("bigint").alias("n_events"),
                      F.coalesce(F.col("attrs").getItem(schema.REQUEST_MODEL), F.lit("")).alias("model"))


@query("metric_document_source", "2.1.3", sql="SELECT CAST(id AS VARCHAR) AS id, session_id, doc_metric AS metric FROM derived")
def _(s, d):
    x = table(s, d, "derived")
    path = scratch(s, "documents")
    named = x.select(F.col("id").cast("string").alias("ID"), F.lit("").alias("SpanId"), F.lit("").alias("TraceId"), F.col("session_id").alias("SessionId"), F.lit("").alias("Timestamp"),
                     F.col("metrics").alias("Metrics"), F.lit("").alias("AppName"), F.col("application_id").alias("AppId"), F.lit("").alias("Scope"), F.col("agent_id"))
    sk.export(named, path, "csv")
    docs = m.metric_documents(rd.read_metric_documents(s, path))
    return docs.select("id", "session_id", "metric")


@query("trajectory_file_source", "2.1.4", "2.1.17", sql="SELECT span_id, session_id FROM flat")
def _(s, d):
    """All spans; those of tools name their session in their attributes only."""
    path = scratch(s, "trajectories")
    own = F.when(~F.col("span_name").endswith(".tool"), F.col("session_id")).alias("SessionId")
    rows = spans(s, d).select(F.col("span_id").alias("SpanId"), F.col("span_name").alias("name"), F.col("ts").cast("string").alias("timestamp"), F.col("attrs").alias("attributes"), own)
    sk.export(rows, path)
    return rd.read_trajectories(s, path).select("span_id", "session_id")


# -- upserts --------------------------------------------------------------------------------


def saved_graph(s, d):
    """The graph saved in two batches: all of it but transitions under other names, then all nodes but sessions w0.

    Both versions go through the store; the sessions of the second batch are replaced.
    """
    nodes, edges = graph(s, d)
    at = scratch(s, "graph")
    first = nodes.where("node_type <> 'Transition'").withColumn("name", F.lit("kept"))
    store = lambda n, e: (sk.save(n, f"{at}/nodes"), sk.save(e, f"{at}/edges"))
    store(*sk.upsert_graph((nodes.limit(0), edges.limit(0)), (first, edges)))
    second = nodes.where("NOT (node_type = 'Session' AND id LIKE '%w0')").withColumn("name", F.when(F.col("node_type") == "Session", "new"))
    stored_ = sk.load(s, f"{at}/nodes"), sk.load(s, f"{at}/edges")
    store(*sk.upsert_graph(stored_, (second, edges.where("edge_type <> 'usesTool'"))))
    return sk.load(s, f"{at}/nodes"), sk.load(s, f"{at}/edges")


@query("graph_upsert_nodes", "2.1.5", sql="""
SELECT node_type, id, CASE WHEN node_type = 'Transition' THEN '' WHEN node_type = 'Session' AND id NOT LIKE '%w0' THEN 'new' ELSE 'kept' END AS name FROM g_nodes""")
def _(s, d):
    return saved_graph(s, d)[0].select("node_type", "id", F.coalesce("name", F.lit("")).alias("name"))


@query("graph_upsert_edges", "2.1.5", sql="""
WITH n AS (SELECT id FROM g_nodes WHERE node_type <> 'Transition'), m AS (SELECT id FROM g_nodes WHERE NOT (node_type = 'Session' AND id LIKE '%w0'))
SELECT edge_type, from_id, to_id FROM g_edges WHERE from_id IN (SELECT id FROM n) AND to_id IN (SELECT id FROM n)
UNION SELECT edge_type, from_id, to_id FROM g_edges WHERE edge_type <> 'usesTool' AND from_id IN (SELECT id FROM m) AND to_id IN (SELECT id FROM m)""")
def _(s, d):
    return saved_graph(s, d)[1]


@query("metric_result_upsert", "2.1.6", sql="""
SELECT 'result:' || substr(sha1(metric || chr(31) || provider || chr(31) || span_id), 1, 12) AS result_id, 'metric:' || substr(sha1(metric || chr(31) || provider), 1, 12) AS metric_id, result + 1 AS result FROM metric_rows""")
def _(s, d):
    rows = table(s, d, "metric_rows").select("metric", "provider", F.col("span_id").alias("resource_id"), "result", "ts")
    old = sk.metric_result_rows(rows)
    return sk.upsert_metric_results(old, rows.withColumn("result", F.col("result") + 1), "ts").select("result_id", "metric_id", "result")


@query("clean_session_metrics", "2.1.7", sql="SELECT result_id FROM metric_rows WHERE session_key NOT IN (SELECT session_key FROM waste WHERE actual_cost = 0)")
def _(s, d):
    return sk.remove(table(s, d, "metric_rows"), table(s, d, "waste").where("actual_cost = 0").select("session_key")).select("result_id")


@query("newest_labels", "2.1.8", sql="""
SELECT session_id, label, labeler FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY updated_at DESC) AS rn FROM label_rows) WHERE rn = 1 AND session_id NOT LIKE '%7'""")
def _(s, d):
    rows = table(s, d, "label_rows")
    return sk.newest_labels(rows, rows.where("session_id LIKE '%7'").select("session_id")).select("session_id", "label", "labeler")


@query("report_upsert_links", "2.1.9", sql="""
SELECT sha256(r.group_id || r.data_type || r.metric) AS report_id, r.group_id FROM reports r JOIN groups g ON g.group_id = r.group_id AND g.hash = r.group_hash""")
def _(s, d):
    return sk.report_rows(table(s, d, "reports"), table(s, d, "groups"))[1]


@query("semantic_group_upsert", "2.1.10", sql="""
SELECT group_id, (SELECT count(DISTINCT session_key) FROM group_sessions l WHERE l.group_id = g.group_id AND (NOT ends_with(g.group_id, '_g1') OR session_key LIKE '%w1')) AS n_links
FROM groups g WHERE NOT ends_with(group_id, '_g0')""")
def _(s, d):
    g = table(s, d, "groups")
    links = table(s, d, "group_sessions").select("group_id", F.col("session_key").alias("target"))
    action = F.when(F.col("group_id").endswith("_g0"), "remove").when(F.col("group_id").endswith("_g1"), "update")
    delta = g.withColumn("action", action).where("action IS NOT NULL")
    new_links = links.where("target LIKE '%w1'")
    out, rest = sk.apply_group_delta(g, links, delta, new_links)
    return out.join(rest.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_links")), "group_id", "left").select("group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


@query("insight_upsert", "2.1.11", sql="""
WITH l AS (SELECT insight_id AS id, session_key AS target, name AS template FROM insights), b AS (SELECT * FROM l WHERE id LIKE '%0'), n AS (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.target = l.target AND b.template = l.template) UNION SELECT * FROM b)
SELECT DISTINCT id FROM n""")
def _(s, d):
    i = table(s, d, "insights").select(F.col("insight_id").alias("id"), F.col("session_key").alias("target"), F.col("name").alias("template"))
    return sk.upsert_insights(i, i, i.where("id LIKE '%0'"))[0].select("id")


@query("embedding_upsert", "2.1.12", sql="SELECT 's' || CAST(vec_id AS VARCHAR) AS state_id, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END AS version FROM vectors")
def _(s, d):
    e = table(s, d, "vectors").select(F.concat(F.lit("s"), F.col("vec_id").cast("string")).alias("state_id"), F.lit("m").alias("model"), "vector", F.lit(0).alias("version"), "vec_id")
    new = e.where("vec_id % 3 = 0").withColumn("version", F.lit(1))
    return sk.upsert_embeddings(e, new).select("state_id", "version")


@query("feature_score_upsert", "2.1.13", sql="SELECT session_key || '_' || quality_target || '_' || CAST(rank AS VARCHAR) || '_' || feature AS id, CASE WHEN rank = 1 THEN 9.0 ELSE score END AS score FROM feature_scores")
def _(s, d):
    f = table(s, d, "feature_scores")
    return sk.upsert_feature_scores(f, f.where("rank = 1").withColumn("score", F.lit(9.0))).select("id", "score")


@query("transition_context_upsert", "2.1.14", sql="SELECT tr AS transition, CASE WHEN kind = 'agent' THEN 'new' ELSE 'old' END AS context FROM g_calls")
def _(s, d):
    c = call_table(s, d)
    old = c.select("transition", F.lit("old").alias("context"))
    return sk.replace_contexts(old, c.where("kind = 'agent'").select("transition", F.lit("new").alias("context")))


@query("concept_upsert", "2.1.14", sql="SELECT DISTINCT session_key AS owner, name, 2 AS version FROM insights UNION SELECT DISTINCT application_id, name, 1 FROM insights")
def _(s, d):
    i = table(s, d, "insights")
    old = i.select(F.col("session_key").alias("owner"), "name", F.lit(1).alias("version")).union(i.select("application_id", "name", F.lit(1))).distinct()
    return sk.merge_concepts(old, i.select(F.col("session_key").alias("owner"), "name", F.lit(2).alias("version")).distinct())


def protocol_tables(s, d):
    f = table(s, d, "flat").where("kind IN ('tool', 'agent', 'graph')").select("session_key", F.concat(F.lit("proto"), (F.col("k") % 3).cast("string")).alias("protocol"), "kind", "k", "ts", "span_id")
    reports = f.where("kind = 'graph'").select("session_key", "protocol", F.when(F.col("k") % 2 == 0, True).otherwise(False).alias("activated"), "ts")
    execs = f.where("kind = 'agent'").select("session_key", "protocol").distinct()
    return f, reports, execs


@query("protocol_report_write", "2.1.15", sql="""
SELECT session_key, protocol, count(*) AS n FROM (SELECT session_key, 'proto' || CAST(k % 3 AS VARCHAR) AS protocol, kind FROM flat) x WHERE kind = 'tool' AND NOT EXISTS (SELECT 1 FROM flat e WHERE e.kind = 'agent' AND e.session_key = x.session_key AND 'proto' || CAST(e.k % 3 AS VARCHAR) = x.protocol) GROUP BY 1, 2""")
def _(s, d):
    f, reports, execs = protocol_tables(s, d)
    res = f.where("kind = 'tool'").select("session_key", "protocol", "span_id")
    one = reports.groupBy("session_key").agg(F.max("protocol").alias("protocol"))
    _, _, left = sk.write_protocol_reports(one, execs, res, one, execs, res.limit(0))
    return left.groupBy("session_key", "protocol").agg(F.count(F.lit(1)).alias("n"))


@query("group_removal", "2.1.16", sql="SELECT group_id, report_id FROM reports WHERE group_id NOT LIKE '%g2'")
def _(s, d):
    g = table(s, d, "groups")
    links = table(s, d, "group_edges").select(F.col("parent_id").alias("group_id"), F.col("child_id").alias("target"))
    return sk.remove_groups(g, links, table(s, d, "reports"), g.where("group_id LIKE '%g2'"))[2].select("group_id", "report_id")


@query("failure_report_write", "2.8.13", sql="SELECT DISTINCT sha256(session_key || '|' || status_message || '|' || span_id) AS id FROM flat WHERE status_message <> ''")
def _(s, d):
    f = table(s, d, "flat").where("status_message <> ''").select("session_key", F.col("status_message").alias("code"), F.col("span_id").alias("call"), F.lit(0.5).alias("confidence"))
    return sk.upsert_failure_reports(f, f.withColumn("confidence", F.lit(0.9))).select("id")


@query("symbolic_model_upsert", "2.8.18", sql="SELECT DISTINCT application_id || '_v' || CAST(v AS VARCHAR) AS model_id, v = 2 AS active FROM flat, (SELECT unnest([1, 2]) AS v)")
def _(s, d):
    apps = table(s, d, "flat").select("application_id").distinct()
    model = lambda v: apps.select(F.concat("application_id", F.lit(f"_v{v}")).alias("model_id"), "application_id", F.lit(True).alias("active"))
    var = lambda v: model(v).select("model_id", F.lit("x").alias("variable"), F.lit(v).alias("version"))
    dep = lambda v: model(v).select("model_id", F.lit("x").alias("variable"), F.lit("y").alias("depends_on"))
    return sk.activate_model(model(1), var(1), dep(1), (model(2), var(2), dep(2)))[0].select("model_id", "active")


# -- protocol and cognition reads ------------------------------------------------------------


@query("protocol_reports", "2.4.48", sql="""
WITH r AS (SELECT session_key, 'proto' || CAST(k % 3 AS VARCHAR) AS protocol, k % 2 = 0 AS act, ts, span_id FROM flat WHERE kind = 'graph'), l AS (SELECT session_key, protocol, arg_max(act, struct_pack(t := ts, s := span_id)) AS act FROM r GROUP BY 1, 2),
 e AS (SELECT DISTINCT session_key, 'proto' || CAST(k % 3 AS VARCHAR) AS protocol FROM flat WHERE kind = 'agent')
SELECT coalesce(l.session_key, e.session_key) AS session_key, coalesce(l.protocol, e.protocol) AS protocol, coalesce(l.act, FALSE) OR e.protocol IS NOT NULL AS activated FROM l FULL JOIN e ON l.session_key = e.session_key AND l.protocol = e.protocol""")
def _(s, d):
    f, _, execs = protocol_tables(s, d)
    latest = f.where("kind = 'graph'").groupBy("session_key", "protocol").agg(F.max_by(F.col("k") % 2 == 0, F.struct("ts", "span_id")).alias("act"))
    both = latest.join(execs.withColumn("ran", F.lit(True)), ["session_key", "protocol"], "full_outer")
    return both.select("session_key", "protocol", (F.coalesce("act", F.lit(False)) | F.coalesce("ran", F.lit(False))).alias("activated"))


@query("cognitive_session_rows", "2.4.49", sql="""
SELECT b.session_key, coalesce(c.cost, 0) AS cost, coalesce(q.n, 0) AS n_metrics, coalesce(f.n, 0) AS n_failures FROM (SELECT DISTINCT session_key FROM flat) b LEFT JOIN (SELECT session_key, round(sum(result), 4) AS cost FROM metric_rows WHERE metric = 'Cost' GROUP BY 1) c USING (session_key)
LEFT JOIN (SELECT session_key, count(DISTINCT metric) AS n FROM metric_rows GROUP BY 1) q USING (session_key) LEFT JOIN (SELECT session_key, count(*) AS n FROM flat WHERE status_message <> '' GROUP BY 1) f USING (session_key)""")
def _(s, d):
    f, r = table(s, d, "flat"), table(s, d, "metric_rows")
    cost = r.where("metric = 'Cost'").groupBy("session_key").agg(F.round(F.sum("result"), 4).alias("cost"))
    n = r.groupBy("session_key").agg(F.count_distinct("metric").alias("n_metrics"))
    bad = f.where("status_message <> ''").groupBy("session_key").agg(F.count(F.lit(1)).alias("n_failures"))
    return m.collect_page([cost, n, bad], f.select("session_key").distinct()).na.fill(0)


# -- scalar surface -------------------------------------------------------------------------


@query("attribute_texts", "2.12.3", sql="SELECT span_id, session_id AS a, coalesce(entity_name, '') AS b, 'x, y' AS c, agent_id AS e FROM flat")
def _(s, d):
    f = table(s, d, "flat")
    q = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    raw = F.concat(F.lit("{'a':"), q(F.col("session_id")), F.lit(",'b':"), q(F.coalesce("entity_name", F.lit(""))), F.lit("}"))
    events = F.concat(F.lit("{'{c=x, y, e="), "agent_id", F.lit("}', '{z=1}'}"))
    out = f.select("span_id", rd.parse_attributes(raw).alias("m"), rd.parse_event_maps(events).alias("ev"))
    ev = F.col("ev")[0]
    return out.select("span_id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"), ev["c"].alias("c"), ev["e"].alias("e"))


@query("span_attribute_views", "2.12.4", sql="""
SELECT span_id, coalesce(in_text, '') AS input, coalesce(out_text, '') AS output, coalesce(CAST(input_tokens AS BIGINT), 0) AS input_tokens, round(coalesce(CAST(input_tokens AS BIGINT), 0) * 2.5e-6, 8) AS input_cost FROM flat""")
def _(s, d):
    out = spans(s, d).select("span_id", rd.span_view(F.col("attrs"), F.col("status_code"), F.col("events")).alias("v"))
    return out.select("span_id", "v.input", "v.output", "v.input_tokens", F.round("v.input_cost", 8).alias("input_cost"))


@query("flattened_messages", "2.12.5", sql="SELECT conv_id, turn, 'system:rules|' || role || ':' || text AS messages FROM conversations WHERE text <> ''")
def _(s, d):
    c = table(s, d, "conversations").where("text <> ''")
    attrs = F.create_map(F.lit("p.10.role"), F.upper("role"), F.lit("p.10.content"), F.col("text"), F.lit("p.2.role"), F.lit(" System "), F.lit("p.2.content"), F.lit("rules"), F.lit("p.3.role"), F.lit("user"))
    made = c.withColumn("a", attrs).withColumn("m", rd.flattened_messages(F.col("a"), "p"))
    return made.select("conv_id", "turn", F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["role"], x["content"])), "|").alias("messages"))


@query("folded_texts", "2.12.7", sql="SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS folded FROM benchmark")
def _(s, d):
    return table(s, d, "benchmark").select("item_id", fold_text("text").alias("folded"))


@query("vector_measures", "2.12.8", sql=f"""
SELECT v.session_key, round({COS.format(a='v.vector', b='c.c')}, 6) AS cosine, round(list_distance(CAST(v.vector AS DOUBLE[]), c.c), 6) AS l2, round(sqrt(list_dot_product(CAST(v.vector AS DOUBLE[]), CAST(v.vector AS DOUBLE[]))), 6) AS len FROM vectors v JOIN centroids c USING (group_id)""")
def _(s, d):
    from spanloom.functions.vectors import mean_vector

    v = table(s, d, "vectors")
    j = v.join(mean_vector(v, ["group_id"], "vector"), "group_id")
    a, b = F.col("vector"), F.col("centroid")
    return j.select("session_key", r6(cosine_distance(a, b)).alias("cosine"), r6(euclidean(a, b)).alias("l2"), r6(norm(a)).alias("len"))
