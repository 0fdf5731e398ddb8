"""Traversal, validation and comparison queries over the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom import schema
from spanloom.operators import graph_check as gc
from spanloom.operators import spans as span_ops
from spanloom.operators import traverse as tv
from spanloom.functions.scalar import session_key, sorted_text
from spanloom.functions.vectors import mean_vector
from spanloom.plans.graph_tables import graph
from spanloom.plans.registry import query
from spanloom.sources.fixtures import oracle_define, spans, table

E = lambda kind: f"(SELECT from_id, to_id FROM g_edges WHERE edge_type = '{kind}')"
COS = "(1 - list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / (sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) * sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[])))))"


@query("graph_hop", "2.3.2", sql=f"""
SELECT a.from_id AS mas_call, a.to_id AS "hasAgentCall", t.to_id AS "hasToolCall", x.to_id AS "executesTool"
FROM {E('hasAgentCall')} a JOIN {E('hasToolCall')} t ON t.from_id = a.to_id JOIN {E('executesTool')} x ON x.from_id = t.to_id""")
def _(s, d):
    nodes, edges = graph(s, d)
    start = tv.of_type(nodes, "MASCall").select(F.col("id").alias("mas_call"))
    return tv.walk(start, edges, ["hasAgentCall", "hasToolCall", "executesTool"], "mas_call")


@query("optional_hop", "2.3.3", sql=f"""
SELECT a.to_id AS call, coalesce(t.to_id, '') AS tool_call FROM {E('hasAgentCall')} a LEFT JOIN {E('hasToolCall')} t ON t.from_id = a.to_id""")
def _(s, d):
    _, edges = graph(s, d)
    calls = tv.agent_calls_of_sessions(edges).select("call")
    return tv.hop(calls, edges, "hasToolCall", "call", "tool_call", "left").na.fill("", ["tool_call"])


@query("session_calls", "2.3.4", sql=f"""
WITH ac AS (SELECT m.from_id AS session, a.to_id AS call FROM {E('hasMASCall')} m JOIN {E('hasAgentCall')} a ON a.from_id = m.to_id),
 pc AS (SELECT session, call FROM ac UNION ALL SELECT from_id, to_id FROM {E('hasMASCall')}),
 u AS (SELECT session, 'agent' AS kind, call AS id FROM ac
  UNION SELECT session, 'llm', e.to_id FROM ac JOIN {E('hasLLMCall')} e ON e.from_id = call
  UNION SELECT session, 'tool', e.to_id FROM ac JOIN {E('hasToolCall')} e ON e.from_id = call
  UNION SELECT session, 'processing', e.to_id FROM pc JOIN {E('hasProcessingCall')} e ON e.from_id = call)
SELECT s.session, count(*) FILTER (kind = 'agent') AS n_agent, count(*) FILTER (kind = 'llm') AS n_llm,
 count(*) FILTER (kind = 'tool') AS n_tool, count(*) FILTER (kind = 'processing') AS n_processing
FROM (SELECT DISTINCT from_id AS session FROM {E('executesSession')}) s LEFT JOIN u USING (session) GROUP BY 1""")
def _(s, d):
    return tv.session_calls(graph(s, d)[1])


@query("enriched_calls", "2.3.5", sql="""
SELECT call_id AS call, target, CASE WHEN in_text = '' THEN '(no content recorded)' ELSE in_text END AS input,
 CASE WHEN out_text = '' THEN '(no content recorded)' ELSE out_text END AS output, CASE WHEN kind = 'llm' THEN provider ELSE '' END AS provider,
 CASE WHEN kind = 'llm' THEN model WHEN kind = 'tool' THEN entity ELSE '' END AS name FROM g_calls""")
def _(s, d):
    out = tv.enriched_calls(*graph(s, d))
    named = F.when(F.col("node_type") != "AgentCall", F.col("name")).otherwise(F.lit(""))
    return out.select("call", "target", "input", "output", F.coalesce("provider", F.lit("")).alias("provider"), named.alias("name"))


@query("session_texts", "2.3.6", sql="""
SELECT n.id AS session, coalesce(a.content, '') AS input, coalesce(b.content, '') AS output FROM g_nodes n LEFT JOIN g_box x ON x.owner = n.id
LEFT JOIN (SELECT id, content FROM g_nodes WHERE node_type = 'State') a ON a.id = x.s0
LEFT JOIN (SELECT id, content FROM g_nodes WHERE node_type = 'State') b ON b.id = x.s1 WHERE n.node_type = 'Session'""")
def _(s, d):
    return tv.session_texts(*graph(s, d)).select("session", F.coalesce("input", F.lit("")).alias("input"), F.coalesce("output", F.lit("")).alias("output"))


TEXT_VECTOR = "CASE content WHEN 't0' THEN 0 WHEN 't1' THEN 1 WHEN 't2' THEN 2 WHEN 't3' THEN 3 ELSE 4 END"


def state_embeddings(s, d):
    """One embedding per state: equal texts have equal vectors."""
    nodes, _ = graph(s, d)
    states = tv.of_type(nodes, "State").select(F.col("id").alias("state_id"), F.expr(TEXT_VECTOR).alias("vec_id"))
    vectors = table(s, d, "vectors").select(F.col("vec_id").cast("int").alias("vec_id"), "vector")
    return states.join(vectors, "vec_id").select("state_id", F.lit("m0").alias("model"), "vector")


@query("session_vectors", "2.3.7", sql=f"""
SELECT x.owner AS session, round(va.vector[1], 6) AS in_first, round(vb.vector[64], 6) AS out_last FROM g_box x
JOIN (SELECT id, {TEXT_VECTOR} AS v FROM g_nodes WHERE node_type = 'State') a ON a.id = x.s0 JOIN vectors va ON va.vec_id = a.v
JOIN (SELECT id, {TEXT_VECTOR} AS v FROM g_nodes WHERE node_type = 'State') b ON b.id = x.s1 JOIN vectors vb ON vb.vec_id = b.v
WHERE x.owner NOT LIKE 'mascall:%'""")
def _(s, d):
    nodes, edges = graph(s, d)
    out = tv.session_vectors(tv.session_texts(nodes, edges), state_embeddings(s, d), "m0").where("initial_id IS NOT NULL")
    return out.select("session", F.round(F.get("input_vector", 0).cast("double"), 6).alias("in_first"),
                      F.round(F.get("output_vector", 63).cast("double"), 6).alias("out_last"))


@query("session_of_element", "2.3.8", sql="SELECT DISTINCT id, session_id FROM g_nodes WHERE session_id IS NOT NULL AND node_type <> 'Session'")
def _(s, d):
    nodes, _ = graph(s, d)
    return tv.session_of(nodes, nodes.where("node_type <> 'Session'").select("id").distinct()).select("id", "session_id")


@query("agent_call_sequence", "2.3.9", sql="""
SELECT session, call_id AS call, agent, row_number() OVER (PARTITION BY session ORDER BY t0, span_id) AS pos FROM g_calls WHERE kind = 'agent'""")
def _(s, d):
    return tv.call_sequence(*graph(s, d)).select("session", "call", "agent", "pos")


@query("graph_session_list", "2.3.10", sql="""
SELECT session, round(c0, 6) AS start_time, round(greatest(0.0, (coalesce(e1, c0) - c0) * 1000), 3) AS duration FROM g_sessions""")
def _(s, d):
    return tv.sessions_between(graph(s, d)[0]).select("session", F.round("start_time", 6).alias("start_time"), F.round("duration", 3).alias("duration"))


@query("graph_sessions_in_interval", "2.3.10", sql="""
SELECT session, round(c0, 6) AS start_time FROM g_sessions WHERE c0 >= 1704412800 AND c0 <= 1705276800""")
def _(s, d):
    return tv.sessions_between(graph(s, d)[0], 1704412800.0, 1705276800.0).select("session", F.round("start_time", 6).alias("start_time"))


@query("sessions_having_agent", "2.3.11", sql="""
SELECT m.session_key, round(sum(result), 4) AS total FROM metric_rows m WHERE EXISTS (SELECT 1 FROM g_calls c WHERE c.kind = 'agent' AND c.session = m.session_key AND c.agent = 'agent2.invoke') GROUP BY 1""")
def _(s, d):
    who = tv.sessions_with_agent(*graph(s, d)).where("agent = 'agent2.invoke'").select(F.col("session").alias("session_key"))
    return table(s, d, "metric_rows").join(who, "session_key", "left_semi").groupBy("session_key").agg(F.round(F.sum("result"), 4).alias("total"))


@query("leaf_groups", "2.3.12", sql="SELECT group_id FROM groups g WHERE NOT EXISTS (SELECT 1 FROM group_edges e WHERE e.parent_id = g.group_id)")
def _(s, d):
    return tv.leaf_groups(table(s, d, "groups"), table(s, d, "group_edges")).select("group_id")


@query("group_members", "2.3.13", "2.9.5", sql="""
WITH RECURSIVE t(group_id, node) AS (SELECT group_id, group_id FROM groups UNION SELECT t.group_id, e.child_id FROM t JOIN group_edges e ON e.parent_id = t.node)
SELECT DISTINCT t.group_id, gs.session_key FROM t JOIN group_sessions gs ON gs.group_id = t.node""")
def _(s, d):
    return tv.group_members(table(s, d, "group_edges"), table(s, d, "group_sessions"))


oracle_define("centroids", """
SELECT group_id, list(m ORDER BY i) AS c FROM (SELECT group_id, i, avg(CAST(vector[i] AS DOUBLE)) AS m FROM vectors, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2) GROUP BY 1""")


@query("neighbours_of_centroids", "2.3.14", sql=f"""
SELECT session_key, ref_id, round(distance, 6) AS distance, rank FROM (SELECT v.session_key, c.group_id AS ref_id, {COS.format(a='v.vector', b='c.c')} AS distance,
 row_number() OVER (PARTITION BY c.group_id ORDER BY {COS.format(a='v.vector', b='c.c')}, v.session_key) AS rank FROM vectors v, centroids c) WHERE distance <= 1.0 AND rank <= 10""")
def _(s, d):
    v = table(s, d, "vectors")
    refs = mean_vector(v, ["group_id"], "vector").select(F.col("group_id").alias("ref_id"), F.col("centroid").alias("vector"))
    out = tv.within_radius(v, refs, 1.0, 10)
    return out.select("session_key", "ref_id", F.round("distance", 6).alias("distance"), "rank")


@query("neighbour_metrics", "2.3.14", sql=f"""
SELECT n.session_key, ref_id, round(distance, 6) AS distance, rank, metric, round(avg(result), 6) AS value FROM (SELECT v.session_key, c.group_id AS ref_id, {COS.format(a='v.vector', b='c.c')} AS distance,
 row_number() OVER (PARTITION BY c.group_id ORDER BY {COS.format(a='v.vector', b='c.c')}, v.session_key) AS rank FROM vectors v, centroids c) n LEFT JOIN metric_rows m ON n.session_key = 'v' || regexp_extract(m.session_key, 's(\\d+)w', 1)
WHERE distance <= 1.0 AND rank <= 10 GROUP BY ALL""")
def _(s, d):
    v = table(s, d, "vectors")
    refs = mean_vector(v, ["group_id"], "vector").select(F.col("group_id").alias("ref_id"), F.col("centroid").alias("vector"))
    near = tv.within_radius(v, refs, 1.0, 10).select("session_key", "ref_id", F.round("distance", 6).alias("distance"), "rank")
    # the vectors of these tables stand for the sessions of the user of their number
    user = F.concat(F.lit("v"), F.regexp_extract("session_key", r"s(\d+)w", 1))
    rows = near.join(table(s, d, "metric_rows").select(user.alias("session_key"), "metric", "result"), "session_key", "left")
    return rows.groupBy("session_key", "ref_id", "distance", "rank", "metric").agg(F.round(F.avg("result"), 6).alias("value"))


@query("nearest_centroid", "2.3.15", sql=f"""
SELECT session_key, group_id AS ref_id, round(dd, 6) AS distance FROM (SELECT v.session_key, c.group_id, {COS.format(a='v.vector', b='c.c')} AS dd,
 row_number() OVER (PARTITION BY v.session_key ORDER BY {COS.format(a='v.vector', b='c.c')}, c.group_id) AS rn
 FROM vectors v JOIN centroids c ON CAST(substr(c.group_id, 2) AS INT) % 2 = v.vec_id % 2) WHERE rn = 1 AND dd <= 0.95""")
def _(s, d):
    v = table(s, d, "vectors").withColumn("application_id", F.col("vec_id") % 2)
    refs = mean_vector(v, ["group_id"], "vector").select(
        F.col("group_id").alias("ref_id"), F.col("centroid").alias("vector"), (F.substring("group_id", 2, 9).cast("bigint") % 2).alias("application_id"))
    return tv.nearest_reference(v, refs, 0.95).select("session_key", "ref_id", F.round("distance", 6).alias("distance"))


@query("metrics_on_normalised_sessions", "2.3.17", sql="""
SELECT s.session_id, count(*) AS n FROM (SELECT DISTINCT session_id, session_key FROM flat) s JOIN derived d ON d.session_key = s.session_key GROUP BY 1""")
def _(s, d):
    docs = table(s, d, "derived").select(session_key(F.col("session_id"), F.col("application_id")).alias("key"))
    sess = spans(s, d).select("session_id", "application_id").distinct().withColumn("key", session_key(F.col("session_id"), F.col("application_id")))
    # Documents are counted per key first: a hot session joins as one row.
    return sess.join(docs.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key").select("session_id", "n")


@query("session_and_call_results", "2.3.18", sql="""
SELECT session_key, metric, ts, result FROM metric_rows WHERE provider = 'Native' UNION
SELECT session_key, metric, ts, result FROM metric_rows WHERE agent = 'agent1'""")
def _(s, d):
    m = table(s, d, "metric_rows")
    cols = ["session_key", "metric", "ts", "result"]
    return tv.distinct_union(m.where("provider = 'Native'").select(*cols), m.where("agent = 'agent1'").select(*cols)).orderBy("metric", "ts")


@query("agent_tool_map", "2.2.35", sql="""
SELECT a.application, a.agent, coalesce(string_agg(DISTINCT o.entity, ',' ORDER BY o.entity), '') AS tools FROM (SELECT DISTINCT application, agent FROM g_calls WHERE kind = 'agent') a
LEFT JOIN (SELECT p.application, p.agent, c.entity FROM g_owned c JOIN g_calls p ON p.call_id = c.o_call WHERE c.kind = 'tool') o ON o.application = a.application AND o.agent = a.agent GROUP BY 1, 2""")
def _(s, d):
    _, edges = graph(s, d)
    calls = tv.hop(tv.agent_calls_of_sessions(edges), edges, "executesSession", "session", "application")
    calls = tv.hop(calls, edges, "executesAgent", "call", "agent").select("application", "agent", "call")
    used = tv.hop(tv.hop(calls, edges, "hasToolCall", "call", "tool_call"), edges, "executesTool", "tool_call", "tool")
    used = used.select("application", "agent", "tool").distinct()
    return calls.select("application", "agent").distinct().join(used, ["application", "agent"], "left").groupBy(
        "application", "agent").agg(sorted_text(F.collect_set("tool")).alias("tools"))


# -- checks: a candidate graph with known faults ---------------------------------------------

oracle_define("c_nodes", """
SELECT CASE id WHEN 'tool3' THEN 'Widget' WHEN 'tool4' THEN '' WHEN 'agent1.invoke' THEN 'ExecutionElement' ELSE node_type END AS node_type, id, session_id FROM g_nodes
WHERE node_type NOT IN ('LLM') AND NOT (node_type = 'State' AND id LIKE '%0')""")
oracle_define("c_edges", """
SELECT CASE WHEN edge_type = 'usesTool' AND to_id = 'tool1' THEN 'likesTool' WHEN edge_type = 'usesTool' AND to_id = 'tool2' THEN '' ELSE edge_type END AS edge_type, from_id, to_id FROM g_edges
WHERE edge_type <> 'hasFinalState' OR from_id NOT LIKE '%a' UNION ALL SELECT 'hasAgentCall', from_id, from_id FROM g_edges WHERE edge_type = 'executesSession'
UNION ALL SELECT 'executesAgent', from_id, to_id FROM g_edges WHERE edge_type = 'executesMAS'""")


def candidate(s, d):
    nodes, edges = graph(s, d)
    kind = F.when(F.col("id") == "tool3", "Widget").when(F.col("id") == "tool4", "").when(
        F.col("id") == "agent1.invoke", "ExecutionElement").otherwise(F.col("node_type"))
    cn = nodes.where("node_type <> 'LLM' AND NOT (node_type = 'State' AND id LIKE '%0')").withColumn("node_type", kind)
    uses = F.col("edge_type") == "usesTool"
    et = F.when(uses & (F.col("to_id") == "tool1"), "likesTool").when(uses & (F.col("to_id") == "tool2"), "").otherwise(F.col("edge_type"))
    ce = edges.where("edge_type <> 'hasFinalState' OR from_id NOT LIKE '%a'").withColumn("edge_type", et)
    ce = ce.unionByName(edges.where("edge_type = 'executesSession'").select(F.lit("hasAgentCall").alias("edge_type"), "from_id", F.col("from_id").alias("to_id")))
    return cn, ce.unionByName(edges.where("edge_type = 'executesMAS'").withColumn("edge_type", F.lit("executesAgent")))


CLASS_SQL = schema.values_sql([(c, a) for c in schema.CLASSES for a in schema.ancestors_of(c)], "node_type, ancestor")
PROP_SQL = {side: schema.values_sql([(p[0], a) for p in schema.PROPERTIES for a in p[i]], "edge_type, allowed") for side, i in (("domain", 1), ("range", 2))}


@query("unknown_types", "2.6.1", sql=f"""
SELECT 'node ' || status AS status, item FROM (SELECT 'missing' AS status, id AS item FROM c_nodes WHERE node_type = ''
 UNION ALL SELECT DISTINCT 'spurious', node_type FROM c_nodes WHERE node_type <> '' AND node_type NOT IN (SELECT node_type FROM {CLASS_SQL} z))
UNION ALL SELECT 'edge ' || status, item FROM (SELECT 'missing' AS status, from_id || '->' || to_id AS item FROM c_edges WHERE edge_type = ''
 UNION ALL SELECT DISTINCT 'spurious', edge_type FROM c_edges WHERE edge_type <> '' AND edge_type NOT IN (SELECT edge_type FROM {PROP_SQL['domain']} z))""")
def _(s, d):
    cn, ce = candidate(s, d)
    n = gc.unknown_node_types(cn).withColumn("status", F.concat(F.lit("node "), "status"))
    return n.unionByName(gc.unknown_edge_types(ce).withColumn("status", F.concat(F.lit("edge "), "status")))


@query("domain_range_violations", "2.6.2", sql="\nUNION ALL\n".join(f"""
SELECT '{side}_mismatch' AS status, e.edge_type, e.{end} AS id, n.node_type FROM c_edges e JOIN (SELECT id, max(node_type) AS node_type FROM c_nodes GROUP BY 1) n ON n.id = e.{end}
WHERE e.edge_type IN (SELECT edge_type FROM {PROP_SQL[side]} z) AND NOT EXISTS (SELECT 1 FROM {PROP_SQL[side]} r JOIN {CLASS_SQL} a ON a.ancestor = r.allowed WHERE r.edge_type = e.edge_type AND a.node_type = n.node_type)""" for side, end in (("domain", "from_id"), ("range", "to_id"))))
def _(s, d):
    return gc.domain_range_violations(*candidate(s, d))


@query("orphaned_edges", "2.6.3", sql="""
SELECT 'orphaned_from' AS status, edge_type, from_id, to_id FROM c_edges WHERE from_id <> '' AND from_id NOT IN (SELECT id FROM c_nodes)
UNION ALL SELECT 'orphaned_to', edge_type, from_id, to_id FROM c_edges WHERE to_id <> '' AND to_id NOT IN (SELECT id FROM c_nodes)""")
def _(s, d):
    return gc.orphaned_edges(*candidate(s, d))


@query("shape_violations", "2.6.4", sql="""
SELECT id, 'abstract' AS rule FROM c_nodes WHERE node_type = 'ExecutionElement'
UNION ALL SELECT e.from_id, 'unshared ' || e.edge_type FROM c_edges e JOIN c_nodes n ON n.id = e.from_id AND n.node_type = 'Session'
WHERE e.edge_type IN ('hasInitialState', 'hasFinalState') AND NOT EXISTS (SELECT 1 FROM c_edges o WHERE o.edge_type = e.edge_type AND o.to_id = e.to_id AND o.from_id <> e.from_id)""")
def _(s, d):
    cn, ce = candidate(s, d)
    return gc.abstract_instances(cn).unionByName(gc.unshared_boundaries(cn, ce))


@query("cardinality_violations", "2.6.5", sql=f"""
SELECT n.id, n.node_type, r.edge_type, count(e.to_id) AS n FROM (SELECT DISTINCT id, node_type FROM c_nodes) n JOIN {CLASS_SQL} a ON a.node_type = n.node_type
JOIN {schema.values_sql([(c[0], c[1], c[2]) for c in schema.CARDINALITY], 'cls, edge_type, lo')} r ON r.cls = a.ancestor
LEFT JOIN c_edges e ON e.from_id = n.id AND e.edge_type = r.edge_type GROUP BY 1, 2, 3, r.lo HAVING count(e.to_id) < r.lo""")
def _(s, d):
    return gc.cardinality_violations(*candidate(s, d))


@query("coverage_gaps", "2.6.6", sql="""
SELECT 'Agent' AS kind, r.id AS item, 'missing' AS status FROM g_nodes r WHERE node_type = 'Agent' AND id NOT IN (SELECT id FROM c_nodes WHERE node_type = 'Agent')
UNION ALL SELECT 'Tool', r.id, 'missing' FROM g_nodes r WHERE node_type = 'Tool' AND id NOT IN (SELECT id FROM c_nodes WHERE node_type = 'Tool')""")
def _(s, d):
    cn, _ = candidate(s, d)
    rn, _ = graph(s, d)
    a = gc.coverage(cn, rn, "Agent", "id").withColumn("kind", F.lit("Agent"))
    return a.unionByName(gc.coverage(cn, rn, "Tool", "name").withColumn("kind", F.lit("Tool")))


@query("type_distributions", "2.6.7", sql="""
SELECT 'node' AS what, coalesce(r.k, c.k) AS kind, coalesce(rn, 0) AS n_reference, coalesce(cn, 0) AS n_candidate, greatest(0, coalesce(rn, 0) - coalesce(cn, 0)) AS deficit
FROM (SELECT node_type AS k, count(*) AS rn FROM g_nodes GROUP BY 1) r FULL JOIN (SELECT node_type AS k, count(*) AS cn FROM c_nodes GROUP BY 1) c ON r.k = c.k
UNION ALL SELECT 'edge', coalesce(r.k, c.k), coalesce(rn, 0), coalesce(cn, 0), greatest(0, coalesce(rn, 0) - coalesce(cn, 0))
FROM (SELECT edge_type AS k, count(*) AS rn FROM g_edges GROUP BY 1) r FULL JOIN (SELECT edge_type AS k, count(*) AS cn FROM c_edges GROUP BY 1) c ON r.k = c.k""")
def _(s, d):
    (cn, ce), (rn, re_) = candidate(s, d), graph(s, d)
    n = gc.distribution_deficits(cn, rn, "node_type").withColumn("what", F.lit("node"))
    return n.unionByName(gc.distribution_deficits(ce, re_, "edge_type").withColumn("what", F.lit("edge")))


CONTAIN = ", ".join(f"'{c}'" for c in schema.CONTAINMENT)


@query("nesting_depth", "2.6.8", sql=f"""
WITH RECURSIVE e AS (SELECT from_id, to_id FROM g_edges WHERE edge_type IN ({CONTAIN})),
 t(id, depth) AS (SELECT from_id, 0 FROM e WHERE from_id NOT IN (SELECT to_id FROM e) UNION SELECT e.to_id, t.depth + 1 FROM t JOIN e ON e.from_id = t.id)
SELECT CAST(max(depth) AS BIGINT) AS depth FROM t""")
def _(s, d):
    return gc.nesting_depth(*graph(s, d))


@query("delegation_missing", "2.6.9", sql="""
SELECT from_id, to_id FROM c_edges WHERE edge_type = 'executesAgent' AND from_id <> to_id EXCEPT SELECT from_id, to_id FROM g_edges WHERE edge_type = 'executesAgent'""")
def _(s, d):
    return gc.delegation_missing(graph(s, d)[1], candidate(s, d)[1])


@query("element_diff", "2.6.10", sql="""
WITH r AS (SELECT 'node' AS what, node_type || '|' || id AS item FROM g_nodes UNION ALL SELECT 'edge', edge_type || '|' || from_id || '|' || to_id FROM g_edges),
 c AS (SELECT 'node' AS what, node_type || '|' || id AS item FROM c_nodes UNION ALL SELECT 'edge', edge_type || '|' || from_id || '|' || to_id FROM c_edges)
SELECT DISTINCT what, item, 'missing' AS status FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM c) UNION ALL SELECT DISTINCT what, item, 'spurious' FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM r)""")
def _(s, d):
    return gc.element_diff(candidate(s, d), graph(s, d))


@query("comparison_verdict", "2.6.11", sql=f"""
WITH RECURSIVE ce AS (SELECT from_id, to_id FROM c_edges WHERE edge_type IN ({CONTAIN}) AND from_id <> to_id AND from_id IN (SELECT id FROM c_nodes) AND to_id IN (SELECT id FROM c_nodes)),
 re AS (SELECT from_id, to_id FROM g_edges WHERE edge_type IN ({CONTAIN})),
 tc(id, depth) AS (SELECT from_id, 0 FROM ce UNION SELECT e.to_id, t.depth + 1 FROM tc t JOIN ce e ON e.from_id = t.id),
 tr(id, depth) AS (SELECT from_id, 0 FROM re UNION SELECT e.to_id, t.depth + 1 FROM tr t JOIN re e ON e.from_id = t.id),
 v AS (SELECT 'agent_coverage' AS "check", NOT EXISTS (SELECT id FROM g_nodes WHERE node_type = 'Agent' EXCEPT SELECT id FROM c_nodes WHERE node_type = 'Agent') AS passed
 UNION ALL SELECT 'tool_coverage', NOT EXISTS (SELECT id FROM g_nodes WHERE node_type = 'Tool' EXCEPT SELECT id FROM c_nodes WHERE node_type = 'Tool')
 UNION ALL SELECT 'node_distribution', NOT EXISTS (SELECT node_type FROM g_nodes EXCEPT ALL SELECT node_type FROM c_nodes)
 UNION ALL SELECT 'edge_distribution', NOT EXISTS (SELECT edge_type FROM g_edges EXCEPT ALL SELECT edge_type FROM c_edges)
 UNION ALL SELECT 'call_depth', (SELECT max(depth) FROM tc) >= (SELECT max(depth) FROM tr)
 UNION ALL SELECT 'delegation_topology', NOT EXISTS (SELECT from_id, to_id FROM g_edges WHERE edge_type = 'executesAgent' EXCEPT SELECT from_id, to_id FROM c_edges WHERE edge_type = 'executesAgent')
 UNION ALL SELECT 'element_level_diff', NOT EXISTS (SELECT node_type, id FROM g_nodes EXCEPT ALL SELECT node_type, id FROM c_nodes) AND NOT EXISTS (SELECT node_type, id FROM c_nodes EXCEPT ALL SELECT node_type, id FROM g_nodes))
SELECT * FROM v UNION ALL SELECT 'overall', bool_and(passed) FROM v WHERE "check" <> 'element_level_diff'""")
def _(s, d):
    return gc.verdict(candidate(s, d), graph(s, d))
