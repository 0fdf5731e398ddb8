"""Live queries: batch forms, and the same functions run as streams over the given files."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.vectors import mean_vector
from spanloom.operators import groups as gr
from spanloom.plans.registry import query
from spanloom.sources.fixtures import DEFINITIONS, _SPARK, oracle_define, spans, stored, table
from spanloom.streaming import jobs


def as_stream(s, d, name, files=None):
    """A fixture over events as a stream of the events file."""
    events = jobs.stream_files(s, d, "events.parquet", table(s, d, "events").schema, files)
    return s.sql(DEFINITIONS[name].format(**_SPARK).replace("FROM events e0", "FROM {e} e0"), e=events)


STATUS = """SELECT session_key, min(ts) AS start_time, count(*) FILTER (event_name = 'topology.session.completed') AS n_completed, coalesce(CAST(min(ts) FILTER (event_name = 'topology.session.completed') AS VARCHAR), '') AS end_time,
 CASE WHEN count(*) FILTER (event_name = 'topology.session.completed') > 0 THEN 'completed' ELSE 'active' END AS status FROM topology WHERE event_name IN ('topology.session.started', 'topology.session.completed') GROUP BY 1"""


def texts(df, *cols):
    """Nullable times as text, so that both engines show them alike."""
    shown = lambda c: F.coalesce(F.regexp_replace(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", ""), F.lit(""))
    return df.withColumns({c: shown(c) for c in cols})


def sql_text(expr):
    return f"coalesce(regexp_replace(strftime({expr}, '%Y-%m-%d %H:%M:%S.%f'), '\\.?0+$', ''), '')"


STATUS = STATUS.replace("coalesce(CAST(min(ts) FILTER (event_name = 'topology.session.completed') AS VARCHAR), '')", sql_text("min(ts) FILTER (event_name = 'topology.session.completed')"))


@query("session_status", "2.11.2", sql=STATUS)
def _(s, d):
    return texts(jobs.session_status(table(s, d, "topology")), "end_time")


@query("session_status_stream", "2.11.2", sql=STATUS)
def _(s, d):
    return texts(jobs.run_available(jobs.session_status(as_stream(s, d, "topology")), "update", keys=["session_key"]), "end_time")


ORPHANS = """SELECT session_key, max(ts) AS last_activity, count(*) FILTER (event_name = 'topology.session.started') AS n_started FROM topology GROUP BY 1
HAVING count(*) FILTER (event_name = 'topology.session.started') > 0 AND count(*) FILTER (event_name = 'topology.session.completed') = 0 AND max(ts) <= (SELECT max(ts) FROM topology) - INTERVAL 5 MINUTE"""


@query("orphan_sessions", "2.11.3", sql=ORPHANS)
def _(s, d):
    t = table(s, d, "topology")
    return jobs.orphan_sessions(t, t.agg(F.max("ts")).scalar()).select("session_key", "last_activity", "n_started")


@query("orphan_completions", "2.11.3", sql=f"""
SELECT session_key, event_name, TRUE AS synthetic FROM (SELECT o.session_key, 'topology.session.completed' AS event_name, o.last_activity FROM ({ORPHANS}) o WHERE o.session_key NOT IN (SELECT session_key FROM topology WHERE ts >= (SELECT max(ts) FROM topology) - INTERVAL 300 SECOND))""")
def _(s, d):
    t = table(s, d, "topology")
    now = t.agg(F.max("ts")).scalar()
    emitted = t.select("session_key", F.col("ts").alias("emitted_at"))
    return jobs.orphan_completions(jobs.orphan_sessions(t, now), emitted, now).select("session_key", "event_name", "synthetic")


def running_sql(name, started, completed):
    return f"""SELECT {name}, {sql_text(f"max(ts) FILTER (event_name = '{started}')")} AS start_time, {sql_text(f"max(ts) FILTER (event_name = '{completed}')")} AS end_time, count(*) FILTER (event_name = '{started}') AS n_started, count(*) FILTER (event_name = '{completed}') AS n_completed,
 CASE WHEN count(*) FILTER (event_name = '{started}') > count(*) FILTER (event_name = '{completed}') THEN 'active' ELSE 'completed' END AS status FROM topology WHERE event_name IN ('{started}', '{completed}') GROUP BY 1"""


AGENTS = running_sql("agent", "topology.node.started", "topology.node.completed")
TOOLS = running_sql("tool", "tool.started", "tool.completed")


@query("active_agents", "2.11.4", sql=AGENTS)
def _(s, d):
    return texts(jobs.active_agents(table(s, d, "topology")), "start_time", "end_time")


@query("active_agents_stream", "2.11.4", sql=AGENTS)
def _(s, d):
    return texts(jobs.run_available(jobs.active_agents(as_stream(s, d, "topology")), "update", keys=["agent"]), "start_time", "end_time")


@query("active_tools", "2.11.5", sql=TOOLS)
def _(s, d):
    return texts(jobs.active_tools(table(s, d, "topology")), "start_time", "end_time")


@query("active_tools_stream", "2.11.5", sql=TOOLS)
def _(s, d):
    return texts(jobs.run_available(jobs.active_tools(as_stream(s, d, "topology")), "update", keys=["tool"]), "start_time", "end_time")


@query("inferred_tools", "2.11.5", sql="""
SELECT session_key, agent, tool, CASE WHEN bool_or(done) THEN 'completed' ELSE 'active' END AS status FROM (
 SELECT session_key, agent, CASE WHEN tool = '' THEN 'search' ELSE tool END AS tool, event_name = 'tool.completed' AS done FROM topology) GROUP BY 1, 2, 3""")
def _(s, d):
    t = table(s, d, "topology").withColumn("used", F.when(F.col("tool") == "", "search").otherwise(F.col("tool")))
    msg = lambda kind, content, name=None, cid=None, calls=None: F.struct(
        F.lit(kind).alias("type"), content.alias("content"), (name if name is not None else F.lit(None).cast("string")).alias("name"),
        (cid if cid is not None else F.lit(None).cast("string")).alias("tool_call_id"),
        (calls if calls is not None else F.lit(None).cast("array<struct<id:string,name:string>>")).alias("tool_calls"))
    call = F.array(F.struct(F.lit("c1").alias("id"), F.col("used").alias("name")))
    none = F.array(F.struct(F.lit("c9").alias("id"), F.lit("other").alias("name")))
    before = msg("AIMessage", F.lit("DECISION: someone"), calls=none)
    mine = msg("AIMessage", F.concat(F.lit("DECISION: "), "agent", F.lit("\nbecause")))
    uses = msg("AIMessage", F.lit("calling"), calls=call)
    reply = msg("ToolMessage", F.lit("ok"), cid=F.when(F.col("event_name") == "tool.completed", "c1").otherwise("c7"))
    after = msg("AIMessage", F.lit("DECISION: nobody"), calls=none)
    payload = F.to_json(F.struct(F.array(F.struct(F.array(before, uses, mine, uses, reply, after).alias("messages"))).alias("args")))
    return jobs.inferred_tools(t.select("session_key", "agent", payload.alias("agent_input")))


@query("topology_nodes", "2.11.6", sql=f"""
WITH r AS (SELECT session_key, CASE WHEN event_name LIKE 'topology.node%' THEN 'agent' ELSE 'tool' END AS type, CASE WHEN event_name LIKE 'topology.node%' THEN agent ELSE tool END AS node, event_name LIKE '%.started' AS starts, ts, event_id FROM topology WHERE event_name LIKE 'topology.node%' OR event_name LIKE 'tool.%')
SELECT session_key, type, node, CASE WHEN arg_max(starts, struct_pack(t := ts, e := event_id)) THEN 'active' ELSE 'completed' END AS status, {sql_text("max(ts) FILTER (starts)")} AS start_time,
 CASE WHEN arg_max(starts, struct_pack(t := ts, e := event_id)) THEN '' ELSE {sql_text("max(ts)")} END AS end_time FROM r GROUP BY 1, 2, 3""")
def _(s, d):
    return texts(jobs.node_status(table(s, d, "topology")), "start_time", "end_time")


@query("topology_handoffs", "2.11.6", sql="""
SELECT session_key, agent AS source, target_agent AS target, min(ts) AS first_ts FROM topology WHERE event_name = 'topology.edge.updated' GROUP BY 1, 2, 3""")
def _(s, d):
    return jobs.handoff_edges(table(s, d, "topology"))


# The stack of running agents, event by event: a start is put on top, an end takes the topmost equal one away.
TOOL_EDGES = """
WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY ts, event_id) AS rn FROM topology WHERE event_name IN ('topology.node.started', 'topology.node.completed', 'tool.started')),
 r(session_key, rn, stack, owner, tool) AS (SELECT DISTINCT session_key, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM e UNION ALL
  SELECT r.session_key, e.rn,
   CASE WHEN e.event_name = 'topology.node.started' AND e.agent <> '' THEN list_append(stack, e.agent)
    WHEN e.event_name = 'topology.node.completed' AND list_contains(stack, e.agent) THEN
     list_concat(stack[1:len(stack) - list_position(list_reverse(stack), e.agent)], stack[len(stack) - list_position(list_reverse(stack), e.agent) + 2:]) ELSE stack END,
   CASE WHEN e.event_name = 'tool.started' AND e.tool <> '' AND len(stack) > 0 THEN stack[len(stack)] END, e.tool
  FROM r JOIN e ON e.session_key = r.session_key AND e.rn = r.rn + 1)
SELECT DISTINCT session_key, owner AS agent, tool FROM r WHERE owner IS NOT NULL"""


@query("topology_tool_edges", "2.11.6", sql=TOOL_EDGES)
def _(s, d):
    return jobs.tool_edges(table(s, d, "topology"))


@query("topology_tool_edges_stream", "2.11.6", sql=TOOL_EDGES)
def _(s, d):
    return jobs.run_available(jobs.live_tool_edges(as_stream(s, d, "topology")), "append").distinct()


@query("span_dedup_stream", "2.11.7", sql="""
SELECT count(*) AS n FROM (SELECT DISTINCT session_id, CASE WHEN kind = 'agent' AND in_text || out_text <> '' THEN concat('a|', entity_name, '|', in_text, '|', out_text) WHEN kind = 'chat' AND in_text || out_text <> '' THEN concat('c|', in_text, '|', out_text) ELSE span_id END AS fp FROM flat)""")
def _(s, d):
    table_ = spans(s, d)
    folder = table_.inputFiles()[0].rsplit("/", 1)[0]
    stream = jobs.stream_files(s, folder, "*.parquet", table_.schema)
    # The delay spans the month, so the stream drops exactly what the batch form drops.
    fresh = jobs.new_spans(stream, "40 days").select("session_id", "span_id")
    return jobs.run_available(fresh).agg(F.count(F.lit(1)).alias("n"))


SERIES = "SELECT metric, date_trunc('day', ts)::TIMESTAMP AS bucket, round(avg(result), 6) AS avg_value, min(result) AS min_value, max(result) AS max_value, count(*) AS n FROM metric_rows GROUP BY 1, 2"


@query("windowed_metrics", "2.11.8", sql=SERIES)
def _(s, d):
    return jobs.windowed_metrics(table(s, d, "metric_rows")).withColumn("avg_value", F.round("avg_value", 6))


@query("windowed_metrics_stream", "2.11.8", sql=f"SELECT * FROM ({SERIES}) WHERE bucket + INTERVAL 1 DAY <= (SELECT max(ts) FROM metric_rows) - INTERVAL 1 HOUR")
def _(s, d):
    out = jobs.run_available(jobs.windowed_metrics(as_stream(s, d, "metric_rows")))
    return out.withColumn("avg_value", F.round("avg_value", 6))


@query("completed_session_feed", "2.11.1", sql="SELECT DISTINCT session_id, application_id FROM flat WHERE span_name = 'session.end'")
def _(s, d):
    from spanloom.session import shared_folder
    import uuid

    table_ = spans(s, d)
    folder = table_.inputFiles()[0].rsplit("/", 1)[0]
    out = f"{shared_folder(s)}/feed-{uuid.uuid4().hex}"
    jobs.on_completed(jobs.stream_files(s, folder, "*.parquet", table_.schema), lambda done, n: done.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    return s.read.parquet(out).drop("batch").distinct()


# Old sessions are the even vectors, arriving ones the odd vectors of the same file.
ATTACH = """WITH cen AS (SELECT group_id, list(m ORDER BY i) AS c FROM (SELECT group_id, i, avg(CAST(vector[i] AS DOUBLE)) AS m FROM vectors, (SELECT unnest(range(1, 65)) AS i) WHERE vec_id % 2 = 0 GROUP BY 1, 2) GROUP BY 1),
 hit AS (SELECT v.session_key, c.group_id, row_number() OVER (PARTITION BY v.session_key ORDER BY (1 - list_dot_product(CAST(v.vector AS DOUBLE[]), c.c) / (sqrt(list_dot_product(CAST(v.vector AS DOUBLE[]), CAST(v.vector AS DOUBLE[]))) * sqrt(list_dot_product(c.c, c.c)))), c.group_id) AS rn,
  1 - list_dot_product(CAST(v.vector AS DOUBLE[]), c.c) / (sqrt(list_dot_product(CAST(v.vector AS DOUBLE[]), CAST(v.vector AS DOUBLE[]))) * sqrt(list_dot_product(c.c, c.c))) AS dd FROM vectors v, cen c WHERE v.vec_id % 2 = 1)
SELECT group_id, session_key FROM vectors WHERE vec_id % 2 = 0 UNION SELECT group_id, session_key FROM hit WHERE rn = 1 AND dd <= 0.9 AND group_id NOT IN ('g3')"""


def attach(s, d, stream):
    v = table(s, d, "vectors").withColumn("application_id", F.lit("a"))
    old = v.where("vec_id % 2 = 0")
    refs = mean_vector(old, ["group_id"], "vector").select(F.col("group_id").alias("ref_id"), F.col("centroid").alias("vector"), F.lit("a").alias("application_id"))
    refs = stored(s, d, "attach_refs", lambda: refs)
    hashes = stored(s, d, "attach_hashes", lambda: gr.content_hashes(old.select("group_id", "session_key")))
    if stream:
        raw = jobs.stream_files(s, d, "embeddings.parquet", table(s, d, "embeddings").schema)
        new = raw.where("vec_id % 2 = 1").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("session_key"), F.col("embedding").alias("vector"), F.lit("a").alias("application_id"))
        hits = jobs.nearest_groups(new, refs, 0.9)
    else:
        hits = jobs.nearest_groups(v.where("vec_id % 2 = 1").drop("group_id"), refs, 0.9)
    # One group has changed meanwhile: its expected hash no longer matches.
    asked = hits.join(hashes.withColumnRenamed("group_id", "ref_id"), "ref_id").select(
        F.col("ref_id").alias("group_id"), "session_key", F.when(F.col("ref_id") == "g3", "stale").otherwise(F.col("hash")).alias("hash"))
    return jobs.attach_sessions(old, hashes, asked)[0]


@query("attached_sessions", "2.9.8", sql=ATTACH)
def _(s, d):
    return attach(s, d, stream=False)


@query("online_group_attach_stream", "2.11.9", sql=ATTACH)
def _(s, d):
    return attach(s, d, stream=True)
