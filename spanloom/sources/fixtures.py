"""Trace-shaped tables derived from the given parquet tables.

Each definition is one portable SELECT. Spark runs it over DataFrames; the oracle inlines the same
text as a common table expression. ``{S}`` is the string type, ``{K}`` the ``k`` member of
``events.props``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanloom import schema as keys
from spanloom.functions.ordered import Sequence
from spanloom.session import written

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Spans: one per event. Signups spread over chat, graph and session marker spans.
SPAN_ROWS = """
SELECT concat('sp', lpad(CAST(event_id AS {S}), 12, '0')) AS span_id, ts,
 concat('t', CAST(user_id AS {S}), 'd', CAST(day(ts) AS {S})) AS trace_id,
 concat('app', CAST(user_id % 5 AS {S})) AS application_id,
 concat('app', CAST(user_id % 5 AS {S}), '_s', CAST(user_id AS {S}), 'w',
        CAST(CAST(floor((day(ts) - 1) / 5) AS INT) AS {S})) AS session_id,
 concat('s', CAST(user_id AS {S}), 'w', CAST(CAST(floor((day(ts) - 1) / 5) AS INT) AS {S})) AS session_key,
 concat('agent', CAST(k % 4 AS {S}), '.invoke') AS agent_id,
 CASE WHEN event_type = 'view' THEN concat('agent', CAST(k % 4 AS {S}), '.agent')
      WHEN event_type IN ('click', 'error') THEN concat('tool', CAST(k % 6 AS {S}), '.tool')
      WHEN event_type = 'signup' AND k % 10 = 0 THEN 'team.graph'
      WHEN event_type = 'signup' AND k % 10 = 1 THEN 'agent_start_event'
      WHEN event_type = 'signup' AND k % 10 = 2 THEN 'session.start'
      WHEN event_type = 'signup' AND k % 10 = 3 THEN 'session.end'
      ELSE 'Model.chat' END AS span_name,
 CASE WHEN event_type = 'view' THEN 'agent' WHEN event_type IN ('click', 'error') THEN 'tool'
      WHEN event_type = 'signup' AND k % 10 = 0 THEN 'graph'
      WHEN event_type = 'signup' AND k % 10 = 1 THEN 'note'
      WHEN event_type = 'signup' AND k % 10 IN (2, 3) THEN 'mark'
      ELSE 'chat' END AS kind,
 k, user_id, value,
 CAST(round(value * 100) AS BIGINT) * 10000 AS duration,
 CASE WHEN event_type = 'error' THEN 'Error' ELSE 'Ok' END AS status_code,
 CASE WHEN event_type = 'error' AND k % 3 <> 0 THEN concat('E', CAST(k % 3 AS {S})) ELSE '' END AS status_message
FROM (SELECT e0.*, {K} AS k FROM events e0) e
"""

FLAT = """
SELECT r.*,
 CASE WHEN kind = 'chat' THEN CAST(k * 10 AS {S}) END AS input_tokens,
 CASE WHEN kind = 'chat' AND k % 7 <> 6 THEN CAST(k AS {S}) WHEN kind = 'chat' THEN 'n/a' END AS output_tokens,
 CASE WHEN kind = 'chat' AND k % 2 = 0 THEN CAST(k * 11 AS {S}) END AS total_tokens,
 CASE WHEN kind = 'chat' THEN concat('model', CAST(k % 3 AS {S})) END AS model,
 CASE WHEN kind = 'chat' THEN concat('prov', CAST(k % 2 AS {S})) END AS provider,
 CASE WHEN kind IN ('agent', 'chat', 'tool') THEN
   CASE WHEN k % 11 = 0 THEN '' ELSE concat('t', CAST(k % 4 AS {S})) END END AS in_text,
 CASE WHEN kind IN ('agent', 'chat', 'tool') THEN
   CASE WHEN k % 13 = 0 THEN '' ELSE concat('t', CAST(k % 3 AS {S})) END END AS out_text,
 CASE WHEN kind = 'tool' THEN concat('tool', CAST(k % 6 AS {S}))
      WHEN kind = 'agent' THEN concat('Agent ', CAST(k % 4 AS {S})) END AS entity_name,
 CASE WHEN kind = 'graph' THEN concat('{{"nodes":{{"__start__":{{"name":"start"}},"agent', CAST(k % 4 AS {S}),
   '.invoke":{{"name":"Lead"}},"agent', CAST(user_id % 6 AS {S}), '.invoke":{{"name":"Aide ', CAST(user_id % 6 AS {S}),
   '"}},"__end__":{{"name":"end"}}}},"edges":[{{"source":"__start__","target":"agent', CAST(k % 4 AS {S}),
   '.invoke"}},{{"source":"agent', CAST(k % 4 AS {S}), '.invoke","target":"__end__"}}]}}') END AS graph_json
FROM span_rows r
"""

# Parent: the last agent span of the session before the row; every second agent span is a root.
TREE_ORACLE = """
SELECT f.*, CASE WHEN kind IN ('graph', 'note', 'mark') THEN '' WHEN kind = 'agent' AND k % 2 = 0 THEN ''
  ELSE coalesce(last_agent, '') END AS parent_span_id, coalesce(last_agent, '') AS last_agent_span
FROM (SELECT f0.*, last_value(CASE WHEN kind = 'agent' THEN span_id END IGNORE NULLS) OVER
  (PARTITION BY session_id ORDER BY ts, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_agent
  FROM flat f0) f
"""

METRIC_ROWS = """
SELECT concat('mr', lpad(CAST(event_id AS {S}), 12, '0')) AS result_id, ts,
 concat('app', CAST(user_id % 5 AS {S})) AS application_id,
 concat('s', CAST(user_id AS {S}), 'w', CAST(CAST(floor((day(ts) - 1) / 5) AS INT) AS {S})) AS session_key,
 concat('sp', lpad(CAST(event_id AS {S}), 12, '0')) AS span_id,
 concat('agent', CAST(k % 4 AS {S})) AS agent,
 CASE k % 10 WHEN 0 THEN 'LLMErrorRate' WHEN 1 THEN 'ToolErrorRate' WHEN 2 THEN 'IntentRecognitionAccuracy'
  WHEN 3 THEN 'Groundedness' WHEN 4 THEN 'ToolUtilizationAccuracy' WHEN 5 THEN 'AnswerRelevancy'
  WHEN 6 THEN 'ResponseCompleteness' WHEN 7 THEN 'WorkflowEfficiency' WHEN 8 THEN 'CyclesCount' ELSE 'Cost' END AS metric,
 CASE k % 10 WHEN 8 THEN CAST(k % 4 AS DOUBLE) WHEN 9 THEN round(value, 2) ELSE CAST(k AS DOUBLE) / 100 END AS result,
 CASE WHEN k % 2 = 0 THEN 'Native' ELSE 'Judge' END AS provider,
 CASE WHEN k % 5 = 0 THEN '' ELSE concat('because ', CAST(k % 5 AS {S})) END AS reasoning,
 user_id, k
FROM (SELECT e0.*, {K} AS k FROM events e0) e
"""

# Groups: application root -> two middle groups -> four leaves; sessions hang on the leaves.
GROUP_SESSIONS = """
SELECT DISTINCT concat('app', CAST(user_id % 5 AS {S}), '_g', CAST(CAST(floor(user_id / 5) AS BIGINT) % 4 AS {S})) AS group_id,
 session_key, application_id FROM span_rows
"""

GROUP_EDGES = """
SELECT DISTINCT concat(application_id, '_root') AS parent_id,
  concat(application_id, '_m', CAST(CAST(floor(user_id / 5) AS BIGINT) % 2 AS {S})) AS child_id FROM span_rows
UNION
SELECT DISTINCT concat(application_id, '_m', CAST(CAST(floor(user_id / 5) AS BIGINT) % 2 AS {S})) AS parent_id,
  concat(application_id, '_g', CAST(CAST(floor(user_id / 5) AS BIGINT) % 4 AS {S})) AS child_id FROM span_rows
"""

GROUPS = """
SELECT g.group_id, g.application_id, g.is_leaf, concat('Group ', g.group_id) AS name,
  concat('h', CAST(length(g.group_id) AS {S})) AS hash, concat('model', CAST(length(g.group_id) % 2 AS {S})) AS embedding_model
FROM (SELECT DISTINCT concat(application_id, '_root') AS group_id, application_id, FALSE AS is_leaf FROM span_rows
 UNION SELECT DISTINCT concat(application_id, '_m', CAST(CAST(floor(user_id / 5) AS BIGINT) % 2 AS {S})), application_id, FALSE FROM span_rows
 UNION SELECT DISTINCT concat(application_id, '_g', CAST(CAST(floor(user_id / 5) AS BIGINT) % 4 AS {S})), application_id, TRUE FROM span_rows) g
"""

# Consistency reports of the leaves, one per layer and metric.
REPORTS = """
SELECT group_id, data_type, metric, mean, CASE WHEN data_type = 'graph' AND mean < 0.49 THEN 'hx' ELSE hash END AS group_hash,
 concat('cr_', group_id, '_', data_type, '_', metric) AS report_id FROM (
 SELECT concat(application_id, '_g', CAST(CAST(floor(user_id / 5) AS BIGINT) % 4 AS {S})) AS group_id,
  CASE WHEN k % 3 = 0 THEN 'metric' WHEN k % 3 = 1 THEN 'graph' ELSE 'text' END AS data_type,
  CASE WHEN k % 3 = 0 THEN concat('metric', CAST(k % 2 AS {S})) ELSE '' END AS metric,
  round(avg(CAST(k AS DOUBLE)) / 100, 6) AS mean, 'h7' AS hash
 FROM span_rows GROUP BY 1, 2, 3) x
"""

# Two-step texts: one state per conversation turn.
STEPS = """
SELECT concat('c', CAST(conv_id AS {S})) AS session_key, turn AS idx, role AS agent, text,
  concat('app', CAST(conv_id % 3 AS {S})) AS application_id FROM conversations
"""

# Orders as sessions, line items as calls.
CALLS = """
SELECT concat('o', CAST(l_orderkey AS {S})) AS session_key, l_linenumber AS idx,
 concat('a', CAST(l_suppkey % 7 AS {S})) AS agent, l_returnflag = 'R' AS failed,
 CASE WHEN l_linestatus = 'O' THEN 'llm' ELSE 'tool' END AS call_type, CAST(l_quantity AS DOUBLE) AS tokens,
 l_extendedprice * l_discount AS cost, l_shipdate AS ts, l_suppkey, l_partkey FROM lineitem
"""

CALL_SESSIONS = """
SELECT concat('o', CAST(o_orderkey AS {S})) AS session_key, concat('mas_', c_mktsegment) AS application_id,
 o_orderdate AS started, o_totalprice AS total, c_nationkey AS nation
FROM orders JOIN customer ON o_custkey = c_custkey
"""

VECTORS = """
SELECT concat('v', CAST(vec_id AS {S})) AS session_key, embedding AS vector, concat('g', CAST(label AS {S})) AS group_id, vec_id FROM embeddings
"""

# Topology log events of the live view.
TOPOLOGY = """
SELECT concat('ev', lpad(CAST(event_id AS {S}), 12, '0')) AS event_id, ts,
 concat('s', CAST(user_id AS {S}), 'w', CAST(CAST(floor((day(ts) - 1) / 5) AS INT) AS {S})) AS session_key,
 concat('app', CAST(user_id % 5 AS {S})) AS application_id,
 CASE event_type WHEN 'view' THEN 'topology.node.started' WHEN 'purchase' THEN 'topology.node.completed' WHEN 'click' THEN 'tool.started'
  WHEN 'error' THEN 'tool.completed' ELSE CASE WHEN k % 5 = 0 THEN 'topology.session.completed' WHEN k % 5 = 1 THEN 'topology.edge.updated' ELSE 'topology.session.started' END END AS event_name,
 concat('agent', CAST(k % 4 AS {S})) AS agent, CASE WHEN event_type IN ('click', 'error') THEN concat('tool', CAST(k % 6 AS {S})) ELSE '' END AS tool,
 concat('agent', CAST((k + 1) % 4 AS {S})) AS target_agent
FROM (SELECT e0.*, {K} AS k FROM events e0) e
"""

# A counter per user that restarts at every signup.
COUNTER_ORACLE = """
SELECT application_id, agent, ts, seq, CAST(sum(k) OVER (PARTITION BY agent, part ORDER BY ts, seq) AS DOUBLE) AS value,
 CAST(row_number() OVER (PARTITION BY agent, part ORDER BY ts, seq) AS DOUBLE) AS cnt FROM (
 SELECT c.*, sum(restart) OVER (PARTITION BY agent ORDER BY ts, seq) AS part FROM counter_rows c)
"""
COUNTER_ROWS = """
SELECT event_id AS seq, ts, concat('u', CAST(user_id AS {S})) AS agent, concat('app', CAST(user_id % 5 AS {S})) AS application_id,
 k, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS restart FROM (SELECT e0.*, {K} AS k FROM events e0) e
"""

# Metric documents: one JSON text per event; session ids with and without the application prefix.
DERIVED = """
SELECT event_id AS id, ts, CASE WHEN k % 2 = 0 THEN concat('app', CAST(user_id % 5 AS {S}), '_', skey) ELSE skey END AS session_id,
 skey AS session_key, application_id, agent_id,
 CASE k % 4 WHEN 0 THEN concat('{{"metric_name":"PassiveEvalApp","category":"application","value":{{"eval.app.tool_calls":', CAST(k AS {S}),
   ',"eval.app.tool_fails":', CAST(k % 3 AS {S}), ',"eval.app.llm_calls":', CAST(k % 17 AS {S}), ',"eval.app.llm_fails":', CAST(k % 2 AS {S}),
   ',"eval.app.llm_cost":', CAST(k % 9 AS {S}), '.5,"eval.app.duration":', CAST(k * 3 AS {S}), ',"eval.app.graph_determinism":0.', CAST(k % 10 AS {S}), ',"eval.app.graph_dynamism":0.25}}}}')
  WHEN 1 THEN concat('{{"metric_name":"PassiveEvalAgents","category":"agent","value":{{"agents":{{"Agent_', CAST(k % 3 AS {S}), '":{{"eval.agent.llm_duration":', CAST(k AS {S}),
   ',"eval.agent.llm_cost":', CAST(k % 5 AS {S}), '.25}},"agent3":{{"eval.agent.llm_duration":1,"eval.agent.llm_cost":0.5}}}}}}}}')
  WHEN 2 THEN concat('{{"metric_name":"TaskCompletion","category":"agent","value":0.', CAST(k % 10 AS {S}), '}}')
  ELSE concat('{{"metric_name":"AnswerRelevancy","category":"application","value":0.', CAST(k % 10 AS {S}), '}}') END AS metrics,
 CASE k % 4 WHEN 0 THEN 'PassiveEvalApp' WHEN 1 THEN 'PassiveEvalAgents' WHEN 2 THEN 'TaskCompletion' ELSE 'AnswerRelevancy' END AS doc_metric, k
FROM (SELECT e0.*, {K} AS k, concat('s', CAST(user_id AS {S}), 'w', CAST(CAST(floor((day(ts) - 1) / 5) AS INT) AS {S})) AS skey,
 concat('app', CAST(user_id % 5 AS {S})) AS application_id, concat('agent', CAST({K} % 4 AS {S}), '.invoke') AS agent_id FROM events e0) e
"""

# Label versions: two rows for a document that is labelled toxic.
LABEL_ROWS = """
SELECT concat('d', CAST(doc_id AS {S})) AS session_id, quality = 1 AS label, 'a' AS labeler, 1 AS updated_at FROM labels
UNION ALL SELECT concat('d', CAST(doc_id AS {S})), FALSE, 'b', 2 FROM labels WHERE toxic = 1
"""

# Waste estimates, feature scores, contributions, insights and evaluation verdicts per session.
WASTE = """
SELECT session_key, application_id, round(avg(CAST(k AS DOUBLE)) / 100, 6) AS estimated_waste,
 CASE WHEN sum(k) % 3 = 0 THEN 0.0 ELSE round(CAST(sum(k) AS DOUBLE) / 1000, 6) END AS actual_cost,
 round(1 - avg(CAST(k AS DOUBLE)) / 100, 6) AS cost_efficiency, min(ts) AS started FROM span_rows GROUP BY 1, 2
"""
FEATURE_SCORES = """
SELECT session_key, quality_target, feature, score, row_number() OVER (PARTITION BY session_key, quality_target ORDER BY score DESC, feature) AS rank FROM (
 SELECT session_key, CASE WHEN k % 2 = 0 THEN 'accuracy' ELSE 'latency' END AS quality_target, concat('f', span_id) AS feature, result AS score FROM metric_rows) x
"""
CONTRIBUTIONS = """
SELECT session_key, application_id, concat('m', CAST(k % 2 AS {S})) AS metric, concat('{{"agent', CAST(k % 4 AS {S}), '": 0.', CAST(k % 9 AS {S}), ', "agent', CAST((k + 1) % 4 AS {S}), '": 0.5}}') AS contributions
FROM span_rows WHERE kind = 'chat'
"""
INSIGHTS = """
SELECT concat('in', span_id) AS insight_id, session_key, application_id, concat('Insight ', CAST(k % 7 AS {S})) AS name, k % 5 AS priority, ts AS created FROM span_rows WHERE status_code = 'Error'
"""
VERDICTS = """
SELECT session_key, application_id, concat('{{"total_fatal": ', CAST(k % 3 AS {S}), ', "total_minor": ', CAST(k % 5 AS {S}), '}}') AS reasoning, CASE WHEN k % 3 = 0 THEN 1.0 ELSE 0.0 END AS result FROM span_rows WHERE kind = 'agent'
"""

DEFINITIONS: dict[str, str] = {
    "span_rows": SPAN_ROWS,
    "flat": FLAT,
    "metric_rows": METRIC_ROWS,
    "group_sessions": GROUP_SESSIONS,
    "group_edges": GROUP_EDGES,
    "groups": GROUPS,
    "reports": REPORTS,
    "steps": STEPS,
    "calls": CALLS,
    "call_sessions": CALL_SESSIONS,
    "vectors": VECTORS,
    "topology": TOPOLOGY,
    "counter_rows": COUNTER_ROWS,
    "derived": DERIVED,
    "label_rows": LABEL_ROWS,
    "waste": WASTE,
    "feature_scores": FEATURE_SCORES,
    "contributions": CONTRIBUTIONS,
    "insights": INSIGHTS,
    "verdicts": VERDICTS,
}
ORACLE_ONLY = {"tree": TREE_ORACLE, "counter": COUNTER_ORACLE}
_DUCK = {"S": "VARCHAR", "K": "CAST(json_extract_string(props, '$.k') AS BIGINT)"}
_SPARK = {"S": "STRING", "K": "CAST(get_json_object(props, '$.k') AS BIGINT)"}


def _words(sql: str) -> set[str]:
    return set(re.findall(r"[A-Za-z_]+", sql))


def oracle_define(name: str, sql: str) -> None:
    """Add a table that only oracles use; it may name any other fixture table."""
    ORACLE_ONLY[name] = sql


def oracle_with(sql: str) -> str:
    """Prefix ``sql`` with the fixture tables it names, directly or through others."""
    texts = {n: t.format(**_DUCK) for n, t in DEFINITIONS.items()} | ORACLE_ONLY
    needed: list[str] = []

    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in texts:
            if name in _words(text) and name not in seen:
                seen.add(name)
                visit(texts[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({texts[n].strip()})" for n in needed)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[14:]}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes},\n{body[4:]}"
    return f"WITH {ctes}\n{body}"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A given table, or a fixture derived from them, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{d}/{name}.parquet")
    text = DEFINITIONS[name].format(**_SPARK)
    needs = [n for n in [*TABLES, *DEFINITIONS] if n in _words(text) and n != name]
    for n in needs:
        text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 @@{n}@@", text)
    text = text.replace("{", "{{").replace("}", "}}")
    used = [n for n in needs if f"@@{n}@@" in text]
    for n in used:
        text = text.replace(f"@@{n}@@", "{" + n + "}")
    return spark.sql(text, **{n: table(spark, d, n) for n in used})


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, d: str, name: str, make) -> DataFrame:
    """A derived table that many queries read, written once per application to the shared folder."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _STORED:
        _STORED[key] = written(make(), name)
    return _STORED[key]


def forget() -> None:
    """Write derived tables anew when they are next asked for."""
    _STORED.clear()


def spans(spark: SparkSession, d: str) -> DataFrame:
    """The span table in its canonical shape."""
    return stored(spark, d, "spans", lambda: derive_spans(spark, d))


def derive_spans(spark: SparkSession, d: str) -> DataFrame:
    last = F.when(F.col("kind") == "agent", F.col("span_id"))
    flat = (
        Sequence(table(spark, d, "flat"), ["session_id"], ["ts", "span_id"])
        .last_seen("last_agent", last)
        .done()
        .withColumn("last_agent_span", F.coalesce("last_agent", F.lit("")))
        .withColumn(
            "parent_span_id",
            F.when(F.col("kind").isin("graph", "note", "mark"), "")
            .when((F.col("kind") == "agent") & (F.col("k") % 2 == 0), "")
            .otherwise(F.col("last_agent_span")),
        )
    )
    kind, k = F.col("kind"), F.col("k")
    capability = kind.isin("chat", "tool")
    pairs = [
        (keys.INPUT_TOKENS, F.col("input_tokens")),
        (keys.OUTPUT_TOKENS, F.col("output_tokens")),
        (keys.TOTAL_TOKENS, F.col("total_tokens")),
        (keys.REQUEST_MODEL, F.col("model")),
        (keys.PROVIDER, F.col("provider")),
        (keys.ENTITY_NAME, F.col("entity_name")),
        (keys.ENTITY_INPUT, F.when(kind == "agent", F.col("in_text"))),
        (keys.ENTITY_OUTPUT, F.when(kind == "agent", F.col("out_text"))),
        (keys.INPUT_MESSAGES, F.when(kind == "chat", F.col("in_text"))),
        (keys.OUTPUT_MESSAGES, F.when(kind == "chat", F.col("out_text"))),
        (keys.TOOL_ARGUMENTS, F.when(kind == "tool", F.col("in_text"))),
        (keys.TOOL_RESULT, F.when(kind == "tool", F.col("out_text"))),
        (keys.GRAPH, F.col("graph_json")),
        (keys.APPLICATION, F.col("application_id")),
        (keys.SESSION, F.col("session_id")),
    ]
    pairs += [
        (keys.OWNER_SPAN, F.when(capability, F.nullif("last_agent_span", F.lit("")))),
        (
            keys.HANDOFF_SOURCES,
            F.when(
                (kind == "agent") & (k % 6 == 0) & (F.col("last_agent_span") != ""),
                F.concat(F.lit('["'), "last_agent_span", F.lit('"]')),
            ),
        ),
    ]
    entries = F.filter(
        F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in pairs]),
        lambda e: e["value"].isNotNull(),
    )
    start = F.struct(
        F.col("ts").alias("ts"),
        F.lit(keys.AGENT_START).alias("name"),
        F.create_map(
            F.lit("agent_id"), F.col("agent_id"),
            F.lit("description"), F.concat(F.lit("does "), (k % 3).cast("string")),
        ).alias("attributes"),
    )
    events = F.when(kind == "note", F.array(start)).otherwise(F.array().cast("array<struct<ts:timestamp_ntz,name:string,attributes:map<string,string>>>"))
    cols = [
        "ts", "trace_id", "span_id", "span_name", "application_id", "session_id", "agent_id",
        "duration", "status_code", "status_message", "parent_span_id",
    ]
    return flat.select(
        *cols,
        F.col("application_id").alias("service_name"),
        F.map_from_entries(entries).alias("attrs"),
        events.alias("events"),
    )


def counter(spark: SparkSession, d: str) -> DataFrame:
    """Restarting counters: running sums inside the pieces between signups."""
    rows = table(spark, d, "counter_rows")
    parts = Sequence(rows, ["agent"], ["ts", "seq"]).running_sum("part", "restart").done()
    run = Sequence(parts, ["agent", "part"], ["ts", "seq"])
    run.running_sum("value", "k").number("cnt")
    return run.done().select(
        "application_id", "agent", "ts", "seq",
        F.col("value").cast("double").alias("value"), F.col("cnt").cast("double").alias("cnt"),
    )
