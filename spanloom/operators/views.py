"""Views of sessions and applications: waterfall, state graph, hierarchy, conversation, charts."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from spanloom import schema
from spanloom.functions.ordered import Sequence, rank_select
from spanloom.functions.scalar import attr, base_name, has_suffix
from spanloom.operators.groups import covariance
from spanloom.operators.metrics import PERIODS, in_period, period_bounds, period_series
from spanloom.operators.spans import is_error
from spanloom.operators.traverse import hop, of_type
from spanloom.session import cut_lineage

# Spans left out of the tree's top level, and of the root's duration.
SKIPPED = ["session.publish", "special_agent"]
OUTSIDE_ROOT_DURATION = ["session.end"]


# -- waterfall ------------------------------------------------------------------------------


def subtree_bounds(rows: DataFrame, keys: list[str], parent: str) -> DataFrame:
    """(keys, a, b): least ``a`` and greatest ``b`` of a node and all below it; one row per node throughout.

    ``parent`` is the parent's last key, NULL on top; nodes of other leading keys never mix. In round k a
    node takes in the nodes whose pointer, 2^k links up, is this node, and then pointers double: the
    rounds grow with the logarithm of the depth. Links that form a circle end with the number of nodes.
    """
    *outer, own = keys
    state = cut_lineage(rows.select(*keys, F.col(parent).alias("_up"), "a", "b"))
    most = state.count()
    span = 1
    while span <= most:
        below = state.where("_up IS NOT NULL").groupBy(*outer, F.col("_up").alias(own)).agg(F.min("a").alias("_a"), F.max("b").alias("_b"))
        over = state.select(*outer, F.col(own).alias("_up"), F.col("_up").alias("_next"))
        state = state.join(below, keys, "left").join(over, [*outer, "_up"], "left")
        state = cut_lineage(state.select(*keys, F.col("_next").alias("_up"), F.least("a", "_a").alias("a"), F.greatest("b", "_b").alias("b")))
        span *= 2
        if state.where("_up IS NOT NULL").isEmpty():
            break
    return state.select(*keys, "a", "b")


def waterfall(spans: DataFrame) -> DataFrame:
    """Every span with its parent in the tree ('root' on top), bounds widened by its descendants in the session."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = spans.where("session_id <> ''").select(
        "session_id", "span_id", "span_name", "parent_span_id", us.alias("a"),
        (us + F.floor(F.col("duration") / 1e6) * 1000).alias("b"), is_error().alias("error"))
    last = F.substring_index("span_name", ".", -1)
    rows = rows.withColumn("_skip", last.isin(*SKIPPED))
    known = rows.where("NOT _skip").select("session_id", F.col("span_id").alias("parent_span_id"), F.lit(True).alias("_in")).distinct()
    linked = cut_lineage(rows.join(known, ["session_id", "parent_span_id"], "left"))
    nodes = linked.groupBy("session_id", "span_id").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min(F.when(F.col("_in"), F.col("parent_span_id"))).alias("_parent"))
    wide = subtree_bounds(nodes, ["session_id", "span_id"], "_parent").withColumnsRenamed({"a": "da", "b": "db"})
    out = linked.where("NOT _skip").join(wide, ["session_id", "span_id"], "left")
    a, b = F.least("a", "da"), F.greatest("b", "db")
    return out.select(
        "session_id", "span_id", "span_name", F.when(F.col("_in"), F.col("parent_span_id")).otherwise("root").alias("parent"),
        F.when(F.col("_in"), last).otherwise("agent").alias("icon"), a.alias("starts_us"), b.alias("ends_us"),
        F.floor(F.greatest(b - a, F.lit(0)) / 1000).alias("duration_ms"), "error")


def root_bounds(tree: DataFrame) -> DataFrame:
    """Bounds of the synthetic root: over top spans that count, else over all top spans."""
    top = tree.where("parent = 'root'")
    counts = ~F.col("span_name").isin(*OUTSIDE_ROOT_DURATION)
    pick = lambda fn, c: F.coalesce(fn(F.when(counts, F.col(c))), fn(c))
    agg = top.groupBy("session_id").agg(pick(F.min, "starts_us").alias("starts_us"), pick(F.max, "ends_us").alias("ends_us"))
    return agg.withColumn("duration_ms", F.floor((F.col("ends_us") - F.col("starts_us")) / 1000))


# -- graph views ----------------------------------------------------------------------------

LEVELS = {"AgentCall": "agent", "LLMCall": "call", "ToolCall": "call", "ProcessingCall": "call", "MASCall": "mas", "Session": "session"}
CALL_TYPES = {"ToolCall": "tool", "LLMCall": "llm", "ProcessingCall": "processing"}


def _lookup(table: dict[str, str], col: Column) -> Column:
    return reduce(lambda c, kv: c.when(col == kv[0], kv[1]), list(table.items())[1:], F.when(col == list(table)[0], list(table.values())[0]))


def state_machine(nodes: DataFrame, edges: DataFrame, levels: list[str] | None = None) -> DataFrame:
    """Transitions with the role of both states in their session, level and type of what they represent."""
    e = lambda kind, a, b: edges.where(F.col("edge_type") == kind).select(F.col("from_id").alias(a), F.col("to_id").alias(b))
    t = of_type(nodes, "Transition").select(F.col("id").alias("transition"), "session_id").distinct()
    calls = of_type(nodes, *LEVELS).select(F.col("id").alias("execution"), F.col("node_type").alias("execution_type"), "duration")
    rows = (
        t.join(e("inputTo", "from_state", "transition"), "transition").join(e("leadsTo", "transition", "to_state"), "transition")
        .join(e("representsExecution", "transition", "execution"), "transition", "left").join(calls, "execution", "left"))
    if levels:
        kinds = [k for k, v in LEVELS.items() if v in levels or CALL_TYPES.get(k) in levels]
        rows = rows.where(F.col("execution_type").isin(*kinds))
    first = e("hasInitialState", "session_id", "_first").join(of_type(nodes, "Session").select(F.col("id").alias("session_id")), "session_id", "left_semi")
    last = e("hasFinalState", "session_id", "_last").join(of_type(nodes, "Session").select(F.col("id").alias("session_id")), "session_id", "left_semi")
    rows = rows.join(first, "session_id", "left").join(last, "session_id", "left")
    role = lambda c: F.when(F.col(c) == F.col("_first"), "initial").when(F.col(c) == F.col("_last"), "final").otherwise("intermediate")
    return rows.select(
        "session_id", "transition", "execution", "from_state", role("from_state").alias("from_role"), "to_state", role("to_state").alias("to_role"),
        _lookup(LEVELS, F.col("execution_type")).alias("level"), _lookup(CALL_TYPES, F.col("execution_type")).alias("call_type"), "duration").distinct()


def execution_hierarchy(nodes: DataFrame, edges: DataFrame, min_rows: int | None = None) -> DataFrame:
    """MAS, agent and capability calls with their parent and place in the session's sequence.

    A capability call without an owner belongs to the agent call that started last before it, else
    to the first one; that as-of parent is carried along the time order of the session.
    """
    calls = of_type(nodes, "MASCall", "AgentCall", "ToolCall", "LLMCall").select("id", "node_type", F.col("session_id").alias("session"), F.col("start_time").alias("start"))
    own = edges.where(F.col("edge_type").isin("hasAgentCall", "hasToolCall", "hasLLMCall")).groupBy(F.col("to_id").alias("id")).agg(F.min("from_id").alias("owner"))
    rows = calls.join(own, "id", "left")
    rank = F.when(F.col("node_type") == "MASCall", 0).when(F.col("node_type") == "AgentCall", 1).otherwise(2)
    rows = rows.withColumn("rank", rank)
    seq = Sequence(rows, ["session"], ["start", "rank", "id"], min_rows=min_rows)
    seq.last_seen("before", F.when(F.col("node_type") == "AgentCall", F.col("id")))
    firsts = rows.where("node_type = 'AgentCall'").groupBy("session").agg(F.min_by("id", F.struct("start", "id")).alias("first_agent"))
    placed = seq.done().join(firsts, "session", "left")
    parent = F.when(F.col("rank") == 0, F.col("session")).when(F.col("rank") == 1, F.col("owner")).otherwise(F.coalesce("owner", "before", "first_agent"))
    placed = placed.select("session", "id", "node_type", "start", "rank", parent.alias("parent"), F.col("owner").isNotNull().alias("owned"))
    numbered = Sequence(placed.where("parent IS NOT NULL"), ["session"], ["rank", "start", "id"], min_rows=min_rows)
    return numbered.number("pos").done().drop("rank")


def conversation(nodes: DataFrame, edges: DataFrame, min_rows: int | None = None) -> DataFrame:
    """Agent turns and the calls nested in them, one row each: (session, turn, kind, id, place in turn).

    A call no agent claims is a turn of its own.
    """
    calls = of_type(nodes, "AgentCall", "LLMCall", "ToolCall").select("id", "node_type", F.col("session_id").alias("session"), F.col("start_time").alias("start"))
    own = edges.where(F.col("edge_type").isin("hasToolCall", "hasLLMCall")).groupBy(F.col("to_id").alias("id")).agg(F.min("from_id").alias("owner"))
    rows = calls.join(own, "id", "left").withColumn("turn", F.coalesce("owner", "id")).withColumn("nested", F.col("owner").isNotNull().cast("int"))
    seq = Sequence(rows, ["turn"], ["nested", "start", "id"], min_rows=min_rows).number("place").done()
    return seq.select("session", "turn", "id", _lookup({"AgentCall": "agent", "LLMCall": "llm", "ToolCall": "tool"}, F.col("node_type")).alias("kind"), "start", (F.col("place") - 1).alias("place"))


def topology(spans: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the newest declared graph per application or session."""
    graph = attr(schema.GRAPH)
    newest = spans.where(has_suffix("span_name", "graph") & graph.isNotNull()).groupBy(by).agg(
        F.max_by(graph, F.struct("ts", "span_id")).alias("g"))
    shape = "nodes map<string,struct<name:string>>, edges array<struct<source:string,target:string>>"
    parsed = newest.select(by, F.from_json("g", shape).alias("g"))
    nodes = parsed.select(by, F.explode("g.nodes").alias("node", "n")).select(by, "node", F.col("n.name").alias("name"))
    return nodes, parsed.select(by, F.inline("g.edges"))


def agent_details(spans: DataFrame, descriptions: DataFrame, tokens: DataFrame) -> DataFrame:
    """Per (session, agent): spans, mean duration, tokens, description."""
    rows = spans.where(base_name("agent_id") != "").groupBy("session_id", "application_id", base_name("agent_id").alias("agent")).agg(
        F.count(F.lit(1)).alias("n_spans"), F.avg("duration").alias("mean_duration"))
    return rows.join(tokens, ["session_id", "agent"], "left").join(descriptions, ["application_id", "agent"], "left")


# -- charts ---------------------------------------------------------------------------------


def bucketed_values(points: DataFrame, by: list[str], values: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Per period: sums or means of per-session ``values`` over the sessions active in it, 0 if none.

    ``columns`` maps a column to ``sum`` or ``avg``. A session active in several periods counts in each.
    """
    bounds = period_bounds(points, by)
    active = in_period(points, bounds, by).select(*by, "period", "session_key").distinct()
    joined = active.join(values, [*by, "session_key"], "left")
    agg = joined.groupBy(*by, "period").agg(
        F.count(F.lit(1)).alias("n_sessions"), *[(F.sum(c) if op == "sum" else F.avg(c)).alias(c) for c, op in columns.items()])
    spine = bounds.select(*by, F.explode(F.sequence(F.lit(0), F.lit(PERIODS - 1))).alias("period")).withColumn("period", F.col("period").cast("bigint"))
    return spine.join(agg, [*by, "period"], "left").na.fill(0)


def tool_chart(spans: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Tool cards (utilisation, success, error in percent) and the mean duration per period."""
    tools = spans.where(has_suffix("span_name", "tool")).withColumn("tool", base_name("span_name"))
    all_sessions = spans.groupBy(*by).agg(F.count_distinct("session_id").alias("n_all"))
    cards = tools.groupBy(*by, "tool").agg(
        F.count_distinct("session_id").alias("n"), F.avg(F.when(is_error(), 0.0).otherwise(1.0)).alias("ok")).join(all_sessions, by)
    cards = cards.select(
        *by, "tool", (F.col("n") / F.col("n_all") * 100).alias("utilisation"), (F.col("ok") * 100).alias("success"),
        ((1 - F.col("ok")) * 100).alias("error"), F.lit(0.0).alias("retry"), F.lit(0.0).alias("accuracy"))
    points = tools.select(*by, "tool", F.col("session_id").alias("session_key"), (F.col("duration") / 1e6).alias("result"),
                          (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("epoch"))
    return cards, period_series(points, by, ["tool"])


# Fixed values, series of the metric charts: chart, series, metric it shows, operation, unit.
CHARTS = [
    ("quality", "groundedness", "Groundedness", "average", "SCALAR"),
    ("quality", "answerRelevancy", "AnswerRelevancy", "average", "SCALAR"),
    ("quality", "intentRecognition", "IntentRecognitionAccuracy", "average", "SCALAR"),
    ("quality", "responseCompleteness", "ResponseCompleteness", "average", "SCALAR"),
    ("quality", "toolUtilization", "ToolUtilizationAccuracy", "average", "SCALAR"),
    ("reliability", "llmErrors", "LLMErrorRate", "average", "PERCENTAGE"),
    ("reliability", "toolErrors", "ToolErrorRate", "average", "PERCENTAGE"),
    ("cost", "totalCost", "Cost", "sum", "USD"),
    ("cost", "meanCost", "Cost", "average", "USD"),
    ("llm", "workflowEfficiency", "WorkflowEfficiency", "average", "SCALAR"),
    ("conversation", "cycles", "CyclesCount", "sum", "SCALAR"),
    ("quality", "answerCorrectness", "AnswerCorrectness", "average", "PERCENTAGE"),
    ("quality", "answerCoherence", "Coherence", "average", "PERCENTAGE"),
    ("quality", "agentTonality", "Tonality", "average", "PERCENTAGE"),
    ("quality", "generalStructureAndStyle", "GeneralStructureAndStyle", "average", "PERCENTAGE"),
    ("quality", "overallTaskCompletion", "TaskCompletion", "average", "PERCENTAGE"),
    ("reliability", "successRate", "SuccessRate", "average", "PERCENTAGE"),
    ("reliability", "recoveryRate", "RecoveryRate", "average", "PERCENTAGE"),
    ("reliability", "retryRate", "RetryRate", "average", "PERCENTAGE"),
    ("reliability", "agentFailureCount", "AgentFailureCount", "sum", "SCALAR"),
    ("reliability", "agentRecoveryCount", "AgentRecoveryCount", "sum", "SCALAR"),
    ("reliability", "agentRecoveryRate", "AgentRecoveryRate", "average", "PERCENTAGE"),
    ("reliability", "agentAvailability", "AgentAvailability", "average", "PERCENTAGE"),
    ("reliability", "bias", "Bias", "average", "PERCENTAGE"),
    ("reliability", "toxicity", "Toxicity", "average", "PERCENTAGE"),
    ("reliability", "policyViolation", "PolicyViolation", "average", "PERCENTAGE"),
    ("cost", "totalLLMCost", "LLMCost", "sum", "DOLLAR"),
    ("cost", "totalToolCost", "ToolCost", "sum", "DOLLAR"),
    ("cost", "averageLLMCost", "LLMCost", "average", "DOLLAR"),
    ("cost", "averageToolCost", "ToolCost", "average", "DOLLAR"),
    ("cost", "numberOfLLMCalls", "LLMCalls", "sum", "SCALAR"),
    ("cost", "numberOfToolCalls", "ToolCalls", "sum", "SCALAR"),
    ("llm", "totalLLMCost", "LLMCost", "sum", "DOLLAR"),
    ("llm", "totalTokens", "TotalTokens", "sum", "SCALAR"),
    ("llm", "inputTokens", "InputTokens", "sum", "SCALAR"),
    ("llm", "outputTokens", "OutputTokens", "sum", "SCALAR"),
    ("llm", "inferenceDuration", "InferenceDuration", "average", "MILLISECONDS"),
    ("llm", "answerCorrectness", "AnswerCorrectness", "average", "PERCENTAGE"),
    ("llm", "answerRelevancy", "AnswerRelevancy", "average", "PERCENTAGE"),
    ("llm", "answerFaithfulness", "Faithfulness", "average", "PERCENTAGE"),
    ("llm", "answerGroundedness", "Groundedness", "average", "PERCENTAGE"),
    ("llm", "coherence", "Coherence", "average", "PERCENTAGE"),
    ("llm", "tonality", "Tonality", "average", "PERCENTAGE"),
    ("llm", "generalStructureStyleMetric", "GeneralStructureAndStyle", "average", "PERCENTAGE"),
    ("llm", "uncertaintyScore", "UncertaintyScore", "average", "PERCENTAGE"),
    ("llm", "llmSuccessRate", "LLMSuccessRate", "average", "PERCENTAGE"),
    ("llm", "llmErrorRate", "LLMErrorRate", "average", "PERCENTAGE"),
    ("llm", "llmRetryRate", "LLMRetryRate", "average", "PERCENTAGE"),
    ("llm", "llmRecoveryRate", "LLMRecoveryRate", "average", "PERCENTAGE"),
    ("llm", "piiDetection", "PIIDetection", "average", "PERCENTAGE"),
    ("llm", "bias", "Bias", "average", "PERCENTAGE"),
    ("llm", "toxicity", "Toxicity", "average", "PERCENTAGE"),
    ("llm", "policyViolation", "PolicyViolation", "average", "PERCENTAGE"),
    ("conversation", "relevancy", "AnswerRelevancy", "average", "PERCENTAGE"),
    ("conversation", "completeness", "ResponseCompleteness", "average", "PERCENTAGE"),
    ("conversation", "roleAdherence", "RoleAdherence", "average", "PERCENTAGE"),
    ("conversation", "topicAdherence", "TopicAdherence", "average", "PERCENTAGE"),
    ("conversation", "contextPreservation", "ContextPreservation", "average", "PERCENTAGE"),
    ("conversation", "intentRecognitionAccuracy", "IntentRecognitionAccuracy", "average", "PERCENTAGE"),
    ("conversation", "workflowCohesionIndex", "WorkflowCohesionIndex", "average", "PERCENTAGE"),
    ("conversation", "goalSuccessRate", "GoalSuccessRate", "average", "PERCENTAGE"),
]


def metric_charts(points: DataFrame, by: list[str], charts: list[tuple] = CHARTS) -> DataFrame:
    """All series of all charts at once: one bucketed aggregate, unpacked through the chart list."""
    listed = points.sparkSession.createDataFrame(charts, "chart string, series string, metric string, operation string, unit string")
    bounds = period_bounds(points, by)
    slotted = in_period(points, bounds, by).groupBy(*by, "metric", "period").agg(
        F.sum("result").alias("s"), F.avg("result").alias("m"), F.count_distinct("session_key").alias("n_sessions"))
    spine = bounds.select(*by, F.explode(F.sequence(F.lit(0), F.lit(PERIODS - 1)).cast("array<bigint>")).alias("period"))
    packed = listed.agg(F.array_sort(F.collect_list(F.struct("chart", "series", "metric", "operation", "unit"))).alias("l")).scalar()
    rows = spine.withColumn("_l", packed).select(*by, "period", F.inline("_l")).join(slotted, [*by, "metric", "period"], "left")
    value = F.when(F.col("operation") == "sum", F.col("s")).otherwise(F.col("m"))
    return rows.select(*by, "chart", "series", "period", F.coalesce(value, F.lit(0.0)).alias("value"), F.coalesce("n_sessions", F.lit(0)).alias("n_sessions"), "unit")


def performance_cards(spans: DataFrame, documents: DataFrame, by: list[str]) -> DataFrame:
    """Errors of the documents, and the 90th and 95th duration by sorted index."""
    at = lambda q: lambda n: F.least(F.floor(n * F.lit(q)), n - 1) + 1
    found = spans.where(has_suffix("span_name", "agent")).select(*by, "duration")
    return rank_select(found, by, "duration", {"p90": at(0.9), "p95": at(0.95)}).drop("n").join(documents, by, "left").na.fill(0)


def performance_series(points: DataFrame, by: list[str], documents: DataFrame) -> DataFrame:
    """Per period: mean latency, throughput, error rate; ratios are 0 where nothing was measured."""
    sums = bucketed_values(points, by, documents, {c: "sum" for c in ("duration", "calls", "fails")} | {"latency": "avg"})
    safe = lambda a, b, f=1.0: F.when(F.col(b) > 0, F.col(a) / F.col(b) * f).otherwise(0.0)
    return sums.select(*by, "period", "n_sessions", "latency", safe("calls", "duration", 1000.0).alias("throughput"), safe("fails", "calls").alias("error_rate"))


# -- latent space ---------------------------------------------------------------------------


def principal_axes(vectors: DataFrame, n: int = 2) -> tuple[list[float], list[list[float]]]:
    """Mean and leading axes. Only the dims x dims covariance, summed by Spark, reaches the driver."""
    rows = covariance(vectors.select(F.lit(1).alias("_g"), "vector"), ["_g"]).collect()
    dims = max(r["j"] for r in rows) + 1
    cov = np.zeros((dims, dims))
    for r in rows:
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["cov"]
    _, vecs = np.linalg.eigh(cov)
    axes = [vecs[:, -1 - i] for i in range(n)]
    axes = [(a if a[np.argmax(np.abs(a))] > 0 else -a).tolist() for a in axes]
    from spanloom.functions.vectors import mean_vector

    centre = mean_vector(vectors.select(F.lit(1).alias("_g"), "vector"), ["_g"], "vector").first()["centroid"]
    return list(centre), axes


def latent_space(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Two coordinates per vector, each scaled to -100..100 over all vectors."""
    from spanloom.functions.vectors import dot

    centre, axes = principal_axes(vectors)
    shift = lambda a: float(np.dot(centre, a))
    lit = lambda a: F.array(*[F.lit(float(x)) for x in a])
    xy = vectors.select(*keys, *[(dot(F.col("vector"), lit(a)) - shift(a)).alias(n) for n, a in zip("xy", axes)])
    ends = xy.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in "xy" for f in (F.min, F.max)])
    scaled = lambda c: F.when(F.col(f"max_{c}") > F.col(f"min_{c}"), (F.col(c) - F.col(f"min_{c}")) / (F.col(f"max_{c}") - F.col(f"min_{c}")) * 200 - 100).otherwise(0.0)
    packed = ends.select(F.struct("*").alias("e")).scalar()
    return xy.withColumn("_e", packed).select("*", "_e.*").select(*keys, scaled("x").alias("x"), scaled("y").alias("y"))
