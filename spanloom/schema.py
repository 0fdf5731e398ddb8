"""Span schema, attribute keys and the class model of the trace graph."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, types as T

# Attribute keys of the span export format.
APPLICATION = "application_id"
SESSION = "session.id"
AGENT = "agent_id"
EXECUTION_SUCCESS = "execution.success"
START_TIME = "ioa_start_time"
SESSION_ENDED = "session.ended_at"
ENTITY_NAME = "ioa_observe.entity.name"
ENTITY_DESCRIPTION = "ioa_observe.entity.description"
ENTITY_INPUT = "ioa_observe.entity.input"
ENTITY_OUTPUT = "ioa_observe.entity.output"
OWNER_SPAN = "ioa_observe.agent.span_id"
HANDOFF_SOURCES = "ioa_observe.handoff.source.span_ids"
GRAPH = "gen_ai.ioa.graph"
PROVIDER = "gen_ai.provider.name"
REQUEST_MODEL = "gen_ai.request.model"
INPUT_TOKENS = "gen_ai.usage.input_tokens"
OUTPUT_TOKENS = "gen_ai.usage.output_tokens"
TOTAL_TOKENS = "gen_ai.usage.total_tokens"
CACHE_TOKENS = "gen_ai.usage.cache_read.input_tokens"
PROMPT_TOKENS = "gen_ai.usage.prompt_tokens"
LLM_TOTAL_TOKENS = "llm.usage.total_tokens"
TEMPERATURE = "gen_ai.request.temperature"
FINISH_REASONS = "gen_ai.response.finish_reasons"
RESPONSE_ID = "gen_ai.response.id"
SYSTEM_INSTRUCTIONS = "gen_ai.system_instructions"
INPUT_MESSAGES = "gen_ai.input.messages"
OUTPUT_MESSAGES = "gen_ai.output.messages"
TOOL_ARGUMENTS = "gen_ai.tool.call.arguments"
TOOL_RESULT = "gen_ai.tool.call.result"
AGENT_START = "agent_start_event"
# Attribute keys tried in order for a span's kind, name, texts and call id.
KIND_KEYS = ["traceloop.span.kind", "ioa_observe.span.kind"]
SPAN_KINDS = ["llm", "tool", "agent", "workflow", "coordination"]
NAME_KEYS = ["traceloop.entity.name", "ioa_observe.entity.name", "tool.name"]
INPUT_KEYS = ["traceloop.entity.input", "ioa_observe.entity.input", "input.value"]
OUTPUT_KEYS = ["traceloop.entity.output", "ioa_observe.entity.output", "output.value"]
CALL_ID_KEYS = ["mas.call.id", "gen_ai.tool.call.id", "tool_call_id", "tool.call.id"]

_STR_MAP = T.MapType(T.StringType(), T.StringType())

# One line of the JSONL span export.
EXPORT_LINE = T.StructType(
    [
        T.StructField("Timestamp", T.StringType()),
        T.StructField("TraceId", T.StringType()),
        T.StructField("SpanId", T.StringType()),
        T.StructField("ParentSpanId", T.StringType()),
        T.StructField("SpanName", T.StringType()),
        T.StructField("SpanKind", T.StringType()),
        T.StructField("ServiceName", T.StringType()),
        T.StructField("ResourceAttributes", _STR_MAP),
        T.StructField("ScopeName", T.StringType()),
        T.StructField("ScopeVersion", T.StringType()),
        T.StructField("SpanAttributes", _STR_MAP),
        T.StructField("Duration", T.LongType()),
        T.StructField("StatusCode", T.StringType()),
        T.StructField("StatusMessage", T.StringType()),
        T.StructField("Events.Timestamp", T.ArrayType(T.StringType())),
        T.StructField("Events.Name", T.ArrayType(T.StringType())),
        T.StructField("Events.Attributes", T.ArrayType(_STR_MAP)),
        T.StructField("SessionId", T.StringType()),
        T.StructField("AgentId", T.StringType()),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)

# Class -> parent class.
CLASSES = {
    "Element": "", "StructuralElement": "Element", "MAS": "StructuralElement", "Agent": "StructuralElement",
    "Capability": "StructuralElement", "LLM": "Capability", "Tool": "Capability", "Processing": "Capability",
    "ExecutionElement": "Element", "Session": "ExecutionElement", "MASCall": "ExecutionElement",
    "AgentCall": "ExecutionElement", "CapabilityCall": "ExecutionElement", "LLMCall": "CapabilityCall",
    "ToolCall": "CapabilityCall", "ProcessingCall": "CapabilityCall", "TrajectoryElement": "Element",
    "State": "TrajectoryElement", "Transition": "TrajectoryElement", "SemanticElement": "Element",
    "Embedding": "SemanticElement", "TrajectoryContext": "SemanticElement", "SemanticGroup": "SemanticElement",
    "Metric": "Element", "MetricResult": "Element", "AnalysisElement": "Element",
    "SemanticAnalysisReport": "AnalysisElement", "ConsistencyReport": "SemanticAnalysisReport",
    "AnomalyReport": "SemanticAnalysisReport", "NormalBehaviourReport": "SemanticAnalysisReport",
    "CognitionProtocolReport": "Element", "CognitionProtocolExecutionReport": "Element",
    "CognitiveFailureReport": "Element", "Insight": "AnalysisElement",
}

# Edge type, domain classes, range classes.
PROPERTIES = [
    ("usesCapability", ["Agent"], ["Capability"]),
    ("usesLLM", ["Agent"], ["LLM"]),
    ("usesTool", ["Agent"], ["Tool"]),
    ("usesProcessing", ["Agent"], ["Processing"]),
    ("belongsToMAS", ["Agent"], ["MAS"]),
    ("executes", ["ExecutionElement"], ["StructuralElement"]),
    ("executesSession", ["Session"], ["MAS"]),
    ("hasMASCall", ["Session"], ["MASCall"]),
    ("executesMAS", ["MASCall"], ["MAS"]),
    ("hasAgentCall", ["MASCall"], ["AgentCall"]),
    ("executesAgent", ["AgentCall"], ["Agent"]),
    ("hasToolCall", ["AgentCall"], ["ToolCall"]),
    ("hasLLMCall", ["AgentCall"], ["LLMCall"]),
    ("hasProcessingCall", ["AgentCall", "MASCall"], ["ProcessingCall"]),
    ("executesLLM", ["LLMCall"], ["LLM"]),
    ("executesTool", ["ToolCall"], ["Tool"]),
    ("executesProcessing", ["ProcessingCall"], ["Processing"]),
    ("inputTo", ["State"], ["Transition"]),
    ("leadsTo", ["Transition"], ["State"]),
    ("representsExecution", ["Transition"], ["ExecutionElement"]),
    ("correspondsToTransition", ["ExecutionElement"], ["Transition"]),
    ("hasInitialState", ["ExecutionElement"], ["State"]),
    ("hasFinalState", ["ExecutionElement"], ["State"]),
    ("hasState", ["ExecutionElement"], ["State"]),
    ("represents", ["Embedding"], ["State"]),
    ("containsSession", ["SemanticGroup"], ["Session", "SemanticGroup"]),
    ("containsSemanticGroup", ["MAS"], ["SemanticGroup"]),
    ("ofMetricType", ["MetricResult"], ["Metric"]),
    ("measures", ["MetricResult"], ["ExecutionElement", "CognitionProtocolExecutionReport"]),
    ("aboutMetric", ["AnalysisElement"], ["Metric"]),
    ("ofSemanticGroup", ["SemanticAnalysisReport"], ["SemanticGroup"]),
    ("isAnomalous", ["Session", "MetricResult"], ["AnomalyReport"]),
    ("reportsOn", ["CognitionProtocolReport", "CognitionProtocolExecutionReport", "CognitiveFailureReport"], ["Session"]),
    ("atCall", ["CognitiveFailureReport"], ["ExecutionElement"]),
    ("concerns", ["Insight"], ["Element"]),
]

# Edges that nest one call in another.
CONTAINMENT = ["hasMASCall", "hasAgentCall", "hasToolCall", "hasLLMCall", "hasProcessingCall"]

# How many edges of a type a node of a class must have (at least, at most).
CARDINALITY = [
    ("ExecutionElement", "hasInitialState", 1, None),
    ("ExecutionElement", "hasFinalState", 1, None),
    ("ExecutionElement", "correspondsToTransition", 1, None),
    ("Session", "executesSession", 1, None),
    ("AgentCall", "executesAgent", 1, None),
    ("LLMCall", "executesLLM", 1, None),
    ("ToolCall", "executesTool", 1, None),
    ("Transition", "leadsTo", 1, None),
]

# Metric names the summaries and scores are built from.
QUALITY_METRICS = [
    "IntentRecognitionAccuracy", "Groundedness", "ToolUtilizationAccuracy", "AnswerRelevancy", "ResponseCompleteness",
]
ERROR_METRICS = ["LLMErrorRate", "ToolErrorRate"]


@lru_cache(maxsize=None)
def ancestors_of(cls: str) -> tuple[str, ...]:
    """The class and all its ancestors."""
    chain = []
    while cls:
        chain.append(cls)
        cls = CLASSES[cls]
    return tuple(chain)


def class_ancestors(spark: SparkSession) -> DataFrame:
    """(node_type, ancestor), reflexive; a fixed table of about a hundred rows."""
    rows = [(c, a) for c in CLASSES for a in ancestors_of(c)]
    return spark.createDataFrame(rows, "node_type string, ancestor string")


def property_rules(spark: SparkSession, side: str) -> DataFrame:
    """(edge_type, allowed) for ``side`` in domain, range."""
    at = 1 if side == "domain" else 2
    rows = [(p[0], a) for p in PROPERTIES for a in p[at]]
    return spark.createDataFrame(rows, "edge_type string, allowed string")


def values_sql(rows: list[tuple], columns: str) -> str:
    """A constant table as SQL text, for oracles."""
    def lit(v):
        return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({columns}))"
