"""Reads over raw spans: filter, project, group, sort, top-k.

Every function takes the span table and returns a DataFrame over all sessions at once; optional
arguments become filters only when given, so Catalyst can push them to the scan.
"""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame, functions as F

from spanloom import schema as keys
from spanloom.functions.ordered import rank_select
from spanloom.functions.scalar import attr, base_name, has_suffix, number_or_zero, session_key, text


def narrowed(
    spans: DataFrame,
    *,
    start=None,
    end=None,
    application: str | None = None,
    sessions: Seq[str] | None = None,
    agent: str | None = None,
) -> DataFrame:
    """Apply whichever filters are given."""
    if start is not None:
        spans = spans.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        spans = spans.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    if application is not None:
        spans = spans.where(F.lower(F.col("application_id")) == application.lower())
    if sessions is not None:
        spans = spans.where(F.col("session_id").isin(list(sessions)))
    if agent is not None:
        spans = spans.where(base_name("agent_id") == agent)
    return spans


def page(df: DataFrame, order: Seq[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """Sort, then cut a page when one is asked for."""
    df = df.orderBy(*order)
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def tokens() -> Column:
    """Input plus output tokens of one span; anything not numeric counts as 0."""
    return number_or_zero(attr(keys.INPUT_TOKENS)) + number_or_zero(attr(keys.OUTPUT_TOKENS))


def is_error() -> Column:
    return F.col("status_code") == "Error"


# -- sessions, applications, traces ---------------------------------------------------------


def session_spans(
    spans: DataFrame, sessions=None, kinds: Seq[str] = (), descending=False, limit=None, offset=0
) -> DataFrame:
    """Spans of sessions in time order, optionally only some kinds."""
    spans = narrowed(spans, sessions=sessions)
    if kinds:
        spans = spans.where(F.coalesce(*[F.nullif(has_suffix("span_name", k), F.lit(False)) for k in kinds], F.lit(False)))
    order = [F.col("ts"), F.col("span_id")]
    return page(spans, [c.desc() if descending else c.asc() for c in order], limit, offset)


def distinct_ids(spans: DataFrame, column: str = "session_id", **filters) -> DataFrame:
    """Non-empty ids with their first activity, newest first."""
    found = narrowed(spans, **filters).where(F.col(column) != "")
    return found.groupBy(column).agg(F.min("ts").alias("first_ts")).orderBy(F.desc("first_ts"), column)


def traces(spans: DataFrame, limit=None, offset=0, **filters) -> DataFrame:
    per_trace = (
        narrowed(spans, **filters).where(F.col("trace_id") != "")
        .groupBy("trace_id")
        .agg(F.min(F.col("application_id")).alias("application_id"), F.min(F.col("ts")).alias("first_ts"), F.max(F.col("ts")).alias("last_ts"))
    )
    return page(per_trace, [F.desc("first_ts"), F.col("trace_id")], limit, offset)


def session_summaries(spans: DataFrame, limit=None, offset=0, **filters) -> DataFrame:
    found = narrowed(spans, **filters).where((F.col("session_id") != "") & (F.col("application_id") != ""))
    per = found.groupBy("session_id", "application_id").agg(
        F.min(F.col("ts")).alias("first_ts"), F.max(F.col("ts")).alias("last_ts"), F.count(F.lit(1)).alias("n_spans")
    )
    return page(per, [F.desc("first_ts"), F.col("session_id")], limit, offset)


def application_list(spans: DataFrame, **filters) -> DataFrame:
    found = narrowed(spans, **filters).where(F.col("application_id") != "")
    return found.groupBy("application_id").agg(
        F.min(F.col("ts")).alias("first_ts"), F.max(F.col("ts")).alias("last_ts")
    ).orderBy(F.desc("last_ts"), "application_id")


def application_sessions(spans: DataFrame, **filters) -> DataFrame:
    """One row per (application, session); the session id may be empty."""
    found = narrowed(spans, **filters).where(F.col("application_id") != "")
    return found.groupBy("application_id", "session_id").agg(F.max(F.col("ts")).alias("last_ts")).orderBy(
        F.desc("last_ts"), "session_id"
    )


def application_overview(spans: DataFrame, start=None, end=None) -> DataFrame:
    """Sessions with token sums, and the agents and models of their application.

    The token sum ignores the time range, as a session's cost does not depend on the view. The
    application side has one row per application and is joined to one row per session.
    """
    in_range = narrowed(spans, start=start, end=end).where(F.col("application_id") != "")
    chat = has_suffix("span_name", "chat")
    model = text(attr(keys.REQUEST_MODEL))
    sessions = (
        in_range.where(F.col("session_id") != "").groupBy("application_id", "session_id").agg(F.max(F.col("ts")).alias("last_ts"))
    )
    per_session = (
        spans.where((F.col("session_id") != "") & chat).groupBy("session_id").agg(F.sum(tokens()).alias("total_tokens"))
    )
    per_app = in_range.groupBy("application_id").agg(
        F.collect_set(F.nullif(base_name("agent_id"), F.lit(""))).alias("agents"),
        F.collect_set(F.when(chat, F.nullif(model, F.lit("")))).alias("llms"),
    )
    return (
        sessions.join(per_session, "session_id", "left")
        .join(per_app, "application_id", "left")
        .select("application_id", "session_id", "last_ts", "total_tokens", "agents", "llms")
        .orderBy(F.desc("last_ts"), "session_id")
    )


def graph_sessions(spans: DataFrame, **filters) -> DataFrame:
    """Sessions that have a declared-graph span."""
    found = narrowed(spans, **filters).where(F.col("span_name").contains(".graph") & (F.col("session_id") != ""))
    return found.groupBy("session_id", "application_id").agg(
        F.min(F.col("ts")).alias("first_ts"), F.max(F.col("ts")).alias("last_ts")
    ).orderBy(F.desc("first_ts"), "session_id")


def sessions_of_agents(spans: DataFrame, **filters) -> DataFrame:
    """Distinct sessions per (application, agent)."""
    return (
        narrowed(spans, **filters).where(F.col("session_id") != "")
        .select("application_id", base_name("agent_id").alias("agent"), "session_id").distinct()
    )


def root_span_range(spans: DataFrame, by: Seq[str] = (), **filters) -> DataFrame:
    """First and last time over root spans."""
    roots = narrowed(spans, **filters).where(F.col("parent_span_id") == "")
    return roots.groupBy(*by).agg(F.min(F.col("ts")).alias("first_ts"), F.max(F.col("ts")).alias("last_ts"))


# -- agents and models ----------------------------------------------------------------------


def session_agents(spans: DataFrame, limit=None, offset=0, **filters) -> DataFrame:
    """Agent spans as listed, duplicates kept."""
    found = narrowed(spans, **filters).where(has_suffix("span_name", "agent"))
    rows = found.select("session_id", F.col("span_name").alias("agent"), "ts", "span_id")
    return page(rows, [F.col("ts"), F.col("span_id")], limit, offset)


def model_names(spans: DataFrame, **filters) -> DataFrame:
    model = text(attr(keys.REQUEST_MODEL))
    found = narrowed(spans, **filters).where(has_suffix("span_name", "chat") & (model != ""))
    return found.select("application_id", model.alias("model")).distinct()


def agent_names(spans: DataFrame, **filters) -> DataFrame:
    found = narrowed(spans, **filters).where(base_name("agent_id") != "")
    return found.select("application_id", base_name("agent_id").alias("agent")).distinct()


def span_detail(spans: DataFrame, span_id: str | None = None) -> DataFrame:
    """Attributes and event names of a span (of every span when none is named)."""
    if span_id is not None:
        spans = spans.where(F.col("span_id") == span_id)
    return spans.select("span_id", "attrs", "events")


def agent_spans(spans: DataFrame, **filters) -> DataFrame:
    """Spans of agents, without the ones of their constructor."""
    return narrowed(spans, **filters).where(~F.col("span_name").contains("__init_run"))


def agent_start_events(spans: DataFrame, **filters) -> DataFrame:
    """Start events unpacked: agent and description."""
    events = narrowed(spans, **filters).where(F.col("span_name").contains(keys.AGENT_START)).select(
        "session_id", "application_id", "span_id", F.explode("events").alias("e")
    )
    return events.where(F.col("e.name") == keys.AGENT_START).select(
        "session_id", "application_id", "span_id", F.col("e.ts").alias("ts"),
        text(F.col("e.attributes").getItem("agent_id")).alias("agent_id"),
        text(F.col("e.attributes").getItem("description")).alias("description"),
    )


def agent_descriptions(spans: DataFrame, **filters) -> DataFrame:
    """First description each agent announced per application."""
    started = agent_start_events(spans, **filters).withColumn("agent", base_name("agent_id"))
    return started.groupBy("application_id", "agent").agg(
        F.min_by("description", F.struct("ts", "span_id")).alias("description")
    )


def agent_tokens(spans: DataFrame, **filters) -> DataFrame:
    """Token sums and models per (session, agent) over chat spans."""
    chat = narrowed(spans, **filters).where(has_suffix("span_name", "chat"))
    return chat.groupBy("session_id", base_name("agent_id").alias("agent")).agg(
        F.sum(number_or_zero(attr(keys.INPUT_TOKENS))).alias("input_tokens"),
        F.sum(number_or_zero(attr(keys.OUTPUT_TOKENS))).alias("output_tokens"),
        F.collect_set(attr(keys.REQUEST_MODEL)).alias("models"),
    )


def agent_costs(spans: DataFrame, prices: DataFrame, default_model: str, **filters) -> DataFrame:
    """Priced token use per (application, agent): tokens meet the price list only once summed."""
    chat = narrowed(spans, **filters).where(has_suffix("span_name", "chat"))
    used = chat.groupBy("application_id", base_name("agent_id").alias("agent"), attr(keys.REQUEST_MODEL).alias("model")).agg(
        F.sum(number_or_zero(attr(keys.INPUT_TOKENS))).alias("input_tokens"),
        F.sum(number_or_zero(attr(keys.OUTPUT_TOKENS))).alias("output_tokens"),
    )
    from spanloom.operators.session_metrics import with_prices

    priced = with_prices(used, prices, default_model)
    return priced.groupBy("application_id", "agent").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")).alias("cost"),
    )


def agent_activity(spans: DataFrame, **filters) -> DataFrame:
    """Per (application, agent): spans, failures, sessions, mean duration of agent spans."""
    found = narrowed(spans, **filters).where(base_name("agent_id") != "")
    return found.groupBy("application_id", base_name("agent_id").alias("agent")).agg(
        F.count(F.lit(1)).alias("n_spans"),
        F.count_if(is_error()).alias("n_failures"),
        F.count_distinct(F.nullif(F.col("session_id"), F.lit(""))).alias("n_sessions"),
        F.avg(F.when(has_suffix("span_name", "agent"), F.col("duration"))).alias("mean_duration"),
    )


def top_agent(spans: DataFrame, n: int = 1, **filters) -> DataFrame:
    """Agents with the most spans; names break ties."""
    found = narrowed(spans, **filters).where(base_name("agent_id") != "")
    counts = found.groupBy(base_name("agent_id").alias("agent")).agg(F.count(F.lit(1)).alias("n_spans"))
    return counts.orderBy(F.desc("n_spans"), "agent").limit(n)


def agents_per_session(spans: DataFrame, **filters) -> DataFrame:
    found = narrowed(spans, **filters).where((F.col("session_id") != "") & (base_name("agent_id") != ""))
    return found.select("session_id", base_name("agent_id").alias("agent")).distinct()


def agent_duration_percentiles(spans: DataFrame, by: Seq[str] = ("application_id",), **filters) -> DataFrame:
    """Durations at sorted index int(n*q), capped at the last: not an interpolated quantile."""
    found = narrowed(spans, **filters).where(has_suffix("span_name", "agent"))
    at = lambda q: lambda n: F.least(F.floor(n * F.lit(q)), n - 1) + 1
    return rank_select(found.select(*by, "duration"), list(by), "duration", {"p90": at(0.9), "p95": at(0.95)})


# -- counts and sums ------------------------------------------------------------------------


def span_counts(spans: DataFrame, by: Seq[str] = (), **filters) -> DataFrame:
    """All counters in one pass: spans, model calls, tool calls, errors, conversations, agents."""
    chat = has_suffix("span_name", "chat")
    return narrowed(spans, **filters).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_spans"),
        F.count_if(chat).alias("n_llm"),
        F.count_if(has_suffix("span_name", "tool")).alias("n_tool"),
        F.count_if(is_error()).alias("n_errors"),
    )


def conversation_count(spans: DataFrame, by: Seq[str] = (), **filters) -> DataFrame:
    """Distinct (agent, session) pairs over chat spans that have a session."""
    found = narrowed(spans, **filters).where(has_suffix("span_name", "chat") & (F.col("session_id") != ""))
    pairs = found.select(*by, base_name("agent_id").alias("agent"), "session_id").distinct()
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_conversations"))


def agent_count(spans: DataFrame, by: Seq[str] = (), **filters) -> DataFrame:
    found = narrowed(spans, **filters).where(base_name("agent_id") != "")
    return found.groupBy(*by).agg(F.count_distinct(base_name("agent_id")).alias("n_agents"))


def mean_session_duration(spans: DataFrame, by: Seq[str] = (), **filters) -> DataFrame:
    """(last - first) seconds per session, then the mean."""
    found = narrowed(spans, **filters).where(F.col("session_id") != "")
    per = found.groupBy(*by, "session_id").agg(F.min(F.col("ts")).alias("a"), F.max(F.col("ts")).alias("b"))
    seconds = (F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / 1e6
    return per.groupBy(*by).agg(F.avg(seconds).alias("mean_seconds"))


def token_sums(spans: DataFrame, by: Seq[str] = ("session_id",), **filters) -> DataFrame:
    chat = narrowed(spans, **filters).where(has_suffix("span_name", "chat"))
    return chat.groupBy(*by).agg(F.sum(tokens()).alias("tokens"))


def llm_spans(spans: DataFrame, sessions: Seq[str] | None = None) -> DataFrame:
    """Chat spans and spans with any token attribute, keyed by the plain session id.

    The key is normalised once per row, so a lookup is an equality and not a LIKE.
    """
    filled = [text(attr(k)) != "" for k in (keys.PROMPT_TOKENS, keys.INPUT_TOKENS, keys.LLM_TOTAL_TOKENS)]
    raw = F.coalesce(F.nullif(F.col("session_id"), F.lit("")), attr(keys.SESSION), F.lit(""))
    found = spans.where(has_suffix("span_name", "chat") | filled[0] | filled[1] | filled[2])
    found = found.withColumn("session_key", session_key(raw, F.col("application_id")))
    return found if sessions is None else found.where(F.col("session_key").isin(list(sessions)))


def tool_details(spans: DataFrame, by: Seq[str] = (), **filters) -> DataFrame:
    """Per tool: success rate, distinct sessions, mean milliseconds."""
    found = narrowed(spans, **filters).where(has_suffix("span_name", "tool"))
    return found.groupBy(*by, base_name("span_name").alias("tool")).agg(
        F.avg(F.when(is_error(), 0.0).otherwise(1.0)).alias("success"),
        F.count_distinct("session_id").alias("n_sessions"),
        F.avg(F.col("duration") / 1e6).alias("mean_ms"),
    )


def frequent_errors(spans: DataFrame, by: Seq[str] = (), n: int | None = None, **filters) -> DataFrame:
    """Error texts by count. An empty message is not NULL, so it hides the span name."""
    message = F.coalesce(F.col("status_message"), F.col("span_name"))
    found = narrowed(spans, **filters).where(is_error() & (message != ""))
    counts = found.groupBy(*by, message.alias("error")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.orderBy(F.desc("n"), "error")
    return counts if n is None else counts.limit(n)


# -- classification and duplicates ----------------------------------------------------------


def span_type(name: Column, attrs: Column) -> Column:
    """Kind by suffix, else by the kind attribute, else by the keys present."""
    kind = F.lower(F.coalesce(*[F.nullif(attrs.getItem(k), F.lit("")) for k in keys.KIND_KEYS], F.lit("")))
    filled = lambda key: F.coalesce(attrs.getItem(key), F.lit("")) != ""
    return (
        F.when(name.endswith(".chat") | name.endswith(".llm"), "llm")
        .when(name.endswith(".tool"), "tool")
        .when(name.endswith(".agent"), "agent")
        .when(name.endswith(".workflow"), "workflow")
        .when(kind.isin(*keys.SPAN_KINDS), kind)
        .when(F.exists(F.map_keys(attrs), lambda k: k.startswith("gen_ai.prompt.")), "llm")
        .when(filled(keys.REQUEST_MODEL) | filled("gen_ai.system"), "llm")
        .when(filled("tool.name"), "tool")
        .otherwise("other")
    )


def _prefixed(prefix: str) -> Column:
    """All attributes under a prefix as one text, in key order; empty when there are none."""
    entries = F.filter(F.map_entries("attrs"), lambda e: e["key"].startswith(prefix))
    return F.array_join(
        F.transform(F.array_sort(entries), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "\x1e"
    )


def content_fingerprint() -> Column:
    """What a re-exported span shares with its first export: who did it, the call id, all content.

    A span without any content only equals itself (same id, name and time).
    """
    one = lambda names: F.coalesce(*[F.nullif(attr(n), F.lit("")) for n in names], F.lit(""))
    parts = [
        one(keys.INPUT_KEYS), one(keys.OUTPUT_KEYS), _prefixed("gen_ai.prompt."), _prefixed("gen_ai.completion."),
        text(attr(keys.INPUT_MESSAGES)), text(attr(keys.OUTPUT_MESSAGES)),
    ]
    agent = F.coalesce(F.nullif(one(["mas.agent.id", "agent.id", "application_id"]), F.lit("")), text(F.col("service_name")))
    who = [one(keys.KIND_KEYS), one(keys.NAME_KEYS), agent, one(keys.CALL_ID_KEYS)]
    bare = [F.lit("no-content"), F.col("span_id"), F.col("span_name"), F.unix_micros(F.col("ts").cast("timestamp")).cast("string")]
    content = F.concat_ws("|", *who, *[F.sha2(p, 256) for p in parts])
    return F.sha2(F.when(F.concat(*parts) == "", F.concat_ws("|", *bare)).otherwise(content), 256)


def first_exports(spans: DataFrame) -> DataFrame:
    """Keep the first span of every (session, fingerprint): a partial ``min`` instead of a window."""
    marked = spans.withColumn("fingerprint", content_fingerprint())
    return marked.groupBy("session_id", "fingerprint").agg(
        F.min(F.struct("ts", "span_id")).alias("_first"), F.count(F.lit(1)).alias("copies")
    ).select("session_id", "fingerprint", "_first.ts", "_first.span_id", "copies")
