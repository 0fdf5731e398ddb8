"""Spans -> typed nodes and edges, for all sessions in one job.

Every span becomes one row of ``calls``; the nodes and edges a call brings with it are unpacked
from that row with ``inline``, so the call table is read once per output and not once per node
type. Only what spans several calls (owners, handoffs, chains, containers) needs joins or windows.
Order within a session is (start, span id).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from spanloom import schema as keys
from spanloom.functions.ordered import Sequence
from spanloom.functions.scalar import (
    NO_CONTENT, attr, epoch_seconds, first_filled, has_suffix, int_or_zero, number_or_zero, session_key, short_id, text,
)

NODE_COLUMNS = {
    "node_type": "string", "id": "string", "name": "string", "session_id": "string", "start_time": "double",
    "end_time": "double", "duration": "double", "success": "boolean", "span_id": "string", "parent_span_id": "string",
    "description": "string", "declared": "boolean", "provider": "string", "prompt_tokens": "bigint",
    "completion_tokens": "bigint", "total_tokens": "bigint", "cache_tokens": "bigint", "temperature": "double",
    "finish_reason": "string", "response_id": "string", "content": "string",
}
EDGE_COLUMNS = ["edge_type", "from_id", "to_id"]


def node(**given: Column) -> Column:
    """A node as a struct; columns not given are NULL."""
    return F.struct(*[
        (given[c] if c in given else F.lit(None)).cast(t).alias(c) for c, t in NODE_COLUMNS.items()
    ])


def edge(kind: str, source: Column, target: Column) -> Column:
    return F.struct(F.lit(kind).alias("edge_type"), source.alias("from_id"), target.alias("to_id"))


def unpack(df: DataFrame, *items: Column) -> DataFrame:
    """One output row per non-NULL item."""
    return df.select(F.inline(F.filter(F.array(*items), lambda x: x.isNotNull())))


# -- 1. fields ------------------------------------------------------------------------------


def fields(spans: DataFrame) -> DataFrame:
    """Columns read off each span: application, session, agent, success, start, end, duration."""
    application = first_filled(attr(keys.APPLICATION), F.col("service_name"))
    raw_session = first_filled(F.col("session_id"), attr(keys.SESSION))
    declared = F.nullif(attr(keys.EXECUTION_SUCCESS), F.lit(""))
    start = F.coalesce(attr(keys.START_TIME).try_cast("double"), epoch_seconds(F.col("ts")), F.lit(0.0))
    named = spans.select(
        "span_id", "span_name", "attrs", "status_code", "parent_span_id",
        application.alias("application"), raw_session.alias("raw_session"),
        first_filled(F.col("agent_id"), attr(keys.AGENT)).alias("agent"),
        F.when(declared.isNotNull(), F.lower(F.trim(declared)) == "true")
        .otherwise(F.lower(F.trim(text(F.col("status_code")))) != "error").alias("success"),
        start.alias("start"),
        (F.coalesce("duration", F.lit(0)) / 1e6).alias("duration_ms"),
        (start + F.coalesce("duration", F.lit(0)) / 1e9).alias("end"),
    )
    return named.withColumn("session", session_key(F.col("raw_session"), F.col("application"))).drop("raw_session")


def calls(spans: DataFrame) -> DataFrame:
    """Agent, model and tool calls with ids of the call, of what it executes and of its states."""
    name = F.col("span_name")
    kind = (
        F.when(name.endswith(".agent"), "agent").when(name.endswith(".chat"), "llm").when(name.endswith(".tool"), "tool")
    )
    entity = text(attr(keys.ENTITY_NAME))
    provider, model = text(attr(keys.PROVIDER)), text(attr(keys.REQUEST_MODEL))
    system, messages = text(attr(keys.SYSTEM_INSTRUCTIONS)), text(attr(keys.INPUT_MESSAGES))
    prompt = F.when(system == "", messages).when(messages == "", system).otherwise(
        F.concat(system, F.lit("\n\n"), messages)
    )
    by_kind = lambda a, l, t: F.when(kind == "agent", a).when(kind == "llm", l).otherwise(t)
    valid = by_kind(F.col("agent") != "", (provider != "") | (model != ""), entity != "")
    span = F.col("span_id")
    rows = fields(spans.where(has_suffix("span_name", "agent") | has_suffix("span_name", "chat") | has_suffix("span_name", "tool")))
    rows = rows.where(valid).select(
        "session", "application", "agent", "success", "start", "end", "duration_ms", "span_id", "parent_span_id",
        kind.alias("kind"), provider.alias("provider"), model.alias("model"), entity.alias("entity"),
        text(attr(keys.ENTITY_DESCRIPTION)).alias("description"),
        by_kind(
            short_id("agentcall", F.col("agent"), span), short_id("llmcall", provider, model, span),
            short_id("toolcall", entity, span),
        ).alias("call_id"),
        by_kind(F.col("agent"), F.concat_ws("-", F.lit("llm"), provider, model), entity).alias("target"),
        by_kind(
            text(attr(keys.ENTITY_INPUT)), prompt, first_filled(attr(keys.TOOL_ARGUMENTS), attr(keys.ENTITY_INPUT))
        ).alias("in_text"),
        by_kind(
            text(attr(keys.ENTITY_OUTPUT)), text(attr(keys.OUTPUT_MESSAGES)),
            first_filled(attr(keys.TOOL_RESULT), attr(keys.ENTITY_OUTPUT)),
        ).alias("out_text"),
        text(attr(keys.OWNER_SPAN)).alias("owner_span"),
        F.when(kind == "agent", F.from_json(attr(keys.HANDOFF_SOURCES), "array<string>")).alias("sources"),
        *[
            F.when(kind == "llm", f(attr(k))).alias(c)
            for c, k, f in [
                ("prompt_tokens", keys.INPUT_TOKENS, int_or_zero), ("completion_tokens", keys.OUTPUT_TOKENS, int_or_zero),
                ("total_tokens", keys.TOTAL_TOKENS, int_or_zero), ("cache_tokens", keys.CACHE_TOKENS, int_or_zero),
                ("temperature", keys.TEMPERATURE, number_or_zero), ("finish_reason", keys.FINISH_REASONS, text),
                ("response_id", keys.RESPONSE_ID, text),
            ]
        ],
    )
    rows = rows.withColumns({
        "initial": short_id("state", span, F.lit("initial"), F.col("in_text")),
        "final": short_id("state", span, F.lit("final"), F.col("out_text")),
        "transition": short_id("transition", span, F.col("in_text"), F.col("out_text")),
    })
    return rows.dropDuplicates(["session", "call_id"])


# -- 2. what one call brings with it --------------------------------------------------------


def call_nodes(c: DataFrame) -> DataFrame:
    """The call, its two states and its transition."""
    kind, span = F.col("kind"), F.col("span_id")
    label = (
        F.when(kind == "agent", F.concat(F.col("agent"), F.lit(" call "), span))
        .when(kind == "llm", F.concat(F.lit("LLM call ("), "provider", F.lit("/"), "model", F.lit(") "), span))
        .otherwise(F.concat(F.lit("Tool call ("), "entity", F.lit(") "), span))
    )
    session = F.col("session")
    call = node(
        node_type=F.when(kind == "agent", "AgentCall").when(kind == "llm", "LLMCall").otherwise("ToolCall"),
        id=F.col("call_id"), name=label, session_id=session, start_time=F.col("start"), end_time=F.col("end"),
        duration=F.col("duration_ms"), success=F.col("success"), span_id=span, parent_span_id=F.col("parent_span_id"),
        **{n: F.col(n) for n in (
            "prompt_tokens", "completion_tokens", "total_tokens", "cache_tokens", "temperature", "finish_reason", "response_id")},
    )
    content = lambda t: F.when(F.col(t) == "", NO_CONTENT).otherwise(F.col(t))
    state = lambda i, t: node(node_type=F.lit("State"), id=F.col(i), session_id=session, content=content(t))
    step = node(node_type=F.lit("Transition"), id=F.col("transition"), session_id=session)
    return unpack(c, call, state("initial", "in_text"), state("final", "out_text"), step)


def state_edges(owner: Column, initial: Column, final: Column, transition: Column) -> list[Column]:
    """The eight edges every execution element has."""
    return [
        edge("hasInitialState", owner, initial), edge("hasState", owner, initial), edge("hasFinalState", owner, final),
        edge("hasState", owner, final), edge("inputTo", initial, transition), edge("leadsTo", transition, final),
        edge("correspondsToTransition", owner, transition), edge("representsExecution", transition, owner),
    ]


def call_edges(c: DataFrame) -> DataFrame:
    call, target, kind = F.col("call_id"), F.col("target"), F.col("kind")
    return unpack(
        c,
        F.when(kind == "agent", edge("executesAgent", call, target))
        .when(kind == "llm", edge("executesLLM", call, target)).otherwise(edge("executesTool", call, target)),
        F.when((kind == "agent") & (F.col("application") != ""),
               edge("hasAgentCall", F.concat(F.lit("mascall:"), "session"), call)),
        *state_edges(call, F.col("initial"), F.col("final"), F.col("transition")),
    )


# -- 3. structure shared between calls ------------------------------------------------------


def shared_structure(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Agents, models and tools named by calls, first seen wins; and who uses what.

    One row per (kind, target, agent, application) leaves the map side, whatever the call count.
    """
    first = F.struct("start", "span_id")
    seen = c.groupBy("kind", "target", "agent", "application").agg(
        F.min(F.struct(
            F.col("start"), F.col("span_id"), F.col("entity"), F.col("model"), F.col("provider"), F.col("description")
        )).alias("f")
    )
    merged = seen.groupBy("kind", "target").agg(F.min("f").alias("f"))
    kind, target = F.col("kind"), F.col("target")
    nodes = unpack(merged, node(
        node_type=F.when(kind == "agent", "Agent").when(kind == "llm", "LLM").otherwise("Tool"), id=target,
        name=F.when(kind == "llm", F.coalesce(F.nullif("f.model", F.lit("")), target))
        .otherwise(F.coalesce(F.nullif("f.entity", F.lit("")), target)),
        description=F.when(kind != "llm", F.col("f.description")),
        provider=F.when(kind == "llm", F.col("f.provider")), declared=F.when(kind != "llm", F.lit(False)),
    ))
    edges = unpack(
        seen,
        F.when((kind == "agent") & (F.col("application") != ""), edge("belongsToMAS", target, F.col("application"))),
        F.when(kind == "llm", edge("usesLLM", F.col("agent"), target)),
        F.when(kind == "tool", edge("usesTool", F.col("agent"), target)),
    ).distinct()
    return nodes, edges


def containers(spans: DataFrame, c: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions, MAS calls and applications: nodes, edges, and applications as (id, name, declared).

    A session is created by its first start marker or agent call, and updated by end markers that
    come later; the last of those wins.
    """
    marks = fields(spans.where(F.col("span_name").isin("session.start", "session.end"))).where("session <> ''")
    columns = ["session", "application", "start", "span_id", "success", "parent_span_id", "role", "ended"]
    marks = marks.select(
        *columns[:6], F.when(F.col("span_name") == "session.start", "start").otherwise("end").alias("role"),
        F.coalesce(F.nullif(number_or_zero(attr(keys.SESSION_ENDED)), F.lit(0.0)), F.col("start")).alias("ended"))
    agents = c.where("kind = 'agent' AND application <> ''").select(
        "session", "application", "start", "span_id", F.lit(None).cast("boolean").alias("success"),
        F.lit(None).cast("string").alias("parent_span_id"), F.lit("agent").alias("role"), F.lit(None).cast("double").alias("ended"))
    seen = F.struct("start", "span_id", "application", "success", "parent_span_id", (F.col("role") == "start").alias("marked"), "ended")
    role = F.col("role")
    per_app = marks.unionByName(agents).groupBy("session", "application").agg(
        F.min(F.when(role != "end", seen)).alias("f"), F.min(F.when(role == "agent", seen)).alias("a"),
        F.max(F.when(role == "end", seen)).alias("e"))
    per_session = per_app.groupBy("session").agg(
        F.min("f").alias("f"), F.min("a").alias("a"), F.max("e").alias("e"), F.collect_list("e").alias("ends"))
    at = lambda x: F.struct(x["start"].alias("start"), x["span_id"].alias("span_id"))
    later = F.filter("ends", lambda x: at(x) > at(F.col("f")))
    row = per_session.where("f IS NOT NULL").withColumns({
        "e": F.when(at(F.col("e")) > at(F.col("f")), F.col("e")),
        "end_apps": F.transform(later, lambda x: x["application"])})
    start = F.col("f.start")
    ended = F.coalesce(F.col("e.ended"), start)
    mas_call = F.concat(F.lit("mascall:"), "session")
    session_node = node(
        node_type=F.lit("Session"), id=F.col("session"), name=F.concat(F.lit("Session "), "session"),
        session_id=F.col("session"), start_time=start, end_time=ended,
        duration=F.greatest(F.lit(0.0), (ended - start) * 1000), success=F.coalesce("e.success", "f.success"),
        span_id=F.when(F.col("f.marked"), F.col("f.span_id")), parent_span_id=F.col("f.parent_span_id"),
    )
    mas_node = F.when(F.col("a").isNotNull(), node(
        node_type=F.lit("MASCall"), id=mas_call, name=F.concat(F.lit("MASCall "), "session"), session_id=F.col("session"),
        start_time=F.col("a.start"), end_time=F.col("a.start"), duration=F.lit(0.0),
    ))
    nodes = unpack(row, session_node, mas_node)
    apps = F.array_distinct(F.concat(F.array("f.application"), "end_apps"))
    runs = row.select("session", F.explode(apps).alias("app")).where("app <> ''")
    edges = unpack(runs, edge("executesSession", F.col("session"), F.col("app"))).unionByName(unpack(
        row.where("a IS NOT NULL"), edge("hasMASCall", F.col("session"), mas_call),
        edge("executesMAS", mas_call, F.col("a.application")),
    ))
    named = runs.select("app").unionByName(row.where("a IS NOT NULL").select(F.col("a.application").alias("app"))).distinct()
    plain = named.select(F.col("app").alias("id"), F.col("app").alias("name"), F.col("app").alias("description"),
                         F.lit(False).alias("declared"), F.lit(0.0).alias("start"), F.lit("").alias("span_id"))
    return nodes, edges, plain


def declared_structure(spans: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Declared applications and agents from graph spans: (MAS rows, Agent rows, edges)."""
    g = fields(spans.where(has_suffix("span_name", "graph"))).where("application <> ''")
    mas = g.select(
        F.col("application").alias("id"), first_filled(attr(keys.ENTITY_NAME), F.col("application")).alias("name"),
        text(attr(keys.ENTITY_DESCRIPTION)).alias("description"), F.lit(True).alias("declared"), "start", "span_id",
    )
    parsed = F.from_json(attr(keys.GRAPH), "nodes map<string,struct<name:string>>")
    named = g.select("application", "start", "span_id", F.explode(parsed["nodes"]).alias("id", "n")).where(
        ~F.col("id").isin("__start__", "__end__"))
    agents = named.select(
        "id", first_filled(F.col("n.name"), F.col("id")).alias("name"), F.lit("").alias("description"),
        F.lit(True).alias("declared"), "start", "span_id")
    edges = unpack(named, edge("belongsToMAS", F.col("id"), F.col("application"))).distinct()
    return mas, agents, edges


def prefer_declared(rows: DataFrame, node_type: str) -> DataFrame:
    """Declared beats undeclared; among equals the first seen."""
    best = rows.groupBy("id").agg(
        F.min(F.struct((~F.col("declared")).alias("r"), "start", "span_id", "name", "description", "declared")).alias("b"))
    return unpack(best, node(
        node_type=F.lit(node_type), id=F.col("id"), name=F.col("b.name"), description=F.col("b.description"),
        declared=F.col("b.declared")))


# -- 4. owners, handoffs, chains ------------------------------------------------------------


def agent_calls(c: DataFrame) -> DataFrame:
    return c.where("kind = 'agent'")


def owned(c: DataFrame) -> DataFrame:
    """Model and tool calls with the agent call they belong to (equality on the span id)."""
    owners = agent_calls(c).groupBy("session", F.col("span_id").alias("owner_span")).agg(
        F.min_by(F.struct(*[F.col(x).alias("owner_" + x) for x in ("call_id", "initial", "final", "in_text", "out_text", "start", "end")]),
                 F.struct("start", "call_id")).alias("o"))
    inner = c.where("kind <> 'agent' AND owner_span <> ''").join(owners, ["session", "owner_span"])
    return inner.select("*", "o.*").drop("o")


def explicit_handoffs(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, target) pairs named by spans, and the calls that carried such a signal."""
    marked = agent_calls(c).where(F.size("sources") > 0)
    left = marked.select("session", F.explode("sources").alias("source_span"), F.struct(
        "call_id", "initial", "in_text", "start", "application").alias("t"))
    sources = agent_calls(c).groupBy("session", F.col("span_id").alias("source_span")).agg(
        F.min_by(F.struct("call_id", "final", "out_text", "end"), F.struct("start", "call_id")).alias("s"))
    pairs = left.join(sources, ["session", "source_span"]).select("session", "s", "t")
    return pairs, marked.select("session", "call_id")


def fallback_handoffs(c: DataFrame, min_rows: int | None = None) -> DataFrame:
    """Consecutive top-level agent calls of a session, unless the later one has a signal."""
    children = agent_calls(c).where("application <> ''")
    ids = children.select("session", F.col("span_id").alias("parent_span_id")).distinct()
    top = children.join(ids, ["session", "parent_span_id"], "left_anti")
    seq = Sequence(top, ["session"], ["start", "span_id"], min_rows=min_rows)
    seq.prev(s=F.struct("call_id", "final", "out_text", "end"))
    t = F.struct("call_id", "initial", "in_text", "start", "application").alias("t")
    return seq.done().where(F.col("s").isNotNull() & ~F.coalesce(F.size("sources") > 0, F.lit(False))).select("session", "s", t)


def bridges(c: DataFrame, min_rows: int | None = None) -> DataFrame:
    """Pairs of states that should be continuous and are not, one row per bridge."""
    def pair_rows(pairs: DataFrame, kind: str) -> DataFrame:
        return pairs.where("t.application <> ''").select(
            F.lit(kind).alias("bridge"), F.col("session"), F.concat(F.lit("mascall:"), "session").alias("attach"),
            F.col("s.final").alias("from_state"), F.col("s.out_text").alias("a"), F.col("t.initial").alias("to_state"),
            F.col("t.in_text").alias("b"), F.col("s.end").alias("start"), F.col("t.start").alias("end"))

    explicit, _ = explicit_handoffs(c)
    o = owned(c)
    o = o.withColumn("rank", F.when(F.col("kind") == "llm", 0).otherwise(1))
    seq = Sequence(o, ["owner_call_id"], ["start", "rank", "span_id"], min_rows=min_rows)
    seq.prev(p=F.struct("final", "out_text", "end"))
    inner = seq.done().where("p IS NOT NULL").select(
        F.lit("capability-chain").alias("bridge"), "session", F.col("owner_call_id").alias("attach"),
        F.col("p.final").alias("from_state"), F.col("p.out_text").alias("a"), F.col("initial").alias("to_state"),
        F.col("in_text").alias("b"), F.col("p.end").alias("start"), F.col("start").alias("end"))
    pos = F.struct("start", "rank", "span_id")
    edge_of = o.groupBy("session", "owner_call_id").agg(
        F.min_by(F.struct("initial", "in_text", "start"), pos).alias("f"),
        F.max_by(F.struct("final", "out_text", "end"), pos).alias("l"),
        F.first(F.struct("owner_initial", "owner_in_text", "owner_final", "owner_out_text", "owner_start", "owner_end")).alias("o"))
    bound = edge_of.select("session", "owner_call_id", F.inline(F.array(
        F.struct(F.col("o.owner_initial").alias("from_state"), F.col("o.owner_in_text").alias("a"),
                 F.col("f.initial").alias("to_state"), F.col("f.in_text").alias("b"),
                 F.col("o.owner_start").alias("start"), F.col("f.start").alias("end")),
        F.struct(F.col("l.final").alias("from_state"), F.col("l.out_text").alias("a"),
                 F.col("o.owner_final").alias("to_state"), F.col("o.owner_out_text").alias("b"),
                 F.col("l.end").alias("start"), F.col("o.owner_end").alias("end")))))
    bound = bound.withColumns({"bridge": F.lit("capability-chain-boundary"), "attach": F.col("owner_call_id")}).drop("owner_call_id")
    rows = reduce(DataFrame.unionByName, [
        pair_rows(explicit, "handoff"), pair_rows(fallback_handoffs(c, min_rows), "handoff-fallback"), inner, bound])
    shown = lambda x: F.when(F.col(x) == "", NO_CONTENT).otherwise(F.col(x))
    gaps = rows.where(shown("a") != shown("b")).drop("a", "b")
    gaps = gaps.groupBy("bridge", "from_state", "to_state").agg(
        F.min(F.struct("start", "end", "attach", "session")).alias("v"))
    gaps = gaps.select("bridge", "from_state", "to_state", "v.*")
    b, f, t = F.col("bridge"), F.col("from_state"), F.col("to_state")
    return gaps.withColumns({
        "call_id": short_id("processingcall", b, f, t), "transition": short_id("transition", b, f, t)})


def bridge_graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    call, b = F.col("call_id"), F.col("bridge")
    nodes = unpack(
        found,
        node(node_type=F.lit("ProcessingCall"), id=call, session_id=F.col("session"),
             name=F.concat(b, F.lit(" bridge ("), "from_state", F.lit(" -> "), "to_state", F.lit(")")),
             start_time=F.col("start"), end_time=F.col("end"),
             duration=F.greatest(F.lit(0.0), (F.col("end") - F.col("start")) * 1000)),
        node(node_type=F.lit("Transition"), id=F.col("transition"), session_id=F.col("session")))
    kinds = unpack(found.select("bridge").distinct(), node(
        node_type=F.lit("Processing"), id=F.concat(F.lit("processing:"), b), name=F.replace(b, F.lit("-"), F.lit("_"))))
    edges = unpack(
        found, edge("executesProcessing", call, F.concat(F.lit("processing:"), b)),
        edge("hasProcessingCall", F.col("attach"), call),
        *state_edges(call, F.col("from_state"), F.col("to_state"), F.col("transition")))
    return nodes.unionByName(kinds), edges


def container_states(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """MAS call and session share the first child's initial and the last child's final state."""
    pos = F.struct("start", "span_id")
    per = agent_calls(c).where("application <> ''").groupBy("session").agg(
        F.min_by("initial", pos).alias("initial"), F.max_by("final", pos).alias("final"))
    rows = per.select("session", "initial", "final", F.explode(
        F.array(F.concat(F.lit("mascall:"), "session"), F.col("session"))).alias("owner"))
    i, f, o = F.col("initial"), F.col("final"), F.col("owner")
    rows = rows.withColumn("transition", short_id("transition", F.lit("container-boundary"), o, i, f))
    nodes = unpack(rows, node(node_type=F.lit("Transition"), id=F.col("transition"), session_id=F.col("session")))
    return nodes, unpack(rows, *state_edges(o, i, f, F.col("transition")))


def owner_edges(c: DataFrame) -> DataFrame:
    o = owned(c)
    return unpack(o, F.when(F.col("kind") == "llm", edge("hasLLMCall", F.col("owner_call_id"), F.col("call_id")))
                  .otherwise(edge("hasToolCall", F.col("owner_call_id"), F.col("call_id"))))


# -- 5. end to end --------------------------------------------------------------------------


def build_graph(spans: DataFrame, call_table: DataFrame | None = None, min_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all sessions; nodes are unique by (type, id), edges by (type, from, to).

    ``call_table`` may be a stored copy of ``calls(spans)``, which every part below reads.
    """
    c = calls(spans) if call_table is None else call_table
    s_nodes, s_edges, plain_mas = containers(spans, c)
    d_mas, d_agents, d_edges = declared_structure(spans)
    shared, uses = shared_structure(c)
    agents = shared.where("node_type = 'Agent'").select(
        "id", "name", "description", F.lit(False).alias("declared"), F.lit(0.0).alias("start"), F.lit("").alias("span_id"))
    b_nodes, b_edges = bridge_graph(bridges(c, min_rows))
    k_nodes, k_edges = container_states(c)
    nodes = reduce(DataFrame.unionByName, [
        call_nodes(c), s_nodes, prefer_declared(plain_mas.unionByName(d_mas), "MAS"),
        prefer_declared(agents.unionByName(d_agents), "Agent"), shared.where("node_type <> 'Agent'"), b_nodes, k_nodes])
    edges = reduce(DataFrame.unionByName, [
        call_edges(c), s_edges, uses.unionByName(d_edges).distinct(), owner_edges(c), b_edges, k_edges])
    # Only states and transitions of equal bridges can meet again; edges repeat when states do.
    return nodes, edges.distinct()


def first_registered(items: DataFrame, keys_: list[str], precedence: str, order: list[str]) -> DataFrame:
    """Registry rule as an aggregate: lowest precedence value wins, then the first in order."""
    rest = [c for c in items.columns if c not in keys_]
    best = items.groupBy(*keys_).agg(F.min_by(F.struct(*rest), F.struct(precedence, *order)).alias("_b"))
    return best.select(*keys_, "_b.*")
