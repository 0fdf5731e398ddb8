"""Traversal over ``nodes(node_type, id, ...)`` and ``edges(edge_type, from_id, to_id)``."""

from __future__ import annotations

from collections.abc import Sequence as Seq
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanloom.functions.ordered import Sequence
from spanloom.functions.vectors import cosine_distance, euclidean
from spanloom.session import cut_lineage

CALL_CHAINS = {
    "agent": [], "llm": ["hasLLMCall"], "tool": ["hasToolCall"], "processing": ["hasProcessingCall"],
}
#: Reference vectors of one block.
REFERENCE_ROWS = 1024


def of_type(nodes: DataFrame, *types: str) -> DataFrame:
    return nodes.where(F.col("node_type").isin(*types))


def hop(df: DataFrame, edges: DataFrame, kind: str, at: str, to: str, how: str = "inner", reverse: bool = False) -> DataFrame:
    """Follow one typed edge from column ``at`` into a new column ``to``; ``how='left'`` is optional."""
    a, b = ("to_id", "from_id") if reverse else ("from_id", "to_id")
    step = edges.where(F.col("edge_type") == kind).select(F.col(a).alias(at), F.col(b).alias(to))
    return df.join(step, at, how)


def walk(df: DataFrame, edges: DataFrame, kinds: Seq[str], start: str) -> DataFrame:
    """Follow a list of edge types; columns are named after the edges."""
    at = start
    for kind in kinds:
        df = hop(df, edges, kind, at, kind)
        at = kind
    return df


def agent_calls_of_sessions(edges: DataFrame) -> DataFrame:
    """(session, mas_call, call) along hasMASCall and hasAgentCall."""
    mas = edges.where("edge_type = 'hasMASCall'").select(F.col("from_id").alias("session"), F.col("to_id").alias("mas_call"))
    return hop(mas, edges, "hasAgentCall", "mas_call", "call")


def session_calls(edges: DataFrame) -> DataFrame:
    """Counts of distinct agent, model, tool and processing calls per session.

    Each branch is aggregated by itself: joining them first would multiply rows.
    """
    calls = agent_calls_of_sessions(edges).select("session", "call")
    mas = edges.where("edge_type = 'hasMASCall'").select(F.col("from_id").alias("session"), F.col("to_id").alias("call"))
    branches = [calls.select("session", F.lit("agent").alias("kind"), F.col("call").alias("id"))]
    for kind, chain in CALL_CHAINS.items():
        if chain:
            source = calls.unionByName(mas) if kind == "processing" else calls
            branches.append(
                hop(source, edges, chain[0], "call", "id").select("session", F.lit(kind).alias("kind"), "id"))
    all_calls = reduce(DataFrame.unionByName, branches).distinct()
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in CALL_CHAINS]
    sessions = edges.where("edge_type = 'executesSession'").select(F.col("from_id").alias("session")).distinct()
    return sessions.join(all_calls.groupBy("session").agg(*counts), "session", "left").na.fill(0)


def with_states(df: DataFrame, nodes: DataFrame, edges: DataFrame, at: str, how: str = "left") -> DataFrame:
    """Add initial and final state ids and texts of the element in ``at``."""
    text = of_type(nodes, "State").select("id", "content")
    ends = edges.where("edge_type IN ('hasInitialState', 'hasFinalState')").join(
        text, F.col("to_id") == F.col("id")).groupBy(F.col("from_id").alias(at)).agg(*[
            F.min(F.when(F.col("edge_type") == e, F.col(c))).alias(o) for e, c, o in [
                ("hasInitialState", "to_id", "initial_id"), ("hasInitialState", "content", "input"),
                ("hasFinalState", "to_id", "final_id"), ("hasFinalState", "content", "output")]])
    return df.join(ends, at, how)


def enriched_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per call: what it executes, by name and provider, and its texts."""
    calls = of_type(nodes, "AgentCall", "LLMCall", "ToolCall").select(
        F.col("id").alias("call"), "node_type", F.col("session_id").alias("session"), "start_time")
    runs = edges.where(F.col("edge_type").isin("executesAgent", "executesLLM", "executesTool")).select(
        F.col("from_id").alias("call"), F.col("to_id").alias("target"))
    parts = of_type(nodes, "Agent", "LLM", "Tool").groupBy(F.col("id").alias("target")).agg(
        F.min("name").alias("name"), F.min("provider").alias("provider"))
    return with_states(calls.join(runs, "call", "left").join(parts, "target", "left"), nodes, edges, "call")


def session_texts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    sessions = of_type(nodes, "Session").select(F.col("id").alias("session"), "start_time")
    return with_states(sessions, nodes, edges, "session")


def session_vectors(texts: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Input and output vectors of sessions for one model; embeddings are keyed by state."""
    known = embeddings.where(F.col("model") == model).select("state_id", "vector")
    ins = known.select(F.col("state_id").alias("initial_id"), F.col("vector").alias("input_vector"))
    outs = known.select(F.col("state_id").alias("final_id"), F.col("vector").alias("output_vector"))
    return texts.join(ins, "initial_id", "left").join(outs, "final_id", "left")


def session_of(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Session of any element; a session is its own."""
    owners = nodes.where(F.col("session_id").isNotNull()).select("id", "session_id").distinct()
    return ids.join(owners, "id")


def call_sequence(nodes: DataFrame, edges: DataFrame, min_rows: int | None = None) -> DataFrame:
    """Agent calls of every session in start order, numbered from 1."""
    start = of_type(nodes, "AgentCall").select(
        F.col("id").alias("call"), F.col("session_id").alias("session"), "start_time", "span_id")
    rows = hop(start, edges, "executesAgent", "call", "agent")
    return Sequence(rows, ["session"], ["start_time", "span_id"], min_rows=min_rows).number("pos").done()


def sessions_between(nodes: DataFrame, start: float | None = None, end: float | None = None) -> DataFrame:
    """Sessions on the graph; all of them newest first, or those of an interval oldest first."""
    s = of_type(nodes, "Session").select(F.col("id").alias("session"), "start_time", "end_time", "duration")
    if start is None and end is None:
        return s.orderBy(F.desc("start_time"), "session")
    if start is not None:
        s = s.where(F.col("start_time") >= start)
    if end is not None:
        s = s.where(F.col("start_time") <= end)
    return s.orderBy("start_time", "session")


def sessions_with_agent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(session, agent): sessions that have a call of the agent, for semi-joins."""
    calls = of_type(nodes, "AgentCall").select(F.col("id").alias("call"), F.col("session_id").alias("session"))
    return hop(calls, edges, "executesAgent", "call", "agent").select("session", "agent").distinct()


def leaf_groups(groups: DataFrame, group_edges: DataFrame) -> DataFrame:
    parents = group_edges.select(F.col("parent_id").alias("group_id")).distinct()
    return groups.join(parents, "group_id", "left_anti")


def closure(pairs: DataFrame, parent: str, child: str, max_hops: int | None = None) -> DataFrame:
    """(ancestor, descendant, depth) over parent -> child pairs; shortest depth, safe on cycles.

    Paths are joined with paths, so a round doubles the depth reached; it ends when a round finds no
    pair and no shorter way. Each round is checkpointed, so the plan does not grow.
    """
    reached = cut_lineage(pairs.select(F.col(parent).alias("ancestor"), F.col(child).alias("descendant"), F.lit(1).alias("depth")).distinct())
    size = lambda df: df.agg(F.count(F.lit(1)), F.sum("depth")).first()
    known = size(reached)
    while True:
        far = reached.select("ancestor", F.col("descendant").alias("_m"), F.col("depth").alias("_d")).join(
            reached.select(F.col("ancestor").alias("_m"), "descendant", "depth"), "_m").select("ancestor", "descendant", (F.col("_d") + F.col("depth")).alias("depth"))
        if max_hops:
            far = far.where(F.col("depth") <= max_hops)
        reached = cut_lineage(reached.unionByName(far).groupBy("ancestor", "descendant").agg(F.min("depth").alias("depth")))
        now = size(reached)
        if now == known:
            return reached
        known = now


def group_members(group_edges: DataFrame, group_sessions: DataFrame) -> DataFrame:
    """(group, session) for every session at or below a group."""
    below = closure(group_edges, "parent_id", "child_id")
    deep = below.join(group_sessions.withColumnRenamed("group_id", "descendant"), "descendant").select(
        F.col("ancestor").alias("group_id"), "session_key")
    return deep.unionByName(group_sessions.select("group_id", "session_key")).distinct()


def neighbourhood(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int, barrier: str = "Metric") -> DataFrame:
    """(seed, id, depth) within ``hops`` undirected steps, never passing through ``barrier`` nodes."""
    blocked = of_type(nodes, barrier).select("id")
    both = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).unionByName(
        edges.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"))).distinct()
    reached = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth"))
    frontier = reached
    for depth in range(1, hops + 1):
        open_ = frontier.join(blocked, "id", "left_anti")
        new = open_.join(both, F.col("id") == F.col("a")).select("seed", F.col("b").alias("id"), F.lit(depth).alias("depth")).distinct()
        frontier = cut_lineage(new.join(reached, ["seed", "id"], "left_anti"))
        reached = cut_lineage(reached.unionByName(frontier))
    return reached


def reference_blocks(refs: DataFrame, keys: list[str], rows: int = REFERENCE_ROWS) -> DataFrame:
    """Reference vectors packed into arrays of about ``rows``: (keys, block, n_blocks, refs)."""
    sized = refs.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("n_blocks")) if keys else refs.agg(
        F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / rows)).cast("int").alias("n_blocks"))
    placed = refs.join(sized, keys) if keys else refs.withColumn("n_blocks", sized.scalar())
    placed = placed.withColumn("block", F.pmod(F.xxhash64("ref_id"), F.col("n_blocks")).cast("int"))
    return placed.groupBy(*keys, "block", "n_blocks").agg(F.array_sort(F.collect_list(F.struct(F.col("ref_id").alias("id"), F.col("vector").alias("v")))).alias("_refs"))


def meet_blocks(vectors: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    """Every vector with every block of its references, as an equi-join on the block."""
    packed = reference_blocks(refs, keys)
    counts = packed.groupBy(*keys).agg(F.max("n_blocks").alias("_n")) if keys else packed.agg(F.coalesce(F.max("n_blocks"), F.lit(1)).alias("_n"))
    spread = vectors.join(counts, keys) if keys else vectors.withColumn("_n", counts.scalar())
    return spread.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).join(packed, [*keys, "block"])


def within_radius(
    vectors: DataFrame, refs: DataFrame, max_distance: float, k: int, metric: str = "cosine"
) -> DataFrame:
    """Up to ``k`` nearest rows per reference within the radius.

    References lie in blocks; each vector row tests a block where it meets it, only hits go on, and the
    top-k is cut on the map side, too (window group limit).
    """
    measure = cosine_distance if metric == "cosine" else euclidean
    hits = F.filter(
        F.transform("_refs", lambda r: F.struct(r["id"].alias("ref_id"), measure(F.col("vector"), r["v"]).alias("distance"))),
        lambda h: h["distance"] <= max_distance)
    found = meet_blocks(vectors, refs, []).select("session_key", F.explode(hits).alias("h")).select("session_key", "h.ref_id", "h.distance")
    w = Window.partitionBy("ref_id").orderBy("distance", "session_key")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_reference(vectors: DataFrame, refs: DataFrame, radius: float | None = None) -> DataFrame:
    """Nearest reference of each row within the same application, when close enough.

    A batch form: on a stream, call it in ``foreachBatch``.
    """
    best = F.array_min(F.transform("_refs", lambda r: F.struct(
        cosine_distance(F.col("vector"), r["v"]).alias("distance"), r["id"].alias("ref_id"))))
    out = meet_blocks(vectors, refs, ["application_id"]).groupBy("session_key").agg(F.min(best).alias("b")).select(
        "session_key", "b.ref_id", "b.distance")
    return out if radius is None else out.where(F.col("distance") <= radius)


def distinct_union(*branches: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, branches).distinct()
