"""Live jobs. Functions named for a result work on batch and streaming DataFrames alike.

``run_available`` drives a streaming query over what a file source holds, which is how the
queries and tests use them; a cluster starts the same query with a processing-time trigger.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanloom.operators.spans import content_fingerprint
from spanloom.session import shared_folder

# Names of the topology log events.
SESSION_STARTED, SESSION_COMPLETED = "topology.session.started", "topology.session.completed"
NODE_STARTED, NODE_COMPLETED = "topology.node.started", "topology.node.completed"
TOOL_STARTED, TOOL_COMPLETED, EDGE_UPDATED = "tool.started", "tool.completed", "topology.edge.updated"
# When a session is an orphan.
ORPHAN_IDLE, ORPHAN_DEDUPE = "5 minutes", "300 seconds"


def stream_files(spark: SparkSession, folder: str, glob: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; a name without wildcards is a table, one file or a folder of part files."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if not any(c in glob for c in "*?[{"):
        # as a pattern: Spark takes a path without one for a folder
        return reader.parquet(f"{folder}/[{glob[0]}]{glob[1:]}")
    return reader.option("pathGlobFilter", glob).parquet(folder)


def run_available(stream: DataFrame, mode: str = "append", each: Callable | None = None, keys: list[str] | None = None) -> DataFrame | None:
    """Process what is there. Without ``each``, the result comes back; in update mode the newest row of each of ``keys``.

    A micro-batch writes only what it has changed, to a folder of its own.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{folder}/out"
    schema = stream.schema

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that is tried again replaces its own rows
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    if not each:  # a stream without rows has a result without rows
        keep(spark.createDataFrame([], schema), -1)
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).foreachBatch(each or keep).start())
    query.awaitTermination()
    if each:
        return None
    if mode == "update":
        rest = [c for c in schema.names if c not in keys]
        rows = spark.read.parquet(out)
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("v")).select(*keys, "v.*").select(*schema.names)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)


# -- sessions, agents, tools ----------------------------------------------------------------


def session_status(events: DataFrame) -> DataFrame:
    """First start, completions, end and status of every session."""
    done = F.col("event_name") == SESSION_COMPLETED
    per = events.where((F.col("session_key") != "") & F.col("event_name").isin(SESSION_STARTED, SESSION_COMPLETED)).groupBy("session_key").agg(
        F.min("ts").alias("start_time"), F.count_if(done).alias("n_completed"), F.min(F.when(done, F.col("ts"))).alias("end_time"))
    return per.withColumn("status", F.when(F.col("n_completed") > 0, "completed").otherwise("active"))


def orphan_sessions(events: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Sessions that started, never completed and were last active more than five minutes ago."""
    per = events.where(F.col("session_key") != "").groupBy("session_key").agg(
        F.max("ts").alias("last_activity"), F.count_if(F.col("event_name") == SESSION_STARTED).alias("n_started"),
        F.count_if(F.col("event_name") == SESSION_COMPLETED).alias("n_completed"))
    found = per.where("n_started > 0 AND n_completed = 0").where(F.col("last_activity") <= now - F.expr(f"INTERVAL {ORPHAN_IDLE}"))
    found = found.orderBy(F.desc("last_activity"), "session_key")
    return found if limit is None else found.limit(limit)


def orphan_completions(orphans: DataFrame, emitted: DataFrame, now: Column, page: int | None = None) -> DataFrame:
    """Synthetic completions for orphans not already closed within the last five minutes; all, or a caller's page."""
    recent = emitted.where(F.col("emitted_at") >= now - F.expr(f"INTERVAL {ORPHAN_DEDUPE}")).select("session_key").distinct()
    fresh = orphans.join(recent, "session_key", "left_anti")
    if page is not None:
        fresh = fresh.orderBy(F.desc("last_activity"), "session_key").limit(page)
    return fresh.select("session_key", F.lit(SESSION_COMPLETED).alias("event_name"), now.alias("emitted_at"), F.lit(True).alias("synthetic"))


def running(events: DataFrame, name: str, started: str, completed: str) -> DataFrame:
    """Per agent or tool: last start, last end, and whether more starts than ends were seen."""
    a, b = F.col("event_name") == started, F.col("event_name") == completed
    per = events.where((F.col(name) != "") & (a | b)).groupBy(name).agg(
        F.max(F.when(a, F.col("ts"))).alias("start_time"), F.max(F.when(b, F.col("ts"))).alias("end_time"),
        F.count_if(a).alias("n_started"), F.count_if(b).alias("n_completed"))
    return per.withColumn("status", F.when(F.col("n_started") > F.col("n_completed"), "active").otherwise("completed"))


def active_agents(events: DataFrame) -> DataFrame:
    return running(events.where("tool = ''") if "tool" in events.columns else events, "agent", NODE_STARTED, NODE_COMPLETED)


def active_tools(events: DataFrame) -> DataFrame:
    return running(events, "tool", TOOL_STARTED, TOOL_COMPLETED)


_MESSAGE = "struct<type:string,content:string,name:string,tool_call_id:string,tool_calls:array<struct<id:string,name:string>>>"


def inferred_tools(events: DataFrame, agent: str = "agent", payload: str = "agent_input") -> DataFrame:
    """Tools an agent used according to the message history in its input.

    The agent's part starts after the last message that decides for it and ends at the next
    decision. A tool with a reply is completed, one only called is active.
    """
    shape = f"struct<args:array<struct<messages:array<{_MESSAGE}>>>>"
    messages = F.get(F.from_json(payload, shape)["args"], 0)["messages"]
    line = lambda m: F.trim(F.substring_index(F.coalesce(m["content"], F.lit("")), "\n", 1))
    decides = lambda m: F.when((m["type"] == "AIMessage") & line(m).startswith("DECISION:"), F.trim(F.substr(line(m), F.lit(10))))
    rows = events.withColumn("_m", messages).where(F.size("_m") > 0)
    rows = rows.withColumn("_d", F.transform("_m", decides))
    rows = rows.withColumn("_from", F.array_max(F.filter(F.transform("_d", lambda x, i: F.when(x == F.col(agent), i)), lambda x: x.isNotNull())))
    rows = rows.where("_from IS NOT NULL").withColumn(
        "_to", F.coalesce(F.array_min(F.filter(F.transform("_d", lambda x, i: F.when(x.isNotNull() & (i > F.col("_from")), i)), lambda x: x.isNotNull())), F.size("_m")))
    part = rows.withColumn("_part", F.slice("_m", F.col("_from") + 2, F.col("_to") - F.col("_from") - 1))
    calls = F.flatten(F.transform("_part", lambda m: F.transform(
        F.coalesce(m["tool_calls"], F.array().cast("array<struct<id:string,name:string>>")), lambda c: F.struct(c["name"].alias("tool"), c["id"].alias("id"), F.lit(False).alias("done")))))
    replies = F.transform(F.filter("_part", lambda m: m["type"] == "ToolMessage"), lambda m: F.struct(
        F.coalesce(m["name"], F.lit("")).alias("tool"), m["tool_call_id"].alias("id"), F.lit(True).alias("done")))
    named = part.withColumn("_calls", calls).withColumn("_replies", replies)
    by_id = lambda r: F.coalesce(F.nullif(r["tool"], F.lit("")), F.get(F.filter("_calls", lambda c: c["id"] == r["id"]), 0)["tool"], F.lit(""))
    both = F.concat(F.col("_calls"), F.transform("_replies", lambda r: F.struct(by_id(r).alias("tool"), r["id"].alias("id"), r["done"].alias("done"))))
    keys = [c for c in ("session_key",) if c in events.columns]
    used = named.select(*keys, agent, F.explode(both).alias("u")).where("u.tool <> ''")
    return used.groupBy(*keys, agent, F.col("u.tool").alias("tool")).agg(F.when(F.bool_or("u.done"), "completed").otherwise("active").alias("status"))


# -- topology -------------------------------------------------------------------------------


def node_status(events: DataFrame) -> DataFrame:
    """Agents and tools of every session by their last event; a restart clears the end."""
    e = F.col("event_name")
    is_agent = e.isin(NODE_STARTED, NODE_COMPLETED) & (F.col("agent") != "")
    is_tool = e.isin(TOOL_STARTED, TOOL_COMPLETED) & (F.col("tool") != "")
    rows = events.where(is_agent | is_tool).withColumns({
        "node": F.when(is_agent, F.col("agent")).otherwise(F.col("tool")), "type": F.when(is_agent, "agent").otherwise("tool"), "starts": e.isin(NODE_STARTED, TOOL_STARTED)})
    last = rows.groupBy("session_key", "type", "node").agg(
        F.max_by(F.struct("starts", "ts"), F.struct("ts", "event_id")).alias("l"), F.max(F.when(F.col("starts"), F.col("ts"))).alias("start_time"))
    return last.select(
        "session_key", "type", "node", F.when(F.col("l.starts"), "active").otherwise("completed").alias("status"), "start_time",
        F.when(~F.col("l.starts"), F.col("l.ts")).alias("end_time"))


def live_session_status(events: DataFrame) -> DataFrame:
    named = events.where(F.col("event_name").isin(SESSION_STARTED, SESSION_COMPLETED))
    last = named.groupBy("session_key").agg(F.max_by("event_name", F.struct("ts", "event_id")).alias("e"))
    return last.select("session_key", F.when(F.col("e") == SESSION_STARTED, "active").otherwise("completed").alias("status"))


def handoff_edges(events: DataFrame) -> DataFrame:
    """First observed handoff per edge."""
    rows = events.where((F.col("event_name") == EDGE_UPDATED) & (F.col("agent") != "") & (F.col("target_agent") != ""))
    return rows.groupBy("session_key", F.col("agent").alias("source"), F.col("target_agent").alias("target")).agg(F.min("ts").alias("first_ts"))


def fold_stack(stack: list[str], name: str, agent: str, tool: str) -> str | None:
    """Apply one event to the stack of running agents; a tool start returns the agent on top."""
    if name == NODE_STARTED and agent:
        stack.append(agent)
    elif name == NODE_COMPLETED and agent:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i] == agent:
                del stack[i]
                break
    elif name == TOOL_STARTED and tool and stack:
        return stack[-1]
    return None


def tool_edges(events: DataFrame) -> DataFrame:
    """(session, agent, tool): a tool belongs to the agent that was entered last and is still running.

    Events stream through their partition in time order; the state is the stack of one session.
    """
    kinds = [NODE_STARTED, NODE_COMPLETED, TOOL_STARTED]
    rows = events.where(F.col("event_name").isin(*kinds)).repartition("session_key").sortWithinPartitions("session_key", "ts", "event_id").select(
        "session_key", "event_name", "agent", "tool")

    def scan(batches):
        current, stack = None, []
        for pdf in batches:
            found = []
            for session, name, agent, tool in pdf.itertuples(index=False):
                if session != current:
                    current, stack = session, []
                top = fold_stack(stack, name, agent, tool)
                if top is not None:
                    found.append((session, top, tool))
            yield pd.DataFrame(found, columns=["session_key", "agent", "tool"]).drop_duplicates()

    return rows.mapInPandas(scan, "session_key string, agent string, tool string").distinct()


def live_tool_edges(stream: DataFrame) -> DataFrame:
    """The same fold as a stateful stream: the state per session is its stack and the edges already sent.

    A session keeps its state, however long it is idle, until an event completes it. Events of a session
    are folded in time order within a micro-batch; a source that delivers them out of order over
    batches has to be ordered before.
    """
    def step(key, batches, state: GroupState):
        stack, sent = state.get if state.exists else ([], [])
        stack, sent, new = list(stack), set(sent), []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        for name, agent, tool in rows[["event_name", "agent", "tool"]].itertuples(index=False):
            top = fold_stack(stack, name, agent, tool)
            if top is not None and f"{top}\x1f{tool}" not in sent:
                sent.add(f"{top}\x1f{tool}")
                new.append((key[0], top, tool))
        if rows["event_name"].iloc[-1] == SESSION_COMPLETED:
            if state.exists:
                state.remove()
        else:
            state.update((stack, sorted(sent)))
        yield pd.DataFrame(new, columns=["session_key", "agent", "tool"])

    return stream.groupBy("session_key").applyInPandasWithState(
        step, "session_key string, agent string, tool string", "stack array<string>, sent array<string>", "append",
        GroupStateTimeout.NoTimeout)


# -- spans and metrics ----------------------------------------------------------------------


def new_spans(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Spans without re-exports seen within the delay."""
    marked = stream.withColumn("fingerprint", content_fingerprint()).withColumn("ts", F.col("ts").cast("timestamp"))
    return marked.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session_id", "fingerprint"])


def windowed_metrics(stream: DataFrame, unit: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Tumbling buckets of metric results; a bucket is final once the watermark has passed it."""
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", delay) if rows.isStreaming else rows
    agg = rows.groupBy("metric", F.window("ts", unit)).agg(
        F.avg("result").alias("avg_value"), F.min("result").alias("min_value"), F.max("result").alias("max_value"), F.count(F.lit(1)).alias("n"))
    return agg.select("metric", F.col("window.start").cast("timestamp_ntz").alias("bucket"), "avg_value", "min_value", "max_value", "n")


def completed_sessions(spans: DataFrame) -> DataFrame:
    """Sessions whose end marker is in the batch."""
    return spans.where("span_name = 'session.end' AND session_id <> ''").select("session_id", "application_id").distinct()


def on_completed(stream: DataFrame, job: Callable[[DataFrame, int], None]) -> None:
    """Run a batch job on the sessions each micro-batch completes; the number of a batch that is retried is the same."""
    def each(batch: DataFrame, number: int) -> None:
        done = completed_sessions(batch)
        if not done.isEmpty():
            job(done, number)

    run_available(stream, each=each)


# -- online grouping ------------------------------------------------------------------------


def attach_sessions(members: DataFrame, hashes: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add sessions to groups whose hash is still the expected one; (members, refused requests).

    The new hash is computed over all sessions by ``content_hashes`` on the result.
    """
    current = hashes.select("group_id", F.col("hash").alias("_hash"))
    checked = requests.join(current, "group_id", "left").withColumn("_ok", F.coalesce(F.col("hash") == F.col("_hash"), F.lit(False)))
    added = checked.where("_ok").select("group_id", "session_key")
    return members.select("group_id", "session_key").unionByName(added).distinct(), checked.where("NOT _ok").select("group_id", "session_key")


def nearest_groups(vectors: DataFrame, medoids: DataFrame, radius: float) -> DataFrame:
    """Nearest medoid of the session's application for each vector; of a stream, batch by batch."""
    from spanloom.operators.traverse import nearest_reference

    if not vectors.isStreaming:
        return nearest_reference(vectors, medoids, radius)
    out = f"{shared_folder(vectors.sparkSession)}/nearest-{uuid.uuid4().hex}"

    def each(batch: DataFrame, number: int) -> None:
        nearest_reference(batch, medoids, radius).write.mode("overwrite").parquet(f"{out}/batch={number}")

    each(vectors.sparkSession.createDataFrame([], vectors.schema), -1)  # a stream without rows has a result without rows
    run_available(vectors, each=each)
    return vectors.sparkSession.read.option("recursiveFileLookup", "true").parquet(out)
