"""Metric results: maps, series, buckets, summaries, scores, and reads for group analysis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanloom import schema
from spanloom.functions.ordered import Sequence
from spanloom.functions.scalar import epoch_seconds, session_key
from spanloom.operators.spans import page

PERIODS = 12


def result_map(results: DataFrame, key: str) -> DataFrame:
    """Distinct results of an element as rows: (key, metric, result, provider, reasoning)."""
    return results.select(key, "metric", "result", "provider", "reasoning").distinct()


def named_results(results: DataFrame, names: list[str], start=None, end=None, agents: DataFrame | None = None) -> DataFrame:
    """Results of some metrics in a window; with an agent filter, only sessions that ran the agent."""
    found = results.where(F.col("metric").isin(*names))
    if start is not None:
        found = found.where(F.col("ts") >= F.lit(start))
    if end is not None:
        found = found.where(F.col("ts") <= F.lit(end))
    return found if agents is None else found.join(agents, "session_key", "left_semi")


def category_results(results: DataFrame, categories: DataFrame) -> DataFrame:
    """Results joined to the (category, metric) list."""
    return results.join(F.broadcast(categories), "metric")


def session_counts(results: DataFrame, by: list[str], **window) -> DataFrame:
    return results.groupBy(*by).agg(F.count_distinct("session_key").alias("n_sessions"))


def failure_totals(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """Fatal and minor failures summed from the reasoning JSON, also when it is JSON in a JSON string."""
    text = F.col("reasoning")
    inner = F.when(F.trim(text).startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")).otherwise(text)
    n = lambda key: F.coalesce(F.sum(F.get_json_object(inner, f"$.{key}").try_cast("bigint")), F.lit(0))
    return verdicts.groupBy(*by).agg(n("total_fatal").alias("fatal"), n("total_minor").alias("minor"))


def over_time(results: DataFrame, unit: str, by: list[str]) -> DataFrame:
    """Average, extremes and count per time bucket."""
    bucket = F.date_trunc(unit, F.col("ts")).cast("timestamp_ntz").alias("bucket")
    return results.where("result IS NOT NULL").groupBy(*by, bucket).agg(
        F.avg("result").alias("avg_value"), F.min("result").alias("min_value"), F.max("result").alias("max_value"), F.count(F.lit(1)).alias("n"))


def timeline(results: DataFrame, starts: DataFrame, by: list[str], min_rows: int | None = None) -> DataFrame:
    """Points of every series in order of session start, numbered; one row per point."""
    rows = results.where("result IS NOT NULL").join(starts, "session_key").where("started IS NOT NULL")
    return Sequence(rows, by, ["started", "session_key", "result_id"], min_rows=min_rows).number("pos").done()


def reliability(reports: DataFrame, results: DataFrame, by: list[str]) -> DataFrame:
    """Mean consistency per type over distinct reports, and 1 - mean error rate."""
    kind = F.when(F.col("data_type") == "metric", "MetricConsistency").when(F.col("data_type") == "graph", "GraphConsistency").when(
        F.col("data_type") == "text", "TextConsistency").otherwise(F.col("data_type"))
    means = reports.select(*by, "report_id", "data_type", "mean").distinct().groupBy(*by, kind.alias("name")).agg(F.avg("mean").alias("value"))
    done = results.where(F.col("metric").isin(*schema.ERROR_METRICS)).groupBy(*by).agg((1 - F.avg("result")).alias("value"))
    return means.unionByName(done.withColumn("name", F.lit("CompletionRate")))


# -- twelve periods -------------------------------------------------------------------------


def period_bounds(points: DataFrame, by: list[str]) -> DataFrame:
    """Start and size of the periods: the range widened by a tenth on both sides, at least 10 s."""
    ends = points.groupBy(*by).agg(F.min("epoch").alias("lo"), F.max("epoch").alias("hi"))
    hi = F.when(F.col("hi") - F.col("lo") < 10, F.col("lo") + 10).otherwise(F.col("hi"))
    pad = (hi - F.col("lo")) / (PERIODS - 2)
    start = F.greatest(F.col("lo") - pad, F.lit(0.0))
    return ends.select(*by, start.alias("p_start"), ((hi + pad - start) / PERIODS).alias("p_size"))


def in_period(points: DataFrame, bounds: DataFrame, by: list[str]) -> DataFrame:
    """Add the period 0..11 of each point; bounds has one row per key."""
    slot = F.floor((F.col("epoch") - F.col("p_start")) / F.col("p_size"))
    joined = points.join(bounds, by) if by else points.join(F.broadcast(bounds))
    return joined.withColumn("period", slot).where((F.col("period") >= 0) & (F.col("period") < PERIODS))


def period_series(points: DataFrame, by: list[str], series: list[str], operation: str = "average", value: str = "result") -> DataFrame:
    """Average or sum per period for every series, 0 in an empty period, with the session count.

    One aggregate over all periods; the twelve-row spine is joined afterwards.
    """
    bounds = period_bounds(points, by)
    slotted = in_period(points, bounds, by)
    agg = F.avg(value) if operation == "average" else F.sum(value)
    sums = slotted.groupBy(*by, *series, "period").agg(agg.alias("value"), F.count_distinct("session_key").alias("n_sessions"))
    spine = points.select(*by, *series).distinct().withColumn("period", F.explode(F.sequence(F.lit(0), F.lit(PERIODS - 1)))).withColumn(
        "period", F.col("period").cast("bigint"))
    out = spine.join(sums, [*by, *series, "period"], "left").join(bounds, by)
    return out.select(*by, *series, "period", (F.col("p_start") + F.col("period") * F.col("p_size")).alias("starts_at"),
                      F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("n_sessions", F.lit(0)).alias("n_sessions"))


def period_sessions(points: DataFrame, by: list[str], series: list[str]) -> DataFrame:
    """Distinct sessions of every period, one per row."""
    return in_period(points, period_bounds(points, by), by).select(*by, *series, "period", "session_key").where("session_key <> ''").distinct()


def with_epoch(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn("epoch", epoch_seconds(F.col(ts)))


# -- documents of derived metrics -----------------------------------------------------------


def metric_documents(derived: DataFrame) -> DataFrame:
    """Name, category and raw value text of each document, with the plain session key."""
    doc = F.from_json("metrics", "metric_name string, category string, value string")
    return derived.select(
        "*", doc["metric_name"].alias("metric"), doc["category"].alias("category"), doc["value"].alias("value_text"),
        session_key(F.col("session_id"), F.col("application_id")).alias("doc_session"))


def document_average(docs: DataFrame, by: list[str], metric: str, category: str | None = None) -> DataFrame:
    """Mean per stored session id, then the mean of those."""
    found = docs.where(F.col("metric") == metric)
    if category:
        found = found.where(F.col("category") == category)
    per = found.groupBy(*by, "session_id").agg(F.avg(F.col("value_text").try_cast("double")).alias("v"))
    return docs.select(*by).distinct().join(per.groupBy(*by).agg(F.avg("v").alias("metric_avg")), by, "left").na.fill(0.0, ["metric_avg"])


# Keys of the application and agent documents.
APP_DOCUMENT, AGENT_DOCUMENT = "PassiveEvalApp", "PassiveEvalAgents"
APP_FIELDS = ["tool_calls", "tool_fails", "llm_calls", "llm_fails", "llm_cost", "duration", "graph_determinism", "graph_dynamism"]
AGENT_DURATION, AGENT_COST = "eval.agent.llm_duration", "eval.agent.llm_cost"


def app_values(docs: DataFrame) -> DataFrame:
    """Application documents with their value as a map; the value may be an object or a JSON string."""
    return docs.where(F.col("metric") == APP_DOCUMENT).withColumn("v", F.from_json("value_text", "map<string,double>"))


def app_field_averages(docs: DataFrame, by: list[str]) -> DataFrame:
    return app_values(docs).groupBy(*by).agg(*[F.avg(F.col("v").getItem(f"eval.app.{f}")).alias(f) for f in APP_FIELDS])


def app_field_sums(docs: DataFrame, by: list[str], fields: dict[str, str]) -> DataFrame:
    """Sums of chosen keys, 0 for a group without documents."""
    sums = app_values(docs).groupBy(*by).agg(*[F.coalesce(F.sum(F.col("v").getItem(k)), F.lit(0.0)).alias(n) for n, k in fields.items()])
    return docs.select(*by).distinct().join(sums, by, "left").na.fill(0.0)


def agent_document_totals(docs: DataFrame, by: list[str]) -> DataFrame:
    """Model duration and cost per agent; names agree up to case and ``_`` versus ``-``."""
    shape = "struct<agents:map<string,map<string,double>>>"
    rows = docs.where(F.col("metric") == AGENT_DOCUMENT).select(*by, F.explode(F.from_json("value_text", shape)["agents"]).alias("name", "m"))
    agent = F.replace(F.lower("name"), F.lit("_"), F.lit("-"))
    return rows.groupBy(*by, agent.alias("agent")).agg(
        F.sum(F.coalesce(F.col("m").getItem(AGENT_DURATION), F.lit(0.0))).alias("llm_duration"),
        F.sum(F.coalesce(F.col("m").getItem(AGENT_COST), F.lit(0.0))).alias("llm_cost"))


# -- per session and per application --------------------------------------------------------


def quality_per_session(results: DataFrame, key: str = "session_key", names: list[str] | None = None) -> DataFrame:
    """One column per metric; NULL where the session has no result, so callers can skip it."""
    names = names or schema.QUALITY_METRICS
    return results.where(F.col("metric").isin(*names)).groupBy(key).agg(
        *[F.avg(F.when(F.col("metric") == m, F.col("result"))).alias(m) for m in names])


def metric_lists(results: DataFrame, names: list[str]) -> DataFrame:
    """All results per (session, metric), one per row, numbered by time."""
    return Sequence(results.where(F.col("metric").isin(*names)), ["session_key", "metric"], ["ts", "result_id"]).number("pos").done()


def overall_performance(results: DataFrame, by: list[str]) -> DataFrame:
    """Session means per metric, their mean per metric, and the mean of the metrics there are."""
    q = results.where(F.col("metric").isin(*schema.QUALITY_METRICS))
    per = q.groupBy(*by, "metric", "session_key").agg(F.avg("result").alias("v"))
    return per.groupBy(*by, "metric").agg(F.avg("v").alias("v")).groupBy(*by).agg(F.avg("v").alias("performance"))


def applications_with_metrics(applications: DataFrame, tokens: DataFrame, names: DataFrame, results: DataFrame, limit=None, offset=0) -> DataFrame:
    """Page the applications first; then join what was aggregated per application."""
    chosen = page(applications, [F.desc("last_ts"), F.col("application_id")], limit, offset)
    per_app = results.groupBy("application_id").agg(F.count(F.lit(1)).alias("n_results"), F.count_distinct("metric").alias("n_metrics"))
    return reduce(lambda a, b: a.join(b, "application_id", "left"), [tokens, names, per_app], chosen)


def collect_page(branches: list[DataFrame], sessions: DataFrame, key: str = "session_key", members: DataFrame | None = None) -> DataFrame:
    """Left-join branches that already have one row per session; optionally only members of a group."""
    if members is not None:
        sessions = sessions.join(members.select(key).distinct(), key, "left_semi")
    return reduce(lambda a, b: a.join(b, key, "left"), branches, sessions)


def group_scores(groups: DataFrame, members: DataFrame, results: DataFrame, reports: DataFrame) -> DataFrame:
    """Quality, performance and reliability of groups.

    Reliability counts the completion rate as one more entry beside the consistency types.
    """
    m, r = F.col("metric"), F.col("result")
    only = lambda *names: F.avg(F.when(m.isin(*names), r))
    # Results are summed per session first, so a session in several groups is not aggregated again.
    wanted = [*schema.QUALITY_METRICS, *schema.ERROR_METRICS, "WorkflowEfficiency", "CyclesCount"]
    part = results.where(m.isin(*wanted)).groupBy("session_key", "metric").agg(F.sum("result").alias("s"), F.count("result").alias("n"))
    joined = members.join(part, "session_key")
    mean = lambda *names: F.sum(F.when(m.isin(*names), F.col("s"))) / F.nullif(F.sum(F.when(m.isin(*names), F.col("n"))), F.lit(0))
    per = joined.groupBy("group_id").agg(
        mean(*schema.QUALITY_METRICS).alias("quality"), (1 - mean(*schema.ERROR_METRICS)).alias("completion"),
        (1 / (1 + mean("CyclesCount"))).alias("c1"), mean("WorkflowEfficiency").alias("c2"),
        (1 - mean("LLMErrorRate")).alias("c3"), (1 - mean("ToolErrorRate")).alias("c4"))
    kinds = reports.groupBy("group_id", "data_type").agg(F.avg("mean").alias("v")).groupBy("group_id").agg(
        F.sum("v").alias("con_sum"), F.count(F.lit(1)).alias("con_n"))
    parts = F.array_compact(F.array("c1", "c2", "c3", "c4"))
    perf = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(parts), F.lit(0))
    out = groups.join(per, "group_id", "left").join(kinds, "group_id", "left")
    return out.select(
        "group_id", "application_id", "quality", perf.alias("performance"),
        ((F.coalesce("con_sum", F.lit(0.0)) + F.col("completion")) / (F.coalesce("con_n", F.lit(1)) + 1)).alias("reliability"))


def impact_per_group(contributions: DataFrame, members: DataFrame) -> DataFrame:
    """Mean contribution per (group, metric, agent) over all sessions under the group."""
    rows = contributions.select("session_key", "metric", F.explode(F.from_json("contributions", "map<string,double>")).alias("agent", "value"))
    part = rows.groupBy("session_key", "metric", "agent").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    return members.join(part, "session_key").groupBy("group_id", "metric", "agent").agg((F.sum("s") / F.sum("n")).alias("value"))


def groups_needing_analysis(leaves: DataFrame, reports: DataFrame, layers: list[str]) -> DataFrame:
    """Leaf groups that lack a report of any layer."""
    have = reports.where(F.col("data_type").isin(*layers)).select("group_id", "data_type").distinct().groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") == len(layers))
    return leaves.join(have, "group_id", "left_anti")


def can_analyse(requests: DataFrame, groups: DataFrame, reports: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Requests (group_id, hash[, session_key]): the hash is current and no report exists for it."""
    done = reports.select("group_id", F.col("group_hash").alias("hash"), F.lit(True).alias("_done")).distinct()
    current = groups.select("group_id", F.col("hash").alias("_hash"))
    out = requests.join(current, "group_id", "left").join(done, ["group_id", "hash"], "left")
    ok = F.coalesce(F.col("hash") == F.col("_hash"), F.lit(False)) & F.col("_done").isNull()
    if members is not None:
        out = out.join(members.select("group_id", "session_key").withColumn("_in", F.lit(True)), ["group_id", "session_key"], "left")
        ok = ok & F.col("_in").isNotNull()
    return out.withColumn("can_analyse", ok).drop("_hash", "_done", "_in")


# -- waste, features, insights --------------------------------------------------------------


def top_wasteful(waste: DataFrame, groups: DataFrame, threshold: float, limit: int | None = None, application: str | None = None) -> DataFrame:
    """Sessions above the threshold, most wasteful first, each with one of its groups."""
    if application is not None:
        waste = waste.where(F.col("application_id") == application)
    one = groups.groupBy("session_key").agg(F.min("group_id").alias("group_id"))
    found = waste.where(F.col("estimated_waste") > threshold)
    return page(found.join(one, "session_key", "left"), [F.desc("estimated_waste"), F.col("session_key")], limit)


def cost_per_leaf(leaf_members: DataFrame, waste: DataFrame) -> DataFrame:
    per = waste.groupBy("session_key").agg(F.sum(F.coalesce("actual_cost", F.lit(0.0))).alias("c"))
    return leaf_members.select("group_id", "session_key").distinct().join(per, "session_key", "left").groupBy("group_id").agg(
        F.coalesce(F.sum("c"), F.lit(0.0)).alias("total_cost")).orderBy(F.desc("total_cost"), "group_id")


def cost_efficiency(leaf_members: DataFrame, waste: DataFrame) -> DataFrame:
    return leaf_members.join(waste.where("actual_cost <> 0"), "session_key")


def best_and_worst(scores: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """By rank: everything when there are at most 2n entries, else the first and the last n."""
    size = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    seq = Sequence(scores, keys, ["rank"]).number("_pos").done().join(size, keys)
    keep = (F.col("_total") <= 2 * n) | (F.col("_pos") <= n) | (F.col("_pos") > F.col("_total") - n)
    return seq.where(keep).drop("_total", "_pos")


def insight_list(insights: DataFrame, start=None, end=None, application=None, members: DataFrame | None = None, limit=None, offset=0, descending=False) -> DataFrame:
    if start is not None:
        insights = insights.where(F.col("created") >= F.lit(start))
    if end is not None:
        insights = insights.where(F.col("created") <= F.lit(end))
    if application is not None:
        insights = insights.where(F.col("application_id") == application)
    if members is not None:
        insights = insights.join(members.select("session_key").distinct(), "session_key", "left_semi")
    order = F.desc("priority") if descending else F.asc("priority")
    return page(insights, [order, F.col("insight_id")], limit, offset)


def communication_chain(steps: DataFrame, keys: list[str], order: list[str], moderator: str, min_rows: int | None = None) -> DataFrame:
    """Edges between consecutive blocks; ``sound`` says whether the output is the next input."""
    seq = Sequence(steps, keys, order, min_rows=min_rows).next(to_agent="agent", _input="input").done()
    side = F.when(F.col("agent") == moderator, "query").otherwise("response")
    return seq.where("to_agent IS NOT NULL").select(
        *keys, *order, F.col("agent").alias("from_agent"), "to_agent", side.alias("side"),
        F.coalesce(F.col("output") == F.col("_input"), F.lit(False)).alias("sound"))


def filtered_records(df: DataFrame, filters: dict | None = None, order_by: list[str] = ()) -> DataFrame:
    """Equality or membership filters; sort keys with ``-`` descend. NULL is last ascending, first descending."""
    for name, want in (filters or {}).items():
        df = df.where(F.col(name).isin(want) if isinstance(want, list) else F.col(name).eqNullSafe(F.lit(want)))
    order: list[Column] = [
        F.col(k[1:]).desc_nulls_first() if k.startswith("-") else F.col(k).asc_nulls_last() for k in order_by]
    return df.orderBy(*order) if order else df


# -- counters that restart ------------------------------------------------------------------


def counter_totals(points: DataFrame, keys: list[str], order: list[str], value: str, reset_on: str | None = None, min_rows: int | None = None) -> DataFrame:
    """Total growth of a counter that falls when its source restarts.

    With v the readings in order, the total is the last reading minus the first, plus the reading
    before every fall: each piece counts from 0 but the first, which counts from where it began.
    """
    seq = Sequence(points, keys, order, min_rows=min_rows).prev(_v=value, _t=reset_on or value).done()
    fell = F.col(reset_on or value) < F.col("_t")
    pos = F.struct(*order)
    agg = seq.groupBy(*keys).agg(
        F.max_by(value, pos).alias("_last"), F.min_by(value, pos).alias("_first"),
        F.coalesce(F.sum(F.when(fell, F.col("_v"))), F.lit(0.0)).alias("_fallen"))
    return agg.select(*keys, (F.col("_last") - F.col("_first") + F.col("_fallen")).alias("total"))
